"""Checks of a table of observations: each one aggregate of one row, put together as (check, value, low, high, level, ok)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import daily, trajectories

#: The bounds of each check, and whether a value beyond them is an error or a warning.
BOUNDS = {
    "score_min": (0.0, None, "error"),
    "score_max": (None, 27.0, "error"),
    "autocorrelation": (0.30, 0.70, "warning"),
    "baseline_mean": (13.0, 19.0, "warning"),
    "improvement_12_weeks": (3.0, None, "warning"),
    "response_rate_12_weeks": (0.40, 0.70, "warning"),
    "missingness": (None, 0.98, "warning"),
    "excess_missingness": (-0.05, 0.10, "warning"),
    "n_days": (30.0, None, "error"),
    "n_observations": (100.0, None, "error"),
    "outlier_rate": (None, 0.05, "warning"),
}


def checks(obs: DataFrame, n_days: int | None = None) -> DataFrame:
    """A check without a value (nobody to compute it from) isn't ok. Correlations, scores and missingness are taken to nine digits,
    as the queries of their own give them and SQL adds them up."""
    nine = lambda c: F.round(c, 9)
    # with no visit near the twelfth week, the final visits tell the improvement
    final = trajectories.baseline_final(obs).where("n >= 2").agg(F.avg(F.col("baseline") - F.col("final")).alias("final"))
    score = obs.agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    end = trajectories.endpoint_nearest(obs)
    near = end.agg(F.avg(nine("improvement")).alias("near"), F.avg(F.when(F.col("counted"), F.col("responder").cast("double"))).alias("response_rate_12_weeks"))  # one row, as is final
    missing = daily.missingness(obs, n_days)
    values = [
        score,
        trajectories.weighted_autocorrelation(obs).agg(F.avg(nine("r")).alias("autocorrelation")),
        trajectories.baseline_final(obs).agg(F.avg(nine("baseline")).alias("baseline_mean")),
near.crossJoin(final).select(F.coalesce("near", "final").alias("improvement_12_weeks"), "response_rate_12_weeks"),
        missing.select(nine("total").alias("missingness"), nine("excess").alias("excess_missingness"), F.col("n_days").cast("double").alias("n_days"), F.col("n_obs").cast("double").alias("n_observations")),
        daily.outlier_rate(obs).select(F.col("rate").alias("outlier_rate")),
    ]
    long = reduce(DataFrame.unionByName, (v.unpivot([], v.columns, "check", "value") for v in values))
    bound = lambda i, kind: F.coalesce(*(F.when(F.col("check") == k, F.lit(b[i]).cast(kind)) for k, b in BOUNDS.items()))
    long = long.select("check", F.round("value", 6).alias("value"), bound(0, "double").alias("low"), bound(1, "double").alias("high"), bound(2, "string").alias("level"))
    inside = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return long.withColumn("ok", F.coalesce(inside & F.col("value").isNotNull(), F.lit(False)))


def verdict(checked: DataFrame, most_warnings: int = 3) -> DataFrame:
    """One row: numbers of errors and warnings, and whether the data pass: no error, and no more than a few warnings."""
    bad = lambda level: F.count_if(~F.col("ok") & (F.col("level") == level))
    g = checked.agg(bad("error").alias("n_errors"), bad("warning").alias("n_warnings"))
    return g.withColumn("overall_valid", (F.col("n_errors") == 0) & (F.col("n_warnings") <= most_warnings))


def against_metadata(seen: DataFrame, stated: DataFrame, most: float = 0.01) -> DataFrame:
    """One row: whether days, patients and missingness agree with the sidecar (`sources.metadata`)."""
    s = stated.select(F.col("study_design.n_patients").alias("sp"), F.col("generation_statistics.n_observation_days").alias("sd"), F.col("generation_statistics.missingness_rate").alias("sm"))
    both = seen.crossJoin(F.broadcast(s))  # one row each
    return both.select((F.col("n_days") == F.col("sd")).alias("days_agree"), (F.col("n_patients") == F.col("sp")).alias("patients_agree"), (F.abs(F.col("missingness_rate") - F.col("sm")) <= most).alias("missingness_agrees"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Smallest and largest cluster, and how many times larger the largest is."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("smallest"), F.max("n").alias("largest"), (F.max("n") / F.min("n")).alias("imbalance"))
