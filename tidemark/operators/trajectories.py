"""Patients' trajectories: fits, response patterns, plateaus, relapses, endpoints; all keyed by patient_id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_day():
    return Window.partitionBy("patient_id").orderBy("day")


def baseline_final(obs: DataFrame) -> DataFrame:
    return obs.groupBy("patient_id").agg(F.count("score").alias("n"), F.min_by("score", "day").alias("baseline"), F.max_by("score", "day").alias("final"))


def endpoint_nearest(obs: DataFrame, target: int = 84, tolerance: int = 14) -> DataFrame:
    """The visit nearest to a day, the earliest of ties; of patients with two visits or more."""
    near = F.when(F.abs(F.col("day") - target) <= tolerance, F.struct(F.abs(F.col("day") - target), F.col("day")))
    g = obs.groupBy("patient_id").agg(F.count("score").alias("n"), F.min_by("score", "day").alias("baseline"), F.min_by(F.struct("day", "score"), near).alias("x"), F.min(near).alias("near")).where("n >= 2 AND near IS NOT NULL")
    end = F.col("x.score")
    return g.select("patient_id", "baseline", F.col("x.day").alias("end_day"), end.alias("end_score"), (F.col("baseline") - end).alias("improvement"), (F.col("baseline") > 0).alias("counted"), F.coalesce((F.col("baseline") - end) / F.nullif(F.col("baseline"), F.lit(0.0)) >= 0.5, F.lit(False)).alias("responder"))


def fits(obs: DataFrame, least: int = 5, early_days: int = 70) -> DataFrame:
    """Per patient of `least` visits or more: ends, line, and improvement within the first weeks."""
    s, d, soon = F.col("score"), F.col("day"), F.col("day") <= early_days
    g = obs.groupBy("patient_id").agg(
        F.count(s).alias("n_obs"), F.min_by(s, d).alias("baseline"), F.max_by(s, d).alias("final"), F.regr_slope(s, d).alias("slope"), F.regr_r2(s, d).alias("r2"), (F.max(d) - F.min(d)).alias("duration"),
        F.count_if(soon).alias("n_early"), F.min_by(F.when(soon, s), F.when(soon, d)).alias("e0"), F.max_by(F.when(soon, s), F.when(soon, d)).alias("e1"),
    ).where(F.col("n_obs") >= least)
    pct = F.when(F.col("baseline") > 0, (F.col("baseline") - F.col("final")) / F.nullif(F.col("baseline"), F.lit(0.0))).otherwise(0.0)
    early = F.when((F.col("n_early") >= 2) & (F.col("e0") > 0), (F.col("e0") - F.col("e1")) / F.nullif(F.col("e0"), F.lit(0.0))).otherwise(0.0)
    return g.select("patient_id", "n_obs", "baseline", "final", (F.col("baseline") - F.col("final")).alias("improvement"), pct.alias("improvement_pct"), "slope", "r2", "duration", early.alias("early_improvement"))


def pattern() -> Column:
    slope = F.col("slope")
    gradual = F.when(F.col("n_obs") >= 84, F.when(F.col("early_improvement") > 0.30, "gradual_responder").otherwise("late_responder")).otherwise("gradual_responder")
    return F.when((F.col("improvement_pct") < 0.20) | (slope > -0.02), "non_responder").when(slope <= -0.08, "early_responder").when(slope <= -0.04, gradual).otherwise("late_responder")


def response_patterns(obs: DataFrame) -> DataFrame:
    return fits(obs).withColumn("pattern", pattern())


#: The expected shares of the four patterns.
EXPECTED = {"early_responder": 0.30, "gradual_responder": 0.35, "late_responder": 0.15, "non_responder": 0.20}


def pattern_vs_expected(patterns: DataFrame, expected: dict[str, float] | None = None) -> DataFrame:
    spark = patterns.sparkSession
    e = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {v}D)" for k, v in (expected or EXPECTED).items()) + " AS t(pattern, expected)")
    seen = patterns.groupBy("pattern").count()
    both = F.broadcast(e).join(seen, "pattern", "left").withColumn("observed", F.coalesce("count", F.lit(0)))
    total = F.sum("observed").over(Window.partitionBy())
    both = both.withColumn("observed_pct", F.col("observed") * 100.0 / F.nullif(total, F.lit(0))).withColumn("expected_pct", F.col("expected") * 100)
    diff = F.abs(F.col("observed_pct") - F.col("expected_pct"))
    return both.select("pattern", "observed", "observed_pct", "expected_pct", F.greatest(F.lit(0.0), 100 - F.avg(diff).over(Window.partitionBy())).alias("match_score"))


def plateau(obs: DataFrame, most_variance: float = 2.0, most_slope: float = 0.01) -> DataFrame:
    """The first window of min(4, n // 2) visits, three at least, that is flat: small variance and slope."""
    n = F.count("score").over(Window.partitionBy("patient_id"))
    rows = obs.withColumn("n", n).where("n >= 6")
    flat = F.lit(False)
    for width, holds in ((3, F.col("n") < 8), (4, F.col("n") >= 8)):
        w = by_day().rowsBetween(0, width - 1)
        ok = (F.count("score").over(w) == width) & (F.var_pop("score").over(w) <= most_variance) & (F.abs(F.regr_slope(F.col("score"), F.col("day")).over(w)) <= most_slope)
        flat = flat | (holds & ok)
    return rows.withColumn("flat", flat).where("flat").groupBy("patient_id").agg(F.min("day").alias("plateau_day"))


def steps(obs: DataFrame) -> DataFrame:
    """Consecutive visits: (patient_id, day, score, next_day, next_score)."""
    return obs.select("patient_id", "day", "score", F.lead("day").over(by_day()).alias("next_day"), F.lead("score").over(by_day()).alias("next_score")).where("next_day IS NOT NULL")


def relapses(obs: DataFrame, threshold: float = 3.0, low: int = 7, high: int = 30) -> DataFrame:
    gap, rise = F.col("next_day") - F.col("day"), F.col("next_score") - F.col("score")
    return steps(obs).where(gap.between(low, high) & (rise >= threshold)).select("patient_id", F.col("next_day").alias("day"), gap.alias("gap"), rise.alias("increase"))


def relapse_summary(obs: DataFrame, threshold: float = 3.0, n_patients: int | None = None) -> DataFrame:
    each = obs.select("patient_id").distinct().join(relapses(obs, threshold).groupBy("patient_id").count(), "patient_id", "left")
    n = F.lit(n_patients) if n_patients else F.count("*")
    return each.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("events"), F.count("count").alias("patients_with"), (F.count("count") / n).alias("rate"), (F.coalesce(F.sum("count"), F.lit(0)) / n).alias("per_patient"))


def weighted_autocorrelation(obs: DataFrame, window: int = 21, scale: float = 10.0) -> DataFrame:
    """Per patient the Pearson correlation of consecutive visits, near ones weighted more; patients with an effective
    number of pairs below 3 are left out. Days are whole; the weight of each distance is rounded right, as in SQL (Spark's own
    exp is off in the last bit at some), for with three equal distances that bit decides whether the number reaches 3."""
    weights = F.array(*(F.lit(math.exp(-g / scale)) for g in range(window + 1)))
    enough = obs.withColumn("n", F.count("score").over(Window.partitionBy("patient_id"))).where("n >= 3")
    gap = F.col("next_day") - F.col("day")
    p = steps(enough).withColumn("gap", gap).where(F.col("gap") <= window).withColumn("w", F.get(weights, gap.cast("int")))
    w, x, y = F.col("w"), F.col("score"), F.col("next_score")
    g = p.groupBy("patient_id").agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    m = lambda c: F.col(c) / F.col("sw")
    g = g.where(F.col("sw") * F.col("sw") / F.col("sww") >= 3)
    vx, vy = m("sxx") - m("sx") * m("sx"), m("syy") - m("sy") * m("sy")
    return g.withColumn("vx", vx).withColumn("vy", vy).where("vx > 1e-12 AND vy > 1e-12").select("patient_id", ((m("sxy") - m("sx") * m("sy")) / F.sqrt(F.col("vx") * F.col("vy"))).alias("r"), (F.col("sw") * F.col("sw") / F.col("sww")).alias("n_eff"))


def autocorrelation_report(obs: DataFrame, near: int = 14) -> DataFrame:
    """One row: mean, population deviation, least and greatest of the patients' correlations, their number, the median distance of
    consecutive visits (of patients with three or more) and the share of distances up to `near` days; no values without patients.
    Correlations are taken to nine digits, as `weighted_autocorr` gives them and SQL adds them up."""
    r = weighted_autocorrelation(obs).withColumn("r", F.round("r", 9)).agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.min("r").alias("least"), F.max("r").alias("greatest"), F.count("r").alias("n_patients"))
    enough = obs.withColumn("n", F.count("score").over(Window.partitionBy("patient_id"))).where("n >= 3")
    gap = F.col("next_day") - F.col("day")
    g = steps(enough).agg(F.percentile(gap, F.lit(0.5)).alias("median_gap"), F.avg(F.when(gap.isNotNull(), (gap <= near).cast("double"))).alias("share_near"))
    return r.crossJoin(g)  # one row each
