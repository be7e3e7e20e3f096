"""The sidecar of a dataset: what it says, and whether the data agree. Each function gives one row (or one a pattern)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def facts(stated: DataFrame) -> DataFrame:
    """The sidecar's facts as plain columns; what is missing is null."""
    c = F.col
    return stated.select(
        F.to_timestamp("generation_timestamp").alias("generated_at"),
        c("relapse_config.distribution").alias("relapse_distribution"), c("relapse_config.probability").alias("relapse_probability"), c("relapse_config.magnitude_mean").alias("relapse_magnitude"),
        c("response_pattern_distribution").alias("patterns"), c("generation_statistics.patients_in_plateau").alias("patients_in_plateau"),
        c("missingness_config.dropout_rate").alias("dropout_rate"), c("missingness_config.mcar_rate").alias("mcar_rate"),
        c("model_parameters").alias("model_parameters"), c("generation_statistics.missingness_rate").alias("missingness_rate"),
        F.coalesce(c("features.response_patterns_enabled"), F.lit(False)).alias("has_patterns"), F.coalesce(c("features.plateau_logic_enabled"), F.lit(False)).alias("has_plateaus"),
        c("study_design.n_patients").alias("n_patients"), c("study_design.total_days").alias("total_days"), c("generation_statistics.n_observation_days").alias("n_observation_days"),
    )


def expected_rates(stated: DataFrame) -> DataFrame:
    """(pattern, expected_pct) from the sidecar's counts."""
    rows = stated.select(F.explode("response_pattern_distribution").alias("pattern", "n"), F.aggregate(F.map_values("response_pattern_distribution"), F.lit(0), lambda s, v: s + v).alias("total"))
    return rows.select("pattern", F.coalesce(F.col("n") * 100.0 / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("expected_pct"))


def mismatches(seen: DataFrame, stated: DataFrame, most: float = 0.01) -> DataFrame:
    """(what, observed, expected) of days, patients and missingness that differ; seen: one row (n_days, n_patients,
    missingness_rate)."""
    both = seen.select("n_days", "n_patients", "missingness_rate").crossJoin(F.broadcast(facts(stated).select(F.col("n_observation_days").alias("d"), F.col("n_patients").alias("p"), F.col("missingness_rate").alias("m"))))
    line = lambda name, a, b: F.struct(F.lit(name).alias("what"), F.col(a).cast("double").alias("observed"), F.col(b).cast("double").alias("expected"))
    rows = both.select(F.inline(F.array(line("days", "n_days", "d"), line("patients", "n_patients", "p"), line("missingness", "missingness_rate", "m"))))
    far = F.abs(F.col("observed") - F.col("expected"))
    return rows.where(F.when(F.col("what") == "missingness", far > most).otherwise(far > 0))


def pattern_differences(observed: DataFrame, stated: DataFrame, most: float = 10.0) -> DataFrame:
    """(pattern, expected_pct, observed_pct, difference, ok) for the sidecar's patterns; observed: (pattern, n)."""
    total = observed.agg(F.sum("n").alias("total"))
    rows = F.broadcast(expected_rates(stated)).join(observed, "pattern", "left").crossJoin(F.broadcast(total))
    seen = F.coalesce(F.col("n") * 100.0 / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    rows = rows.select("pattern", "expected_pct", seen.alias("observed_pct")).withColumn("difference", F.abs(F.col("expected_pct") - F.col("observed_pct")))
    return rows.withColumn("ok", F.col("difference") <= most)


def plateau_difference(n_plateau: int, n_patients: int, stated: DataFrame, most: float = 15.0) -> DataFrame:
    share = lambda c: F.coalesce(c * 100.0 / F.nullif(F.lit(n_patients), F.lit(0)), F.lit(0.0))
    rows = stated.select(share(F.col("generation_statistics.patients_in_plateau")).alias("expected_rate"), share(F.lit(n_plateau)).alias("observed_rate"))
    return rows.withColumn("difference", F.abs(F.col("expected_rate") - F.col("observed_rate"))).withColumn("ok", F.col("difference") <= most)


def severity_difference(mean: float, std: float, stated: DataFrame) -> DataFrame:
    """Baselines against the sidecar's: warnings only, beyond 1 for the mean and 0.5 for the deviation."""
    m, s = F.col("model_parameters.baseline_mean"), F.col("model_parameters.baseline_std")
    return stated.select((F.abs(mean - m) > 1.0).alias("mean_warning"), (F.abs(std - s) > 0.5).alias("std_warning"))
