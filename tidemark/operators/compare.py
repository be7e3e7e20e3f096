"""Datasets side by side: stability of the days' clusters, realism, quality and agreement with what is stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"temporal_stability": 0.35, "clinical_realism": 0.30, "statistical_quality": 0.20, "metadata_consistency": 0.15}


def two_levels(obs: DataFrame) -> DataFrame:
    """(dataset, day, mean, label): the days of each dataset in two clusters by their mean, 0 the lower: of all places to
    cut the sorted means the one of least squares within (k-means of one feature, solved exactly)."""
    d = obs.groupBy("dataset", "day").agg(F.avg("score").alias("mean"))
    by_mean, all_of = Window.partitionBy("dataset").orderBy("mean", "day"), Window.partitionBy("dataset")
    upto = by_mean.rowsBetween(Window.unboundedPreceding, 0)
    m = F.col("mean")
    r = d.withColumn("i", F.row_number().over(by_mean)).withColumn("s", F.sum(m).over(upto)).withColumn("n", F.count("*").over(all_of)).withColumn("st", F.sum(m).over(all_of))
    between = F.col("s") * F.col("s") / F.col("i") + (F.col("st") - F.col("s")) * (F.col("st") - F.col("s")) / F.nullif(F.col("n") - F.col("i"), F.lit(0))
    cut = r.where("i < n").groupBy("dataset").agg(F.max_by("i", F.struct(F.round(between, 9), -F.col("i"))).alias("cut"))
    return r.join(cut, "dataset", "left").select("dataset", "day", "mean", F.coalesce((F.col("i") > F.col("cut")).cast("int"), F.lit(0)).alias("label"))


def temporal_stability(labels: DataFrame) -> DataFrame:
    """(dataset, temporal_stability): 100 for labels that never change from day to day; fewer than two days are neutral."""
    prev = F.lag("label").over(Window.partitionBy("dataset").orderBy("day"))
    g = labels.withColumn("moved", (F.col("label") != prev).cast("int")).groupBy("dataset").agg(F.sum("moved").alias("moved"), F.count("*").alias("n"))
    return g.select("dataset", F.when(F.col("n") < 2, 50.0).otherwise((1 - F.coalesce("moved", F.lit(0)) / (F.col("n") - 1)) * 100).alias("temporal_stability"))


def clinical_realism(obs: DataFrame) -> DataFrame:
    """Mean of two scores: whether the mean daily variation is within bounds, and how near the share of moderate (but not
    moderately severe) and severe scores is to 70 %."""
    x = F.col("score")
    day = obs.groupBy("dataset", "day").agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    cv = day.groupBy("dataset").agg(F.avg(F.col("s") / (F.col("m") + 1e-6)).alias("cv"))
    share = obs.groupBy("dataset").agg(F.avg((((x >= 10) & (x < 15)) | (x >= 20)).cast("double")).alias("p"))
    steady = F.when(F.col("cv").between(0.10, 0.60), 100.0).otherwise(50.0)
    return cv.join(share, "dataset").select("dataset", ((steady + 100 - F.abs(F.col("p") - 0.70) * 100) / 2).alias("clinical_realism"))


def statistical_quality(obs: DataFrame, acceptable: float = 0.05) -> DataFrame:
    """Half for outliers beyond three deviations, a quarter each for skewness and kurtosis that are not extreme."""
    x = F.col("score")
    mom = obs.groupBy("dataset").agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    far = obs.join(mom.select("dataset", "mu", "sd"), "dataset").groupBy("dataset").agg(F.avg((F.abs(x - F.col("mu")) > 3 * F.col("sd")).cast("double")).alias("rate"))
    beyond = lambda c, least: F.when(F.abs(c) < least, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - (F.abs(c) - least) * 20))
    outlier = F.when(F.col("rate") <= acceptable, 100.0).otherwise(100 * (1 - F.col("rate")))
    total = 0.5 * outlier + 0.25 * beyond("skew", 1.0) + 0.25 * beyond("kurt", 2.0)
    return mom.join(far, "dataset").select("dataset", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(total, F.lit(0.0)))).alias("statistical_quality"))


def metadata_consistency(shape: DataFrame, stated: DataFrame, most: float = 0.03) -> DataFrame:
    """100 less 20 for days, patients and missingness that differ from what is stated; 50 for datasets without a statement.

    shape: (dataset, days, patients, missingness); stated: (dataset, total_days, n_patients, missingness_rate), parts may
    be null."""
    wrong = lambda c: F.when(c, 20.0).otherwise(0.0)
    j = shape.join(stated.withColumn("known", F.lit(True)), "dataset", "left")
    score = 100.0 - wrong(F.col("days") != F.col("total_days")) - wrong(F.col("patients") != F.col("n_patients")) - wrong(F.abs(F.col("missingness") - F.col("missingness_rate")) > most)
    return j.select("dataset", F.when(F.col("known"), score).otherwise(50.0).alias("metadata_consistency"))


def shape(obs: DataFrame) -> DataFrame:
    g = obs.groupBy("dataset").agg(F.count_distinct("day").alias("days"), F.count_distinct("patient_id").alias("patients"), F.count("score").alias("n"))
    return g.select("dataset", "days", "patients", (1 - F.col("n") / (F.col("days") * F.col("patients"))).alias("missingness"))


def rank_datasets(obs: DataFrame, labels: DataFrame, stated: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """(dataset, the four scores, composite_score, rank, recommended); one row a dataset, so that the last window is small."""
    j = temporal_stability(labels).join(clinical_realism(obs), "dataset").join(statistical_quality(obs), "dataset").join(metadata_consistency(shapes if shapes is not None else shape(obs), stated), "dataset")
    composite = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("composite_score", 9)), "dataset"))
    return j.withColumn("composite_score", composite).withColumn("rank", rank).withColumn("recommended", F.col("rank") == 1)
