"""Sequences of days: lag correlations, boundaries of clusters, samples of trajectories, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lag1(signals: DataFrame) -> DataFrame:
    """(series_id, r, autocorrelation): Pearson of neighbours, and their products over squares, both about the mean."""
    own = Window.partitionBy("series_id")
    x = signals.withColumn("c", F.col("x") - F.avg("x").over(own)).withColumn("y", F.lead("x").over(own.orderBy("t"))).withColumn("d", F.lead(F.col("x")).over(own.orderBy("t")) - F.avg("x").over(own))
    return x.groupBy("series_id").agg(F.corr("x", "y").alias("r"), (F.sum(F.col("c") * F.col("d")) / F.nullif(F.sum(F.col("c") * F.col("c")), F.lit(0.0))).alias("autocorrelation"))


def boundaries(labels: DataFrame) -> DataFrame:
    """(dataset, after): days after which the cluster changes, but for lone flips: a change at either end counts, one in
    the middle only if the label before it, or the one after, holds for two days."""
    w = Window.partitionBy("dataset").orderBy("day")
    at = lambda k: F.lead("label", k).over(w) if k > 0 else F.lag("label", -k).over(w)
    rows = labels.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("dataset"))).withColumn("next", at(1)).withColumn("ago", at(-1)).withColumn("then", at(2))
    ends = (F.col("i") == 0) | (F.col("i") == F.col("n") - 2)
    held = (F.col("ago") == F.col("label")) | (F.col("next") == F.col("then"))
    return rows.where((F.col("label") != F.col("next")) & (ends | held)).select("dataset", F.col("day").alias("after"))


def sample_trajectories(obs: DataFrame, patterns: DataFrame, each: int = 5) -> DataFrame:
    """The visits of the first patients of each pattern."""
    first = patterns.withColumn("i", F.row_number().over(Window.partitionBy("pattern").orderBy("patient_id"))).where(F.col("i") <= each).select("patient_id", "pattern")
    return obs.join(F.broadcast(first), "patient_id")  # as many rows as patterns times `each`


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, low, count): bins of equal width, the last one closed; values beyond are left out."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    return rows.select("bin", (low + F.col("bin") * width).alias("low"), "count")


def observation_days(obs: DataFrame) -> DataFrame:
    """(day, day_idx, n_patients): the days with any visit, numbered from 0; days are few, so one window orders them."""
    g = obs.groupBy("day").agg(F.count_distinct("patient_id").alias("n_patients"))
    return g.withColumn("day_idx", F.row_number().over(Window.orderBy("day")) - 1)
