"""Tables that charts are drawn from: lines, counts and marked signals, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .daily import daily_trend
from .trajectories import relapses


def daily_line(obs: DataFrame) -> DataFrame:
    """(day, i, mean, fitted): daily means and the line through them; days are few, so one window orders them."""
    d = obs.groupBy("day").agg(F.avg("score").alias("mean")).withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    line = daily_trend(obs).select("slope", "intercept")  # one row
    return d.crossJoin(F.broadcast(line)).select("day", "i", "mean", (F.col("intercept") + F.col("slope") * F.col("i")).alias("fitted"))


def relapses_by_gap(obs: DataFrame) -> DataFrame:
    """(gap, n, mean_increase, largest): relapses by the days between the two visits."""
    return relapses(obs).groupBy("gap").agg(F.count("*").alias("n"), F.avg("increase").alias("mean_increase"), F.max("increase").alias("largest"))


def point_index(cp, n):
    """The index of change points given either way: whole numbers are indices, shares of the length from 0 to 1 are not.

    cp: an array of doubles, n: the length. Null for arrays that are neither."""
    whole, share = F.forall(cp, lambda c: c == F.floor(c)), F.forall(cp, lambda c: c.between(0, 1))
    return F.when(whole, F.transform(cp, lambda c: c.cast("int"))).when(share, F.transform(cp, lambda c: (c * n).cast("int")))


def marked_signal(signals: DataFrame, segmented: DataFrame) -> DataFrame:
    """(series_id, t, x, segment, starts): the number of each point's segment and whether it is a change point.

    segmented: (series_id, cps), the indices of change points; a series without a row there is one segment."""
    i = F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1
    cps = F.coalesce("cps", F.array().cast("array<int>"))
    rows = signals.withColumn("i", i).join(segmented.select("series_id", "cps"), "series_id", "left").withColumn("cps", cps)
    return rows.select("series_id", "t", "x", F.size(F.filter("cps", lambda c: c <= F.col("i"))).alias("segment"), F.exists("cps", lambda c: c == F.col("i")).alias("starts"))
