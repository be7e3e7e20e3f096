"""Online variants over a stream of events (ts, user_id, value): windows with a watermark. State by series is in `online`.

Events later than the watermark allows are dropped by the windows; a batch run over the whole table takes them in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def _windowed(events: DataFrame, delay: str, *keys: Column) -> DataFrame:
    g = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(*keys)
    return g.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"))


def _cv() -> Column:
    return (F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))).alias("cv")


def daily_cv(events: DataFrame, delay: str = "1 day") -> DataFrame:
    return _windowed(events, delay, F.window("ts", "1 day")).select(F.col("window.start").alias("day"), "mean", "std", "n", _cv())


def sliding_cv(events: DataFrame, size: str = "3 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    return _windowed(events, delay, F.window("ts", size, slide)).select(F.col("window.start").alias("start"), "mean", "std", "n", _cv())


def sessions(events: DataFrame, gap: str = "12 hours", delay: str = "1 day") -> DataFrame:
    """Visits of a user that are less than the gap apart, as one session."""
    return _windowed(events, delay, F.session_window("ts", gap), F.col("user_id")).select("user_id", F.col("session_window.start").alias("start"), "n", "mean")


def drain(df: DataFrame, keys: list[str] | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream of aggregates over what is there now, into Parquet in the shared folder (or `folder`), and read it.

    With keys the stream runs in update mode, so that windows which are still open count too, and the last state of each
    key is what is read. Without (sessions, which have no update mode), in complete mode; the last batch is the table.
    Each batch writes a path of its own, so one that is tried again replaces its rows. Nothing passes through the driver."""
    spark, columns = df.sparkSession, df.columns
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = T.StructType([*df.schema.fields, T.StructField("__batch", T.LongType())])
    last: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/__batch={number}")
        last[:] = [number]

    query = df.writeStream.outputMode("update" if keys else "complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    if not keys:
        return rows.where(F.col("__batch") == last[0]).drop("__batch")
    rest = [c for c in columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("newest"))
    return newest.select(*keys, *(F.col(f"newest.{c}").alias(c) for c in rest)).select(*columns)
