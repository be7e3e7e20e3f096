"""Change points and relapses of a stream, with state per series that Spark keeps between batches (transformWithStateInPandas).

Rows may arrive late within a batch and across batches. A series buffers what arrives until it is `delay` days behind the latest
event, then takes its rows in event order. What comes later still, up to `horizon` days, is reported as late rather than lost, for
a batch run to merge (`merged`); Spark itself drops, and counts, what is behind its watermark at the horizon. Timers fire by event
time, so a series that gets no more rows is closed too.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.detect import LONGEST_RUN
from ..session import shared_folder

_T3 = math.lgamma(2.0) - math.lgamma(1.5) - 0.5 * math.log(3 * math.pi)


def advance(state: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], x: float, prior: tuple[float, float], hazard: float, likelihood: str = "student_t", longest: int = LONGEST_RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One step of the run-length recursion: log probabilities, means, variances and counts of the runs, the youngest first."""
    log_p, mean, var, count = state
    m0, v0 = prior

    def predictive(m: np.ndarray, v: np.ndarray, n: np.ndarray) -> np.ndarray:
        scale = v * (1 + 1 / n) + 1e-8
        z = (x - m) ** 2 / scale
        return _T3 - 0.5 * np.log(scale) - 2 * np.log1p(z / 3) if likelihood == "student_t" else -0.5 * (np.log(2 * math.pi * scale) + z)

    d, n = x - mean, count + 1
    moved = mean + d / n
    grown = log_p + predictive(mean, var, count) + math.log(1 - hazard)
    born = math.log(hazard) + predictive(np.array([m0]), np.array([v0]), np.array([1.0]))
    out = (np.append(born, grown), np.append(m0, moved), np.append(v0, np.maximum(1e-8, (count * var + d * (x - moved)) / n)), np.append(1.0, n))
    out = tuple(a[:longest] for a in out)
    top = out[0].max()
    return (out[0] - (top + math.log(np.exp(out[0] - top).sum())), *out[1:])


class _InOrder(StatefulProcessor):
    """Rows (at in microseconds, x) of a key, buffered until the watermark passes them and then taken in order of at.

    They wait in slices of time, each in parts as they came, so that one slice at most is in memory, however many rows wait."""

    lead = 0  # milliseconds between the watermark and the time up to which rows are taken
    slice = 3_600_000_000  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "slice long, part int", "at binary, x binary")  # of NumPy, 8 bytes a value
        self.index = handle.getValueState("index", "slices array<long>, parts array<int>, taken long")

    def waiting(self) -> tuple[dict[int, int], int | None]:
        """The slices with rows that wait, how many parts each has, and the time of the last row taken. One value, for each call
        of the state costs more than a row."""
        found = self.index.get()
        return (dict(zip(*found[:2], strict=True)), found[2]) if found else ({}, None)

    def wait(self, slices: dict[int, int], taken: int | None) -> None:
        self.index.update((list(slices), list(slices.values()), taken))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (slices, done), first = self.waiting(), None
        for pdf in rows:
            at, x = pdf["at"].to_numpy(np.int64), pdf["x"].to_numpy(float)
            if done is not None:
                late = at <= done
                if late.any():
                    yield self.told_late(key, list(zip(at[late].tolist(), x[late].tolist(), strict=True)))
                at, x = at[~late], x[~late]
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, x = at[order], x[order]
            first = int(at[0]) if first is None else min(first, int(at[0]))
            of = at // self.slice
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(at)]
            for i, j in zip(cuts, cuts[1:]):
                s = int(of[i])
                self.parts.updateValue((s, slices.get(s, 0)), (at[i:j].tobytes(), x[i:j].tobytes()))
                slices[s] = slices.get(s, 0) + 1
        if first is not None:
            self.wait(slices, done)
            self.handle.registerTimer(first // 1000 + 1 - self.lead)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = (timerValues.getCurrentWatermarkInMs() + self.lead) * 1000
        (slices, last), follow = self.waiting(), None
        for s in sorted(slices):
            if s * self.slice >= limit:
                follow = s * self.slice
                break
            found = [self.parts.getValue((s, i)) for i in range(slices[s])]
            at, x = (np.concatenate([np.frombuffer(part[k], kind) for part in found]) for k, kind in ((0, np.int64), (1, float)))
            order = np.lexsort((x, at))  # equal times go by value, whatever came first
            at, x = at[order], x[order]
            n = int(np.searchsorted(at, limit))
            for i in range(int(n < len(at)), slices.pop(s)):  # the rest goes over the first part
                self.parts.removeKey((s, i))
            if n:
                last = int(at[n - 1])
                out = self.step(key, list(zip(at[:n].tolist(), x[:n].tolist(), strict=True)))
                if len(out):
                    yield out
            if n < len(at):
                self.parts.updateValue((s, 0), (at[n:].tobytes(), x[n:].tobytes()))
                slices[s], follow = 1, int(at[n])
                break
        self.wait(slices, last)
        if follow is not None:
            self.handle.registerTimer(follow // 1000 + 1 - self.lead)

    def close(self) -> None:
        pass


class RunLengths(_InOrder):
    """The run-length posterior of each series under a fixed prior."""

    def __init__(self, hazard_lambda: float, mean: float, variance: float, likelihood: str, longest: int):
        self.hazard, self.prior, self.likelihood, self.longest = min(0.99, 1 / hazard_lambda), (mean, max(1e-8, variance)), likelihood, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.runs = handle.getValueState("runs", "t long, log_p array<double>, mean array<double>, var array<double>, count array<double>")

    def step(self, key, ready: list[tuple[int, float]]) -> pd.DataFrame:
        out = []
        if self.runs.exists():
            t, *parts = self.runs.get()
            state = tuple(np.array(a, float) for a in parts)
        else:
            t, state = -1, tuple(np.array([v]) for v in (0.0, *self.prior, 1.0))
        for at, x in ready:
            t += 1
            p = 0.0
            if t:  # the first value opens the first run
                state = advance(state, x, self.prior, self.hazard, self.likelihood, self.longest)
                p = float(math.exp(state[0][0]))
            out.append((key[0], at, t, p, int(state[0].argmax()), False))
        self.runs.update((t, *(a.tolist() for a in state)))
        return pd.DataFrame(out, columns=["series_id", "at", "t", "p", "run", "late"])

    def told_late(self, key, late: list[tuple[int, float]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], at, None, None, None, True) for at, _ in late], columns=["series_id", "at", "t", "p", "run", "late"]).astype({"t": "Int64", "run": "Int64", "p": "float64"})


class Relapses(_InOrder):
    """Rises of `threshold` or more between visits that are neighbours in time, `low` to `high` days apart."""

    slice = 30 * 86_400_000_000  # a patient has few visits, so few slices hold them

    def __init__(self, threshold: float, low: int, high: int):
        self.threshold, self.low, self.high = threshold, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long, x double")

    def step(self, key, ready: list[tuple[int, float]]) -> pd.DataFrame:
        before, out = self.last.get(), []
        for at, x in ready:
            if before is not None:
                gap = (at - before[0]) // DAY
                if self.low <= gap <= self.high and x - before[1] >= self.threshold:
                    out.append((key[0], at, gap, x - before[1], False))
            before = (at, x)
        self.last.update(before)
        return pd.DataFrame(out, columns=["series_id", "at", "gap", "increase", "late"])

    def told_late(self, key, late: list[tuple[int, float]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], at, None, None, True) for at, _ in late], columns=["series_id", "at", "gap", "increase", "late"]).astype({"gap": "Int64", "increase": "float64"})


DAY = 86_400_000_000  # microseconds
_KEYED = "series_id string, at long, "


def _stateful(stream: DataFrame, processor: _InOrder, schema: str, delay: float, horizon: float) -> DataFrame:
    if not 0 < delay <= horizon:
        raise ValueError("0 < delay <= horizon")
    processor.lead = int((horizon - delay) * DAY / 1000)
    rows = stream.select(F.col("series_id").cast("string").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("x").cast("double").alias("x"))
    rows = rows.where("series_id IS NOT NULL AND ts IS NOT NULL AND x IS NOT NULL").withWatermark("ts", f"{int(horizon * DAY / 1000)} milliseconds")
    keyed = rows.withColumn("at", F.unix_micros("ts")).groupBy("series_id")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=T._parse_datatype_string(schema), outputMode="append", timeMode="eventTime")


def run_lengths(stream: DataFrame, hazard_lambda: float = 100.0, mean: float = 0.0, variance: float = 1.0, likelihood: str = "student_t", longest: int = LONGEST_RUN, delay: float = 1.0, horizon: float = 30.0) -> DataFrame:
    """(series_id, at, t, p, run, late) of a stream (series_id, ts, x): as each value is taken, its place in
    the series from 0, the probability that a run begins there, and the likeliest run length. late: values that came after
    later ones had been taken; they have no t. Rows with a null are left out."""
    return _stateful(stream, RunLengths(hazard_lambda, mean, variance, likelihood, longest), _KEYED + "t long, p double, run long, late boolean", delay, horizon)


def relapses(stream: DataFrame, threshold: float = 3.0, low: int = 7, high: int = 30, delay: float = 1.0, horizon: float = 30.0) -> DataFrame:
    """(series_id, at, gap, increase, late) of a stream of visits (series_id, ts, x)."""
    return _stateful(stream, Relapses(threshold, low, high), _KEYED + "gap long, increase double, late boolean", delay, horizon)


#: Lists, maps and timers of a key need the state store that keeps them apart.
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(out: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a folder of its own under `folder` (by default the one that all machines share),
    and read that. Each batch writes a path of its own, so a batch that is tried again replaces what it had written. Rows less
    than the delay behind the latest are still waiting in the state."""
    spark = out.sparkSession
    path = f"{(folder or shared_folder(spark)).rstrip('/')}/online-{uuid.uuid4().hex}"
    numbers: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        numbers.append(number)

    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = out.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    if not numbers:
        return spark.createDataFrame([], out.schema)
    schema = T.StructType([*out.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{path}/rows").drop("batch")


def merged(settled: DataFrame, visits: DataFrame, threshold: float = 3.0, low: int = 7, high: int = 30) -> DataFrame:
    """Relapses with the late visits: series without late rows keep what the stream found, those with any are worked out again
    from all their visits (series_id, ts, x)."""
    from pyspark.sql import Window

    again = settled.where("late").select("series_id").distinct()
    kept = settled.where("NOT late").join(again, "series_id", "left_anti").drop("late")
    w = Window.partitionBy("series_id").orderBy("at", "x")
    rows = visits.select("series_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "x").join(again, "series_id", "left_semi")
    step = rows.withColumns({"gap": F.floor((F.col("at") - F.lag("at").over(w)) / DAY), "increase": F.col("x") - F.lag("x").over(w)})
    return kept.unionByName(step.where((F.col("gap").between(low, high)) & (F.col("increase") >= threshold)).select("series_id", "at", "gap", "increase"))
