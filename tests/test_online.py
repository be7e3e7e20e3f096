"""Streams with state against the batch operators: shuffled and late arrivals, equal times, nulls, several batches."""

import datetime as dt
import math
import random

import numpy as np
import pytest

from tidemark.operators import detect, trajectories
from tidemark.streaming import online

SCHEMA = "series_id string, ts timestamp, x double, at int"
START = dt.datetime(2024, 1, 1)


def feed(spark, folder, batches):
    """A stream that takes one file a batch, in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/part={i}")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/in/part=none")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def day(i):
    return START + dt.timedelta(days=i)


def test_run_lengths_equal_the_batch_recursion(spark, tmp_path):
    rng = random.Random(1)
    series = {f"s{k}": [rng.gauss(3 * (i > 20), 1) for i in range(30 + 5 * k)] for k in range(2)}
    rows = [(k, day(i), x, 1) for k, xs in series.items() for i, x in enumerate(xs)] + [("s0", day(3), None, 1), (None, day(3), 1.0, 1)]
    rng.shuffle(rows)
    end = [("end", day(400), 0.0, 1)]  # carries the watermark past the others
    for likelihood in ("student_t", "gaussian"):
        folder = f"{tmp_path}/{likelihood}"
        stream = feed(spark, folder, [rows[::2], rows[1::2], end])
        got = online.drained(online.run_lengths(stream, 20.0, 0.5, 1.5, likelihood, delay=90, horizon=120), folder).collect()
        assert {r["series_id"] for r in got} == set(series) and not any(r["late"] for r in got)
        signals = spark.createDataFrame([(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)], "series_id string, t int, x double")
        hazards = spark.createDataFrame([(k, 20.0) for k in series], "series_id string, hazard_lambda double")
        want = {(r["series_id"], r["t"]): r["p"] for r in detect.run_length_posterior(signals, hazards, likelihood, prior=(0.5, 1.5)).collect()}
        assert {(r["series_id"], r["t"]) for r in got} == set(want)
        assert all(r["p"] == pytest.approx(want[r["series_id"], r["t"]], abs=1e-12) for r in got)


def test_step_is_a_probability():
    rng, state = np.random.default_rng(1), tuple(np.array([v]) for v in (0.0, 0.0, 1.0, 1.0))
    for x in rng.normal(size=50):
        state = online.advance(state, float(x), (0.0, 1.0), 0.05, longest=20)
        assert math.isclose(np.exp(state[0]).sum(), 1.0, rel_tol=1e-9) and len(state[0]) <= 20


def test_relapses_of_shuffled_visits_and_late_ones(spark, tmp_path):
    rng = random.Random(2)
    visits = [(f"p{p}", day(d), float(rng.randint(0, 27)), 1) for p in range(6) for d in sorted(rng.sample(range(150), 14))]
    late = [("p0", day(40), 1.0, 1), ("p0", day(50), 26.0, 1)]
    shuffled = rng.sample(visits, len(visits))
    stream = feed(spark, str(tmp_path), [shuffled[::2], shuffled[1::2], [("end", day(400), 0.0, 1)], [("end", day(600), 0.0, 1)], late])
    settled = online.drained(online.relapses(stream, delay=200, horizon=900), str(tmp_path)).cache()
    assert settled.where("late").count() == 2

    def batch(rows):
        obs = spark.createDataFrame([(k, (t - START).days, x) for k, t, x, _ in rows], "patient_id string, day int, score double")
        return {(r["patient_id"], r["day"], r["gap"], r["increase"]) for r in trajectories.relapses(obs).collect()}

    def told(df):
        return {(r["series_id"], r["at"] // online.DAY - dt.datetime(2024, 1, 1, tzinfo=dt.UTC).timestamp() // 86400, r["gap"], r["increase"]) for r in df.collect()}

    assert told(settled.where("NOT late")) == batch(visits)
    both = online.merged(settled, spark.createDataFrame(visits + late, SCHEMA))
    assert told(both) == batch(visits + late) != batch(visits)
    settled.unpersist()
