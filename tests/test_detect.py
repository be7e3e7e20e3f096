"""Change points of the stored visits against published results, and folds against plain Python."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import changepoint, compare, daily, detect, models, optimal


@pytest.fixture(scope="module")
def visits(spark):
    return spark.read.parquet(str(Path(__file__).parent / "data" / "visits.parquet")).select(F.col("patient_id").cast("int"), F.col("day").cast("int"), "score").cache()


@pytest.fixture(scope="module")
def signal(visits):
    return daily.daily_cv(visits).select(F.lit("cv").alias("series_id"), F.col("day").alias("t"), F.col("cv").alias("x")).cache()


def test_known_segmentation(signal):
    seg = detect.pelt_l2(signal).cache()
    r = seg.first()
    assert r["cps"] == [24, 58, 149] and r["penalty"] == pytest.approx(0.01757511, rel=1e-6) and r["n"] == 365
    told = {v["cp"]: v for v in detect.validate(detect.points(seg), signal).collect()}
    assert sum(v["significant"] for v in told.values()) == 2
    s = detect.test_summary(detect.validate(detect.points(seg), signal)).first()
    assert (s["n_changepoints"], s["n_significant"], s["overall_significant"]) == (3, 2, True)
    parts = detect.segments(seg).orderBy("segment").collect()
    assert [(p["start"], p["end"]) for p in parts] == [(0, 24), (24, 58), (58, 149), (149, 365)]
    x = np.array([v["x"] for v in signal.orderBy("t").collect()])
    for p in detect.segment_statistics(seg, signal).collect():
        a, b = parts[p["segment"]]["start"], parts[p["segment"]]["end"]
        assert (p["length"], p["mean"], p["variance"]) == (b - a, pytest.approx(x[a:b].mean()), pytest.approx(x[a:b].var()))


def test_known_run_lengths(signal):
    assert detect.hazard(signal).first()["hazard_lambda"] == 100.0
    got = detect.bocpd(signal).orderBy("cp").collect()
    assert [r["cp"] for r in got] == [32, 69] and got[0]["threshold"] == pytest.approx(0.0111335752, rel=1e-6)
    x = np.array([v["x"] for v in signal.orderBy("t").collect()])
    for likelihood in ("student_t", "gaussian"):
        want = changepoint.run_lengths(x, 100.0, likelihood)
        post = detect.run_length_posterior(signal, detect.hazard(signal), likelihood)
        p = [r["p"] for r in post.orderBy("t").collect()]
        assert np.allclose(p, want, atol=1e-12)
        assert np.allclose([r["p"] for r in detect.smooth(post).orderBy("t").collect()], changepoint.smooth(want), atol=1e-12)
    assert [r["rank"] for r in detect.top_posterior(post, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_folds_over_many_series(spark):
    rng = np.random.default_rng(3)
    series = {f"s{k}": np.concatenate([rng.normal(m, 0.3, rng.integers(8, 30)) for m in rng.permutation(4)]) for k in range(6)} | {"tiny": np.ones(4), "ten": np.arange(10.0)}
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series_id string, t int, x double")
    got = {r["series_id"]: r for r in detect.pelt_l2(df).collect()}
    assert "tiny" not in got
    for k, r in got.items():
        penalty, cps, _ = changepoint.tune(series[k], changepoint.cost_table(series[k], "l2"))
        assert r["cps"] == cps and r["penalty"] == pytest.approx(penalty), k
    runs = spark.createDataFrame([("a", i, 0.9 if i in range(2, 6) or i in range(10, 15) or i > 23 else 0.0) for i in range(30)], "series_id string, t int, p double")
    assert [r["t"] for r in detect.persistent_peaks(runs, 0.0).orderBy("t").collect()] == [10, 24]
    assert detect.persistent_peaks(runs, 0.0, 1).count() == 15


def test_published_clusters_and_composite(spark, visits):
    days = daily.daily_features(visits)
    labels = models.kmeans_days(days).cache()
    assert sorted(r["count"] for r in labels.groupBy("label").count().collect()) == [110, 255]
    in_time = [r["label"] for r in labels.orderBy("day").collect()]
    assert sum(a != b for a, b in zip(in_time, in_time[1:], strict=False)) == 47
    obs = visits.withColumn("dataset", F.lit("gamma"))
    shape = compare.shape(obs).first()
    stated = spark.createDataFrame([("gamma", shape["days"], shape["patients"], shape["missingness"])], "dataset string, total_days long, n_patients long, missingness_rate double")
    got = compare.rank_datasets(obs, labels.withColumn("dataset", F.lit("gamma")), stated).first()
    assert got["temporal_stability"] == pytest.approx(87.0879, abs=1e-4) and got["composite_score"] == pytest.approx(91.3645, abs=1e-4)
    again = optimal.two_clusters(daily.daily_features(obs, ("dataset",)), ["mean", "std", "cv", "n_obs", "pct_severe"])
    assert {r["day"]: r["label"] for r in again.collect()} == {r["day"]: r["label"] for r in labels.collect()}
    got = compare.rank_datasets(obs, again, stated).first()
    assert got["composite_score"] == pytest.approx(91.3645, abs=1e-4)
    labels.unpersist()


def test_two_clusters_by_hand(spark):
    """The cheapest split of one feature is among the starts' ends; datasets of one day, of equal days and with nulls."""
    low_high = [1.0, 1.2, 9.0, 1.1, 9.1, 9.2, 9.3, 1.0, 9.5, 1.3]
    rows = [("a", d, m, 2 * m) for d, m in enumerate(low_high)] + [("one", 1, 3.0, 3.0)] + [("same", d, 4.0, 1.0) for d in range(5)] + [("a", 99, None, 1.0), ("none", 1, None, None)]
    got = optimal.two_clusters(spark.createDataFrame(rows, "dataset string, day int, level double, other double"), ["level", "other"]).collect()
    assert {(r["dataset"], r["day"]): r["label"] for r in got} == {("a", d): int(m > 5) for d, m in enumerate(low_high)} | {("one", 1): 0} | {("same", d): 0 for d in range(5)}
    assert {r["mean"] for r in got if r["dataset"] == "same"} == {4.0}
    empty = spark.createDataFrame([], "dataset string, day int, level double, other double")
    assert optimal.two_clusters(empty, ["level", "other"]).count() == 0


def test_hazard_strategies(spark):
    rng = np.random.default_rng(0)
    for n in (8, 12, 200, 900):
        x = np.cumsum(rng.normal(size=n))
        df = spark.createDataFrame([("a", t, float(v)) for t, v in enumerate(x)], "series_id string, t int, x double")
        full = np.lib.stride_tricks.sliding_window_view(x, 5).var(axis=1, ddof=1)
        d = np.concatenate([[0, 0], np.abs(np.diff(full)), [0, 0]])
        at = np.flatnonzero(d > np.percentile(d, 75))
        raw = n / 4 if n < 10 else float(np.median(np.diff([0, *at, n]))) if len(at) > 1 else n / 5
        one = lambda s: detect.hazard(df, s, 50.0, 250.0).first()["hazard_lambda"]
        assert one("variance") == pytest.approx(np.clip(raw, 50, 250))
        r = np.clip(np.corrcoef(x[:-1], x[1:])[0, 1], -0.99, 0.99)
        assert one("autocorr") == pytest.approx(np.clip(min(-1 / np.log(max(r, 0.01)), n / 3) if r > 0.01 else n / 5, 50, 250))
        assert one("uniform") == pytest.approx(np.clip(n / (max(3, min(6, n // 60)) + 1), 50, 250))
    with pytest.raises(ValueError):
        detect.hazard(df, "other")
