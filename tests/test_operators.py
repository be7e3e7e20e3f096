"""Micro-fixtures of the survey, properties, and injected change points."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark import settings as settings_of
from tidemark.operators import changepoint as cp
from tidemark.operators import daily, models, posthoc, selection, trajectories

OBS = "patient_id int, day int, score double"


def step3(seed=1):
    rng = np.random.default_rng(seed)
    return np.concatenate([np.full(n, m) for n, m in ((100, 0.2), (100, 0.5), (100, 0.3), (65, 0.6))]) + rng.normal(0, 0.02, 365)


@pytest.mark.parametrize("model", cp.COSTS)
def test_injected_change_points(model):
    x = step3()
    _, found, curve = cp.tune(x, cp.cost_table(x, model))
    assert len(curve) == 50
    assert all(min(abs(f - t) for f in found) <= 5 for t in (100, 200, 300))


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=20, max_size=40), st.integers(0, 10**6))
def test_no_segmentation_is_cheaper(values, seed):
    x, rng = np.array(values), np.random.default_rng(seed)
    c = cp.cost_table(x, "l2")
    total = lambda cps: sum(c[a, b] + 1.0 for a, b in zip([0, *cps], [*cps, len(x)], strict=True))
    cut = int(rng.integers(5, len(x) - 5 + 1))
    assert total(cp.segment(c, 1.0)) <= min(total([]), total([cut])) + 1e-9


def test_run_lengths_and_peaks():
    p = cp.run_lengths(step3(), 100.0)
    assert len(p) == 365 and ((p >= 0) & (p <= 1)).all()
    runs = np.zeros(30)
    runs[2:6], runs[10:15], runs[24:30] = 0.5, 0.6, 0.7
    assert cp.persistent_peaks(runs, 0.1, 5) == [10, 24]
    assert np.isclose(cp.smooth(np.ones(40)), 1).all()


def test_permutation_and_adjustment():
    assert cp.permutation(np.arange(5.0), np.arange(10.0, 15.0)) == pytest.approx(2 / 252)
    assert cp.adjust([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.04, 0.04])
    assert cp.adjust([0.01, 0.5], "bonferroni") == [0.02, 1.0]


def test_short_and_flat_signals():
    for n, sd in ((19, 1.0), (30, 0.0)):
        with pytest.raises(ValueError):
            daily.check_signal(n, sd)


def test_single_observation_days(spark):
    obs = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 2, 7.0), (1, 3, 0.0), (2, 3, 0.0)], OBS)
    assert [r["day"] for r in daily.daily_cv(obs).collect()] == [2]
    assert {r["day"]: r["std"] for r in daily.daily_features(obs).collect()}[1] == 0.0
    assert {r["day"] for r in daily.daily_moments(obs).collect()} == {2, 3}


def test_relapse_edges(spark):
    rows = [(p, d, s) for p, (gap, rise) in enumerate([(6, 4.0), (7, 3.0), (30, 3.0), (31, 4.0), (10, 2.99)]) for d, s in ((1, 5.0), (1 + gap, 5.0 + rise))]
    assert {r["patient_id"] for r in trajectories.relapses(spark.createDataFrame(rows, OBS)).collect()} == {1, 2}


def test_nearest_visit_takes_the_earliest(spark):
    obs = spark.createDataFrame([(1, 1, 20.0), (1, 80, 8.0), (1, 88, 9.0)], OBS)
    r = trajectories.endpoint_nearest(obs).first()
    assert (r["end_day"], r["improvement"], r["responder"]) == (80, 12.0, True)


def test_plateau_windows(spark):
    rows = [(n, 10 * d, 5.0) for n in (5, 6, 8) for d in range(n)]
    assert {r["patient_id"]: r["plateau_day"] for r in trajectories.plateau(spark.createDataFrame(rows, OBS)).collect()} == {6: 0, 8: 0}


def test_exact_permutation_in_sql_agrees(spark):
    values = [1.0, 2.0, 4.0, 3.0, 2.5, 7.0, 8.0, 5.0, 9.0, 3.5]
    parts = spark.createDataFrame([(5, "cv", d, v, d >= 5) for d, v in enumerate(values)], "change_point int, feature string, day int, value double, post boolean")
    x = np.array(values)
    assert posthoc.permutation_exact(parts).first()["p_value"] == pytest.approx(cp.permutation(x[:5], x[5:]))


def test_linkage_and_elbow(spark):
    x = np.array([0.0, 0.1, 5.0, 5.1, 9.0])
    d = np.abs(np.subtract.outer(x, x))
    for method in ("average", "complete", "ward"):
        assert models.linkage(d, 3, method).tolist() == [0, 0, 1, 1, 2]
    assert models.elbow(spark.sql("SELECT * FROM VALUES (2, 5D), (3, 5D) AS t(k, inertia)")).first()["k"] == 2


def test_detect_over_a_grid(spark):
    pdf = [("a", t, float(v)) for t, v in enumerate(step3())]
    found = cp.detect(spark.createDataFrame(pdf, "series_id string, t int, x double"), ["pelt_l2", "bocpd_student_t"]).toPandas()
    l2 = found[found.model_id == "pelt_l2"]
    assert set(l2.cp) == {100, 200, 300} and l2.significant.all()


def test_scores_of_models(spark):
    rows = [("s", m, 1.0, 100, c, p, d, ok, None, q) for m, c, p, d, ok, q in (("pelt_a", 0.3, 0.01, 2.0, True, None), ("pelt_a", 0.6, 0.2, 1.0, False, None), ("pelt_b", 0.3, 0.01, 1.0, True, None), ("pelt_c", 0.9, 0.5, 0.1, False, None), ("bocpd_x", 0.6, None, None, True, 0.4))]
    detected = spark.createDataFrame(rows, cp.DETECTED)
    got = {r["model_id"]: r for r in models.score_models(detected).collect()}
    assert set(got) == {"pelt_a", "pelt_b", "bocpd_x"}

    def scaled(v):
        lo, hi = np.percentile(v, 5), np.percentile(v, 95)
        return np.full(len(v), 0.5) if hi - lo < 1e-9 else np.clip((v - lo) / (hi - lo), 0, 1)

    far = float(np.exp(-225.0))
    n, d, mass = np.array([1.0, 1, 0]), np.array([1.5, 1.0, 0.0]), np.array([0, 0, 0.4])
    stable = np.array([(1 + (1 + far) / 2) / 2, (1 + (1 + 2 * far) / 3) / 2, 0.0])
    stable[1], stable[2] = (1 + (1 + 2 * far) / 3) / 2, (1 + (1 + 2 * far) / 3) / 2
    want = 0.3 * scaled(n) + 0.3 * scaled(d) + 0.2 * scaled(stable) + 0.2 * scaled(mass) + 0.25 * stable
    assert [got[m]["score"] for m in ("pelt_a", "pelt_b", "bocpd_x")] == pytest.approx(want.tolist())
    alone = {r["model_id"]: r for r in models.score_models(detected, weights={"mass": 1.0}).collect()}
    again = models.normalize(models.score_models(detected).withColumn("scaled", F.col("mass")), "scaled").collect()
    assert {k: r["score"] for k, r in alone.items()} == pytest.approx({r["model_id"]: 0.25 * r["stability"] + r["scaled"] for r in again})
    assert selection.select(detected, weights=settings_of.METRICS).first() == selection.select(detected).first()
    with pytest.raises(ValueError):
        selection.select(detected, weights={"speed": 1.0})
    assert [r["score"] for r in models.score_models(detected.where("model_id = 'pelt_b'")).collect()] == [1.0]
    assert models.score_models(detected.where("model_id = 'pelt_c'")).count() == 0


def test_results_follow_the_tables(spark):
    from tidemark.plans import QUERIES

    a, b = (QUERIES["permutation_bh"](spark, f"/root/testdata/{sf}").collect() for sf in ("sf0.001", "sf0.01"))
    assert a and b and sorted(map(str, a)) != sorted(map(str, b))
