"""Numbers of clusters, posterior maps, settings, whole runs and the command line."""

import itertools
import json
import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import settings as st
from tidemark.__main__ import main
from tidemark.operators import detect, optimal, quality, trajectories
from tidemark.plans import runs
from tidemark.sources import detection_results

VISITS = Path(__file__).parent / "data" / "visits.parquet"


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    at = {"two": [(0, 0), (9, 9)], "three": [(0, 0), (8, 1), (20, 9)]}
    rows = [(k, d, float(a + rng.normal(0, 0.4)), float(b + rng.normal(0, 0.4)), "x") for k, c in at.items() for d, (a, b) in enumerate(c * 12)]
    rows += [("same", d, 1.0, 2.0, "x") for d in range(5)] + [("one", 0, 3.0, 3.0, "x"), ("two", 99, None, 1.0, "x")]
    return spark.createDataFrame(rows, "dataset string, day int, a double, b double, label string")


def test_cluster_numbers(spark, blobs):
    fitted = optimal.fits(blobs, ["a", "b"], 1, 4).where("dataset IN ('two', 'three')").toPandas()
    for (_, _, _), g in fitted.groupby(["dataset", "run", "k"]):
        # a settled fit: every day is nearest to the mean of its own label
        means = g.groupby("label")[["a", "b"]].mean()
        d = ((g[["a", "b"]].to_numpy()[:, None] - means.to_numpy()) ** 2).sum(2)
        assert (means.index.to_numpy()[d.argmin(1)] == g["label"].to_numpy()).all() and np.allclose(d.min(1), g["square"])
    out = optimal.choose(blobs, ["a", "b"], 4)
    chosen = {r["dataset"]: r["k"] for r in out.where("chosen").collect()}
    assert chosen["two"] == 2 and chosen["three"] == 3 and "one" not in chosen
    assert out.where("dataset = 'same'").agg(F.sum("inertia")).first()[0] == 0
    gaps = optimal.gap(blobs.where("dataset IN ('two', 'three')"), ["a", "b"], 4)
    assert {r["dataset"]: r["k"] for r in gaps.where("chosen").collect()} == {"two": 2, "three": 3}
    assert optimal.gap(blobs.limit(0), ["a", "b"]).count() == 0 and optimal.choose(blobs.limit(0), ["a", "b"]).count() == 0


def test_posterior_map_by_all_configurations(spark):
    x = [0.3, 0.5, 2.0, 1.9, 2.2, 0.1]
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate(x)], "series_id string, t int, x double")
    lam = detect.hazard(df, "variance").first()["hazard_lambda"]
    h, m0, v0 = min(0.99, 1 / lam), np.mean(x), max(1e-8, np.var(x))
    log = lambda v, m, s, c: -0.5 * (math.log(2 * math.pi * (s * (1 + 1 / c) + 1e-8)) + (v - m) ** 2 / (s * (1 + 1 / c) + 1e-8))
    want: dict = {}
    for t in range(len(x)):
        weight: dict = {}
        for changes in itertools.product([0, 1], repeat=t):
            total, last, m, s, c = 0.0, 0, m0, v0, 1
            for k, change in enumerate(changes, 1):
                if change:
                    total, last, m, s, c = total + math.log(h) + log(x[k], m0, v0, 1), k, m0, v0, 1
                    continue
                total += math.log(1 - h) + log(x[k], m, s, c)
                c, d = c + 1, x[k] - m
                m += d / c
                s = max(1e-8, ((c - 1) * s + d * (x[k] - m)) / c)
            weight[t - last] = weight.get(t - last, 0.0) + math.exp(total)
        want |= {(t, r): w / sum(weight.values()) for r, w in weight.items()}
    cells = detect.posterior_map(df, "gaussian", least=-1.0)
    got = {(r["t"], r["run_length"]): r["p"] for r in cells.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert all(abs(r["p"] - 1) < 1e-9 for r in cells.groupBy("t").agg(F.sum("p").alias("p")).collect())


def test_settings():
    a = st.Detection(costs=("l2",), hazard_range=(100.0, 300.0))
    text = json.dumps(dict(reversed(list(json.loads(a.canonical()).items()))), indent=2)
    again = st.Detection.read(text)
    assert again == a and again.digest() == a.digest() != st.Detection().digest() and len(a.digest()) == 64
    assert a.models() == ["pelt_l2", "bocpd_student_t", "bocpd_gaussian"]
    bad = [{"execution_mode": "single"}, {"execution_mode": "ensemble"}, {"detectors": ()}, {"costs": ("l3",)}, {"hazard_range": (20.0, 300.0)}, {"hazard_range": (100.0, 100.0)}, {"penalty": 0.0}, {"alpha": 1.0}]
    for b in bad:
        with pytest.raises(ValueError):
            st.Detection(**b)
    for text in ('{"weigths": 1}', '{"kind": "Detection"}', "[1]", "not json"):
        with pytest.raises(ValueError):
            st.Selection.read(text)
    for kind, b in ((st.Selection, {"weights": {"n_significant_cps": 1.1}}), (st.Selection, {"weights": {"x": 0.1}}), (st.Selection, {"model_ids": ()}), (st.Exploration, {"use_temporal_clustering": True}), (st.Exploration, {"max_clusters": 1})):
        with pytest.raises(ValueError):
            kind(**b)
    with pytest.warns(UserWarning, match="smoothing"):
        st.Detection(smoothing=9)
    with pytest.warns(UserWarning, match="temporal_weight"):
        st.Exploration(temporal_weight=0.3)


def test_run_with_a_failed_model(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, t, float(v)) for k in ("a", "b") for t, v in enumerate(np.concatenate([rng.normal(m, 0.2, 14) for m in (1, 3, 1)]))]
    signals = spark.createDataFrame(rows, "series_id string, t int, x double")
    real = runs._one

    def one(signals, settings, model):
        if model == "pelt_l2":
            raise RuntimeError("no luck")
        return real(signals, settings, model)

    monkeypatch.setattr(runs, "_one", one)
    s = st.Detection(costs=("l2", "l1"), likelihoods=("gaussian",), selection_enabled=True, hazard_range=(100.0, 500.0))
    out = runs.detection(signals, s)
    status = {r["model_id"]: (r["status"], r["error"], r["config_hash"]) for r in out["status"].collect()}
    assert status["pelt_l2"][:2] == ("failed", "RuntimeError: no luck") and status["pelt_l1"][0] == "ok" and status["bocpd_gaussian"][2] == s.digest()
    assert {r["cp"] for r in out["detected"].where("model_id = 'pelt_l1'").collect()} >= {14, 28} and out["selected"].count() == 2
    only = st.Detection("single", ("pelt",), costs=("l2",))
    with pytest.raises(RuntimeError, match="no luck"):
        runs.detection(signals, only)


def test_command_line(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('{"execution_mode": "single"}')
    assert main(["detect", str(VISITS), str(tmp_path / "o"), "--settings", str(bad)], spark) == 2
    assert main(["detect", str(tmp_path / "none.csv"), str(tmp_path / "o")], spark) == 1
    few = tmp_path / "few.json"
    few.write_text('{"costs": ["l2"], "likelihoods": ["student_t"]}')
    assert main(["detect", str(VISITS), str(tmp_path / "o"), "--settings", str(few)], spark) == 0
    assert {r["status"] for r in spark.read.json(str(tmp_path / "o" / "status")).collect()} == {"ok"}
    found = spark.read.parquet(str(tmp_path / "o" / "model_results"))
    assert "config_hash" in found.columns and found.where("model_id = 'pelt_l2'").count() > 0


def test_stored_results(spark, tmp_path):
    test = {"change_point_index": 24, "normalized_position": 24 / 365, "p_value": 0.03, "p_value_corrected": 0.04, "cohens_d": 1.8, "significant_after_correction": True}
    docs = [
        {"model_id": "pelt_l1", "signal_length": 365, "change_points": [24, 57], "validation": {"tests": {"CP_1": test}}},
        {"model_id": "bocpd_x", "signal_length": 365, "change_points": [32 / 365, 69 / 365], "validation": {"overall_significant": True, "summary": {"mean_posterior_at_cp": 0.5}}},
        {"model_id": "none", "signal_length": 365, "change_points": []},
    ]
    for d in docs:
        (tmp_path / f"{d['model_id']}.json").write_text(json.dumps(d, indent=1))
    got = {(r["model_id"], r["cp"]): r for r in detection_results(spark, str(tmp_path)).collect()}
    assert got.keys() == {("pelt_l1", 24), ("pelt_l1", 57), ("bocpd_x", 32), ("bocpd_x", 69)}
    assert got["pelt_l1", 24]["p_value"] == 0.04 and got["pelt_l1", 57]["significant"] is None and got["bocpd_x", 69]["posterior"] == 0.5 and got["bocpd_x", 32]["significant"]


def test_published_autocorrelation_and_late_improvement(spark):
    visits = spark.read.parquet(str(VISITS)).select(F.col("patient_id").cast("int"), F.col("day").cast("int"), "score")
    r = trajectories.autocorrelation_report(visits).first()
    assert (round(r["mean"], 5), r["n_patients"], r["median_gap"]) == (0.36461, 896, 14)
    late = visits.where("day < 60 OR day > 200")
    got = quality.checks(late).where("check = 'improvement_12_weeks'").first()["value"]
    ends = trajectories.baseline_final(late).where("n >= 2").agg(F.avg(F.col("baseline") - F.col("final"))).first()[0]
    assert got == round(ends, 6)
