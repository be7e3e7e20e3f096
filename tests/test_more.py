"""Selection, clusters, sidecars, sinks, datasets and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import sinks, sources
from tidemark.operators import changepoint, clusters, compare, labels, metadata, selection, sequence


def detected(spark, rows):
    return spark.createDataFrame([("s", m, 1.0, c, c / 100, p, d, ok, None, q) for m, c, p, d, ok, q in rows], changepoint.DETECTED)


def test_selection_and_its_edge_cases(spark):
    rows = [("pelt_a", 30, 0.01, 2.0, True, None), ("pelt_a", 60, 0.01, 1.5, True, None), ("pelt_b", 30, 0.01, 1.0, True, None), ("pelt_c", 90, 0.5, 0.1, False, None), ("bocpd_x", 60, None, None, True, 0.4)]
    got = selection.select(detected(spark, rows)).first()
    assert got["best_model"] == got["ranking"][0] == "pelt_a" and (got["n_candidates"], got["n_valid"]) == (4, 3)
    assert "30.00%, 60.00%" in got["explanation"] and "ahead of" in got["explanation"]
    one = selection.select(detected(spark, rows), ("bocpd",)).first()
    assert one["best_model"] == "bocpd_x" and one["explanation"].startswith("the only valid model")
    none = selection.select(detected(spark, rows), model_ids=("pelt_c",)).first()
    assert none["best_model"] is None and none["ranking"] == [] and none["explanation"] == "none of 1 models is valid"
    assert selection.select(detected(spark, rows), ("other",)).first()["explanation"] == "no eligible models"
    with pytest.raises(ValueError):
        selection.select(detected(spark, rows), strategy="best")
    v = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, 2.0, 2.0, 7.0])], "i int, x double")
    values = lambda m: [r["x"] for r in selection.normalized(v, "x", m).orderBy("i").collect()]
    assert values("minmax") == pytest.approx([0, 1 / 6, 1 / 6, 1]) and values("rank") == pytest.approx([0, 1 / 3, 1 / 3, 1])
    x = np.array([1.0, 2, 2, 7])
    assert values("zscore") == pytest.approx(((x - x.mean()) / x.std()).tolist())
    lo, hi = np.percentile(x, 5), np.percentile(x, 95)
    assert values("robust") == pytest.approx(np.clip((x - lo) / (hi - lo), 0, 1).tolist())


def test_silhouette_by_hand(spark):
    rng = np.random.default_rng(1)
    x, l = np.concatenate([rng.normal(0, 1, (12, 2)), rng.normal(3, 1, (9, 2)), [[50.0, 50.0]]]), [0] * 12 + [1] * 9 + [2]  # noqa: E741
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if l[j] == l[i] and j != i]
        a, b = np.mean(d[i, own]) if own else 0.0, min(np.mean([d[i, j] for j in range(len(x)) if l[j] == k]) for k in {0, 1, 2} - {l[i]})
        s.append((b - a) / max(a, b) if own else 0.0)
    df = spark.createDataFrame([("a", i, l[i], float(p[0]), float(p[1])) for i, p in enumerate(x)], "dataset string, day int, label int, u double, v double")
    assert clusters.silhouette(df, ["u", "v"]).first()["silhouette"] == pytest.approx(np.mean(s))
    assert clusters.silhouette(df.where("label = 0"), ["u", "v"]).first()["silhouette"] == -1.0
    costs = spark.createDataFrame([(2, 100.0), (3, 60.0), (4, 58.0), (5, 40.0), (6, 39.0)], "k int, inertia double")
    want = int(np.argmin(np.diff([100.0, 60, 58, 40, 39], 2))) + 4
    assert clusters.elbow_by_bend(costs).first()["k"] == want
    assert clusters.best_silhouette(spark.createDataFrame([(2, 0.4), (3, 0.6), (4, 0.6)], "k int, silhouette double")).first()["k"] == 3


def test_two_levels_and_boundaries(spark):
    means = [1.0, 1.2, 5.0, 1.1, 5.1, 5.2, 5.3, 1.0]
    obs = spark.createDataFrame([("a", p, d, m) for d, m in enumerate(means) for p in (1, 2)], "dataset string, patient_id int, day int, score double")
    lab = compare.two_levels(obs)
    assert [r["label"] for r in lab.orderBy("day").collect()] == [0, 0, 1, 0, 1, 1, 1, 0]
    assert compare.temporal_stability(lab).first()["temporal_stability"] == pytest.approx((1 - 4 / 7) * 100)
    v = [r["label"] for r in lab.orderBy("day").collect()]
    want = [i for i in range(7) if v[i] != v[i + 1] and (i in (0, 6) or v[i - 1] == v[i] or v[i + 1] == v[i + 2])]
    assert sorted(r["after"] for r in sequence.boundaries(lab).collect()) == want
    stated = spark.createDataFrame([("a", 8, 3, None)], "dataset string, total_days int, n_patients int, missingness_rate double")
    assert compare.metadata_consistency(compare.shape(obs), stated).first()["metadata_consistency"] == 80.0
    assert compare.metadata_consistency(compare.shape(obs), stated.limit(0)).first()["metadata_consistency"] == 50.0


def test_labels(spark):
    rows = spark.createDataFrame([(0.0,), (4.0,), (4.5,), (20.0,), (27.0,), (28.0,), (None,)], "x double")
    got = rows.select(labels.band_of_whole_scores(F.col("x")).alias("a"), labels.band(F.col("x")).alias("b")).collect()
    assert [r["a"] for r in got] == ["minimal", "minimal", "unknown", "severe", "severe", None, None]
    assert [r["b"] for r in got] == ["minimal"] * 3 + ["severe"] * 3 + [None]
    z = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.96, 4.0, 9.0)], "z double").select(labels.upper_tail(F.col("z")).alias("p")).collect()
    from math import erfc

    assert [r["p"] for r in z] == pytest.approx([erfc(v / 2**0.5) / 2 for v in (0.0, 0.5, 1.96, 4.0, 9.0)], abs=1e-15)


SIDE = {"generation_timestamp": "2026-01-17T20:02:05", "study_design": {"n_patients": 10, "total_days": 30}, "model_parameters": {"baseline_mean": 16.0, "baseline_std": 3.0}, "relapse_config": {"distribution": "gamma", "probability": 0.1},
        "missingness_config": {"dropout_rate": 0.2}, "response_pattern_distribution": {"early_responder": 6, "non_responder": 4}, "generation_statistics": {"missingness_rate": 0.5, "n_observation_days": 30, "patients_in_plateau": 4}}


def test_sidecar(spark, tmp_path):
    (tmp_path / "a.metadata.json").write_text(json.dumps(SIDE))
    stated = sources.metadata(spark, sources.sidecar_of(str(tmp_path / "a.csv")))
    f = metadata.facts(stated).first()
    assert (f["relapse_distribution"], f["dropout_rate"], f["has_patterns"], f["n_patients"], f["generated_at"].year) == ("gamma", 0.2, False, 10, 2026)
    seen = spark.createDataFrame([(29, 10, 0.6)], "n_days int, n_patients int, missingness_rate double")
    assert {r["what"] for r in metadata.mismatches(seen, stated).collect()} == {"days", "missingness"}
    d = {r["pattern"]: r for r in metadata.pattern_differences(spark.createDataFrame([("early_responder", 9), ("late_responder", 1)], "pattern string, n long"), stated).collect()}
    assert d["early_responder"]["difference"] == pytest.approx(30.0) and not d["non_responder"]["ok"]
    assert metadata.plateau_difference(5, 10, stated).first()["ok"] and not metadata.plateau_difference(6, 10, stated).first()["ok"]
    assert tuple(metadata.severity_difference(17.5, 3.2, stated).first()) == (True, False)


def test_sinks(spark, tmp_path):
    rows = [("pelt_a", 30, 0.01, 2.0, True, None), ("bocpd_x", 60, None, None, True, float("nan"))]
    found = detected(spark, rows)
    paths = sinks.detection(str(tmp_path / "out"), found, selected=selection.select(found))
    assert len(paths) == 4 and spark.read.parquet(paths[0]).count() == 2
    assert [r["day_label"] for r in spark.read.option("header", True).csv(paths[1]).collect()] == ["Day_31", "Day_61"]
    assert spark.read.json(paths[-1]).count() == 1
    assert spark.read.json(sinks.json(found, str(tmp_path), "rows")).where("posterior IS NOT NULL").count() == 0
    wide = spark.createDataFrame([(1, 1, 3.0), (2, 4, 5.5)], "patient_id int, day int, score double")
    sources.write_wide_csv(wide, str(tmp_path / "wide"))
    assert sorted(map(tuple, sources.wide_csv(spark, str(tmp_path / "wide")).collect())) == [(1, 1, 3.0), (2, 4, 5.5)]
    with pytest.raises(FileNotFoundError):
        sources.wide_csv(spark, str(tmp_path / "missing.csv"))
    assert sources.discover(str(tmp_path), ["a", "wide"], "") == {"wide": str(tmp_path / "wide")}


def test_plot_data_and_predictive_hazard(spark):
    from tidemark.operators import daily, detect, plotdata

    cases = spark.createDataFrame([([3.0, 7.0], 10), ([0.25, 0.5], 10), ([0.5, 3.0], 10), ([], 10)], "c array<double>, n int")
    assert [r[0] for r in cases.select(plotdata.point_index(F.col("c"), F.col("n"))).collect()] == [[3, 7], [2, 5], None, []]
    x = np.random.default_rng(2).normal(1, 0.1, 60)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(x[:22])]
    s = spark.createDataFrame(rows, "series_id string, t int, x double")
    marked = plotdata.marked_signal(s, spark.createDataFrame([("a", [5, 9])], "series_id string, cps array<int>")).orderBy("series_id", "t").collect()
    assert [(r["segment"], r["starts"]) for r in marked[:10]] == [(0, False)] * 5 + [(1, True)] + [(1, False)] * 3 + [(2, True)]
    assert {(r["segment"], r["starts"]) for r in marked[60:]} == {(0, False)}
    got = detect.predictive_hazard(s).collect()
    mine = sorted((r for r in got if r["series_id"] == "a"), key=lambda r: r["hazard_lambda"])
    want = []
    for k in range(3):
        end = int(60 * (0.7 + 0.05 * k))
        if end < 50:
            v = np.var(x[:end]) + 1e-8
            want.append(-0.5 * np.sum((x[end : end + 10] - np.mean(x[:end])) ** 2 / v) - 5 * np.log(2 * np.pi * v))
    assert len(mine) == 20 and mine[0]["chosen"] and not mine[1]["chosen"] and mine[0]["hazard_lambda"] == pytest.approx(30) and mine[-1]["hazard_lambda"] == pytest.approx(300)
    assert mine[7]["score"] == pytest.approx(np.mean(want))
    assert [(r["score"], r["chosen"]) for r in got if r["series_id"] == "b"] == [(None, True)]
    obs = spark.createDataFrame([(1, 1, 5.0), (1, 2, 6.0), (2, 4, 1.0)], "patient_id int, day int, score double")
    assert tuple(daily.patient_missingness(obs, 4).first()) == pytest.approx((2, 0.625, 0.1767766953, 0.5, 0.75))
