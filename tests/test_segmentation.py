"""Segmentation under all costs: cost tables against NumPy, pruned folds against the full search, published change points."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import changepoint, daily, models, segmentation, selection
from tidemark.session import stored


@pytest.fixture(scope="module")
def signal(spark):
    visits = spark.read.parquet(str(Path(__file__).parent / "data" / "visits.parquet")).select(F.col("patient_id").cast("int"), F.col("day").cast("int"), "score")
    return daily.daily_cv(visits).select(F.lit("cv").alias("series_id"), F.col("day").alias("t"), F.col("cv").alias("x")).cache()


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(3)
    series = {f"s{k}": np.concatenate([rng.normal(m, 0.3, rng.integers(8, 22)) for m in rng.permutation(4)]) for k in range(4)}
    series |= {"flat": np.ones(14), "ten": np.arange(10.0), "tiny": np.ones(4), "ties": np.repeat([1.0, 1.0, 2.0, 5.0], 6)}
    rows = [(k, t, float(v)) for k, x in series.items() for t, v in enumerate(x)] + [("s0", 900, None)]
    return series, spark.createDataFrame(rows, "series_id string, t int, x double").cache()


def table(x, cost):
    """Costs in NumPy; regressions by least squares over the rows themselves."""
    if cost != "ar":
        return changepoint.cost_table(x, cost)
    n, order = len(x), segmentation.ORDER
    lags = np.array([[x[max(0, t - k)] for k in range(1, order + 1)] + [1.0] for t in range(n)])
    y = np.concatenate([[x[min(order, n - 1)]] * min(order, n), x[order:]])
    out = np.zeros((n + 1, n + 1))
    for i in range(n):
        for j in range(i + 1, n + 1):
            out[i, j] = ((y[i:j] - lags[i:j] @ np.linalg.lstsq(lags[i:j], y[i:j], rcond=1e-9)[0]) ** 2).sum()
    return out


@pytest.mark.parametrize("cost", segmentation.COSTS)
def test_costs_and_pruned_search(many, cost):
    series, df = many
    tables = {k: table(x, cost) for k, x in series.items()}
    for r in segmentation.cost_table(df, cost).collect():
        want = tables[r["series_id"]][r["i"], r["i"] + 1 :]
        assert np.allclose(r["c"], want, atol=1e-7), (cost, r["series_id"], r["i"])
    penalties = [0.01, 0.3, 2.0, 9.0]
    seen = set()
    for r in segmentation.tuning_curve(df, cost, penalties).collect():
        x = series[r["series_id"]]
        own = tables[r["series_id"]]
        total = lambda cps: sum(own[a, b] + r["penalty"] for a, b in zip([0, *cps], [*cps, len(x)], strict=True))  # noqa: B023, E731
        assert total(r["cps"]) == pytest.approx(total(changepoint.segment(own, r["penalty"])), abs=1e-7), (cost, r)
        assert r["bic"] == pytest.approx(changepoint.bic(x, r["cps"]), abs=1e-6)
        seen.add((r["series_id"], r["penalty"]))
    assert seen == {(k, p) for k in series if k != "tiny" for p in penalties}


@pytest.mark.parametrize(("cost", "points"), [("l1", [24, 57, 133]), ("l2", [24, 58, 149]), ("rbf", [24, 57, 133]), ("ar", [57, 149])])
def test_published_change_points(signal, cost, points):
    assert segmentation.pelt(signal, cost).first()["cps"] == points


def test_unknown_cost(signal):
    with pytest.raises(ValueError):
        segmentation.pelt(signal, "l3")


def test_published_scores_of_models(signal):
    """The two published run-length models have the same change points; a second series must not move the first one's scores."""
    found = stored(segmentation.detected(signal, likelihoods=("student_t",)), "found")
    twin = found.where("model_id = 'bocpd_student_t'").withColumn("model_id", F.lit("bocpd_student_t_2"))
    both = found.unionAll(twin)
    other = both.withColumn("series_id", F.lit("other")).where("model_id <> 'pelt_l1'").withColumn("position", F.col("position") / 2)
    scored = models.rank_models(models.score_models(both.unionAll(other))).where("series_id = 'cv'").collect()
    want = {"pelt_l1": 0.94838103604059, "pelt_rbf": 0.94838103604059, "pelt_l2": 0.7578946415070144, "pelt_ar": 0.5911212118756308, "bocpd_student_t": 0.3404190084154493, "bocpd_student_t_2": 0.3404190084154493}
    assert {r["model_id"]: pytest.approx(r["score"], abs=1e-6) for r in scored} == want
    assert [r["model_id"] for r in sorted(scored, key=lambda r: r["rank"])][:4] == ["pelt_l1", "pelt_rbf", "pelt_l2", "pelt_ar"]
    chosen = {r["series_id"]: r for r in selection.select(both.unionAll(other)).collect()}
    assert chosen["cv"]["best_model"] == "pelt_l1" and chosen["cv"]["n_valid"] == 6 and "6.58%, 15.62%, 36.44%" in chosen["cv"]["explanation"]
    assert chosen["other"]["n_candidates"] == 5 and "pelt_l1" not in chosen["other"]["ranking"]
