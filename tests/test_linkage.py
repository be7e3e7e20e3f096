"""Agglomerative clusters by rounds against merging pair by pair."""

import numpy as np
import pytest

from tidemark.operators import linkage, models


def pairs(spark, sets):
    rows = [(k, i, j, float(np.sqrt(((x[i] - x[j]) ** 2).sum()))) for k, x in sets.items() for i in range(len(x)) for j in range(i + 1, len(x))]
    return spark.createDataFrame(rows, "dataset string, i int, j int, d double")


@pytest.mark.parametrize("method", linkage.METHODS)
def test_labels_equal_merging_pair_by_pair(spark, method):
    rng = np.random.default_rng(4)
    sets = {f"d{k}": rng.normal(size=(rng.integers(2, 25), 3)) for k in range(20)}
    merges = linkage.agglomerate(pairs(spark, sets), method).cache()
    count = {k: 0 for k in sets}
    for r in merges.collect():
        count[r["dataset"]] += 1
    assert count == {k: len(x) - 1 for k, x in sets.items()}
    points = spark.createDataFrame([(k, i) for k, x in sets.items() for i in range(len(x))] + [("one", 0)], "dataset string, i int")
    for k in (1, 3):
        got = {(r["dataset"], r["i"]): r["label"] for r in linkage.cut(points, merges, k).collect()}
        assert got.pop(("one", 0)) == 0
        for name, x in sets.items():
            d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            assert [got[name, i] for i in range(len(x))] == models.linkage(d, min(k, len(x)), method).tolist(), (method, name, k)
    merges.unpersist()


def test_equal_distances_and_empty_tables(spark):
    square = {"a": np.array([[0.0], [1.0], [2.0], [3.0]]), "b": np.zeros((5, 1))}
    merges = linkage.agglomerate(pairs(spark, square), "complete").collect()
    assert sorted(r["height"] for r in merges if r["dataset"] == "a") == [1.0, 1.0, 3.0] and sum(r["dataset"] == "b" for r in merges) == 4
    assert linkage.agglomerate(pairs(spark, square).limit(0)).count() == 0
    with pytest.raises(ValueError):
        linkage.agglomerate(pairs(spark, square), "single")


def test_clusters_that_hold_together_in_time(spark):
    rows = [("x", d, float(m)) for d, m in zip(range(1, 13), [0, 0, 0, 0, 9, 9, 9, 9, 0, 0, 0, 0], strict=True)]
    features = spark.createDataFrame(rows, "dataset string, day int, mean double")
    by = {w: [r["label"] for r in linkage.temporal_clusters(features, ["mean"], k, w).orderBy("day").collect()] for w, k in ((0.0, 2), (0.6, 3))}
    assert by[0.6] == [0] * 4 + [1] * 4 + [2] * 4 and by[0.0] == [0] * 4 + [1] * 4 + [0] * 4
