"""Tests of two windows and of normality against tabulated values, hand computations and plain Python."""

import math
import statistics
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference, posthoc

PARTS = "change_point int, feature string, day int, value double, post boolean"


def parts(spark, groups):
    rows = [(cp, "f", d, v, post) for cp, (a, b) in groups.items() for post, side in ((False, a), (True, b)) for d, v in enumerate(side)]
    return spark.createDataFrame(rows, PARTS)


def test_tails_of_student_and_the_beta_function(spark):
    # tabulated two-sided critical values: t, degrees of freedom, p
    table = [(12.7062047, 1, 0.05), (4.30265273, 2, 0.05), (2.57058184, 5, 0.05), (3.16927267, 10, 0.01), (2.04227246, 30, 0.05), (0.0, 7, 1.0), (1.97189622, 200, 0.05)]
    df = spark.createDataFrame([(t, float(v), p) for t, v, p in table], "t double, df double, p double")
    for r in df.withColumn("got", inference.t_tail(F.col("t"), F.col("df"))).collect():
        assert r["got"] == pytest.approx(r["p"], abs=2e-7)
    b = spark.createDataFrame([(x, a, c) for x in (0.0, 0.1, 0.5, 0.93, 1.0) for a, c in ((1.0, 1.0), (2.0, 3.0), (5.0, 1.0))], "x double, a double, b double")
    for r in b.withColumn("got", inference.incomplete_beta(F.col("x"), F.col("a"), F.col("b"))).collect():
        n = int(r["a"] + r["b"] - 1)
        want = sum(math.comb(n, j) * r["x"] ** j * (1 - r["x"]) ** (n - j) for j in range(int(r["a"]), n + 1))
        assert r["got"] == pytest.approx(want, abs=1e-12)


def test_student_and_its_cases(spark):
    groups = {1: ([1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0]), 2: ([1.0, 1.0], [1.0, 1.0]), 3: ([1.0, 1.0], [2.0, 2.0]), 4: ([1.0], [2.0, 3.0])}
    got = {r["change_point"]: r for r in inference.t_test(parts(spark, groups)).collect()}
    a, b = groups[1]
    pooled = (3 * statistics.variance(a) + 2 * statistics.variance(b)) / 5
    assert got[1]["t"] == pytest.approx((2.5 - 4) / math.sqrt(pooled * (1 / 4 + 1 / 3))) and got[1]["df"] == 5
    assert (got[2]["p_value"], got[3]["p_value"], got[2]["t"]) == (1.0, 0.0, None) and 4 not in got


def test_permutations_exact_and_by_seed(spark):
    rng = np.random.default_rng(1)
    groups = {1: (rng.normal(size=5).tolist(), rng.normal(1, 1, 5).tolist()), 2: (rng.normal(size=3).tolist(), rng.normal(size=6).tolist()), 3: (rng.normal(size=10).tolist(), rng.normal(0.8, 1, 10).tolist()), 4: ([1.0, None], [2.0])}
    df = parts(spark, groups)
    got = {r["change_point"]: r for r in inference.permutation(df).collect()}
    for k in (1, 2):
        a, b = groups[k]
        x, seen = a + b, abs(np.mean(a) - np.mean(b))
        far = [abs(sum(x[i] for i in c) / len(a) - (sum(x) - sum(x[i] for i in c)) / len(b)) >= seen - 1e-12 for c in combinations(range(len(x)), len(a))]
        assert got[k]["exact"] and got[k]["n_splits"] == len(far) and got[k]["p_value"] == pytest.approx(np.mean(far))
    assert not got[3]["exact"] and got[3]["n_splits"] == 10_000 and got[4]["n_splits"] == 2
    again = {r["change_point"]: r["p_value"] for r in inference.permutation(df.repartition(3, "value")).collect()}
    assert again[3] == got[3]["p_value"]
    whole = inference.permutation(df.where("change_point = 3"), most=200_000).first()
    assert whole["exact"] and whole["n_splits"] == 184_756 and abs(whole["p_value"] - got[3]["p_value"]) < 0.02
    assert inference.permutation(df.limit(0)).count() == 0


def test_choice_of_the_test(spark):
    rng = np.random.default_rng(2)
    groups = {1: (rng.normal(size=12).tolist(), rng.normal(size=12).tolist()), 2: (rng.normal(size=9).tolist(), rng.normal(size=12).tolist()), 3: ([1.0] * 12, rng.normal(size=12).tolist()), 4: (rng.normal(size=31).tolist(), rng.normal(size=40).tolist())}
    name = lambda **o: {r["change_point"]: r["test"] for r in inference.chosen_tests(parts(spark, groups), **o).collect()}
    assert name() == {1: "mann_whitney", 2: "permutation", 3: "permutation", 4: "mann_whitney"}
    assert name(t_from=30) == {1: "mann_whitney", 2: "permutation", 3: "permutation", 4: "t"}


def test_normal_quantiles(spark):
    ps = [1e-12, 1e-4, 0.02, 0.3, 0.5, 0.8, 0.999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", inference.normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), abs=1e-12) for r in got)


def test_normality(spark):
    # published examples: 1 to 10, and eleven weights of men
    known = {"ten": (list(range(1, 11)), 0.97016, 0.8924), "men": ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704)}
    rng = np.random.default_rng(1)
    more = {"flat": [1.0] * 5, "two": [1.0, 2.0], "large": rng.normal(size=5001).tolist(), "normal": rng.normal(size=900).tolist(), "skewed": rng.exponential(size=300).tolist(), "three": [1.0, 2.0, 3.0], "four": [1.0, 2.0, 3.0, 4.5], "null": [None]}
    rows = [(k, None if v is None else float(v)) for k, (x, *_) in known.items() for v in x] + [(k, v) for k, x in more.items() for v in x]
    got = {r["g"]: r for r in inference.shapiro_wilk(spark.createDataFrame(rows, "g string, value double"), ["g"]).collect()}
    for k, (_, w, p) in known.items():
        assert got[k]["w"] == pytest.approx(w, abs=2e-5) and got[k]["p_value"] == pytest.approx(p, abs=2e-4)
    assert all(got[k]["w"] is None and got[k]["p_value"] is None for k in ("flat", "two", "large")) and "null" not in got
    assert got["three"]["w"] == pytest.approx(1.0) and got["three"]["p_value"] == pytest.approx(1.0) and 0.5 < got["four"]["p_value"] < 1
    assert got["normal"]["p_value"] > 0.01 and got["skewed"]["p_value"] < 1e-10


def test_mahalanobis_against_numpy(spark):
    rng = np.random.default_rng(5)
    names, rows, want = ["a", "b", "c", "flat"], [], {}
    for cp, (n0, n1) in {8: (5, 5), 15: (4, 7), 22: (1, 6), 30: (3, 3)}.items():
        x = rng.normal(size=(n0 + n1, 4)) @ rng.normal(size=(4, 4)) + 3
        x[:, 3] = 2.0
        if cp == 30:  # nothing moves
            x[n0:] = x[:n0]
        rows += [(cp, f, d, float(x[d, i]), d >= n0) for d in range(n0 + n1) for i, f in enumerate(names)]
        rows.append((cp, "a", 100, 50.0, True))  # a day that lacks features
        rows.append((cp, "other", 1, 9.0, False))
        if n0 < 2:
            continue
        pre, post = x[:n0], x[n0:]
        s = ((n0 - 1) * np.cov(pre.T) + (n1 - 1) * np.cov(post.T)) / (n0 + n1 - 2) + 1e-6 * np.eye(4)
        z = post.mean(0) - pre.mean(0)
        part = z**2 / np.diag(s)
        want |= {(cp, f): (np.sqrt(z @ np.linalg.solve(s, z)), part[i] / part.sum() * 100 if part.sum() > 0 else 0.0) for i, f in enumerate(names)}
    df = spark.createDataFrame(rows, PARTS)
    got = {(r["change_point"], r["feature"]): (r["distance"], r["share"]) for r in posthoc.mahalanobis(df, names).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6, abs=1e-6), k
    assert posthoc.mahalanobis(df.limit(0), names).count() == 0
