"""What moved at each change point: windows before and after, effect sizes, rank tests, contributions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .daily import FEATURES, unpivot_features


def segments(moments: DataFrame, change_points: list[int], window: int = 10, features: list[str] = FEATURES) -> DataFrame:
    """(change_point, feature, day, value, post): days in [cp - window, cp) and [cp, cp + window), the last day left out.

    Change points are few and given; they are a literal array, so that the range join is an explode of each day's own."""
    last = moments.agg(F.max("day").alias("last"))
    rows = unpivot_features(moments, features).crossJoin(F.broadcast(last))
    cps = F.filter(F.array(*map(F.lit, change_points)), lambda c: (F.col("day") >= c - window) & (F.col("day") < F.least(c + window, F.col("last"))))
    return rows.withColumn("change_point", F.explode(cps)).select("change_point", "feature", "day", "value", (F.col("day") >= F.col("change_point")).alias("post"))


def effects(parts: DataFrame) -> DataFrame:
    """Cohen's d (pooled, after minus before) and shifts for each change point and feature."""
    a, b = F.when(~F.col("post"), F.col("value")), F.when(F.col("post"), F.col("value"))
    g = parts.groupBy("change_point", "feature").agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("pre_mean"), F.avg(b).alias("post_mean"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0)))
    delta = F.col("post_mean") - F.col("pre_mean")
    d = F.coalesce(delta / F.nullif(pooled, F.lit(0.0)), F.lit(0.0))
    return g.select("change_point", "feature", "n1", "n2", "pre_mean", "post_mean", delta.alias("delta"), F.coalesce(delta * 100 / F.nullif(F.col("pre_mean"), F.lit(0.0)), F.lit(0.0)).alias("pct_change"), d.alias("cohens_d")).withColumn("interpretation", interpretation(F.col("cohens_d")))


def interpretation(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "Trivial").when(F.abs(d) < 0.5, "Small").when(F.abs(d) < 0.8, "Medium").otherwise("Large")


def mann_whitney(parts: DataFrame) -> DataFrame:
    """U of the values before, with mean ranks for ties, and z with tie and continuity corrections."""
    own = Window.partitionBy("change_point", "feature")
    ties = Window.partitionBy("change_point", "feature", "value")
    r = parts.withColumn("t", F.count("*").over(ties)).withColumn("rank", F.rank().over(own.orderBy("value")) + (F.col("t") - 1) / 2)
    g = r.groupBy("change_point", "feature").agg(F.count_if(~F.col("post")).alias("n1"), F.count_if(F.col("post")).alias("n2"), F.sum(F.when(~F.col("post"), F.col("rank"))).alias("r1"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("tie"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("tie") / (n * (n - 1))))
    most = F.greatest(F.col("u"), F.col("n1") * F.col("n2") - F.col("u"))
    return g.where("n1 > 0 AND n2 > 0").withColumn("u", u).select("change_point", "feature", "n1", "n2", "u", ((most - F.col("n1") * F.col("n2") / 2 - 0.5) / F.nullif(sd, F.lit(0.0))).alias("z"))


def permutation_exact(parts: DataFrame, size: int = 5) -> DataFrame:
    """Exact two-sided p of the difference of means, `size` values on each side of a change point: all splits."""
    near = F.row_number().over(Window.partitionBy("change_point", "feature", "post").orderBy(F.when(F.col("post"), F.col("day")).otherwise(-F.col("day")))) <= size
    g = parts.withColumn("near", near).where("near").groupBy("change_point", "feature").agg(F.array_sort(F.collect_list(F.struct("day", "value"))).alias("x")).where(F.size("x") == 2 * size)
    x = F.transform("x", lambda s: s["value"])
    g = g.select("change_point", "feature", x.alias("x"))
    masks = [list(c) for c in combinations(range(2 * size), size)]
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    first = F.aggregate(F.slice("x", 1, size), F.lit(0.0), lambda a, v: a + v)
    split = F.explode(F.array(*(F.array(*map(F.lit, m)) for m in masks)))
    s = g.withColumn("total", total).withColumn("seen", F.abs(total - 2 * first)).withColumn("m", split)
    part = F.aggregate("m", F.lit(0.0), lambda a, i: a + F.element_at("x", i + 1))
    s = s.withColumn("far", (F.abs(F.col("total") - 2 * part) >= F.col("seen") - 1e-9).cast("double"))
    return s.groupBy("change_point", "feature").agg(F.avg("far").alias("p_value"), F.count("*").alias("n_splits"))


def bh(pvalues: DataFrame, p: str = "p_value", alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni adjusted p values within the groups `by`."""
    own = Window.partitionBy(*(by or []))
    order = own.orderBy(p, *[c for c in pvalues.columns if c != p])
    r = pvalues.withColumn("m", F.count("*").over(own)).withColumn("i", F.row_number().over(order))
    after = own.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    r = r.withColumn("p_bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("i")).over(after)))
    return r.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col(p) * F.col("m"))).withColumn("significant", F.col("p_bh") < alpha).drop("m", "i")


def dominant(effect: DataFrame, threshold: float = 25.0) -> DataFrame:
    """Each feature's share of the sum of |d| at its change point, its rank, and whether the share is large."""
    own = Window.partitionBy("change_point")
    share = F.coalesce(F.abs("cohens_d") * 100 / F.nullif(F.sum(F.abs("cohens_d")).over(own), F.lit(0.0)), F.lit(0.0))
    r = effect.withColumn("contribution", share)
    rank = F.row_number().over(own.orderBy(F.desc("contribution"), "feature"))
    return r.select("change_point", "feature", "cohens_d", "contribution", rank.alias("rank"), (F.col("contribution") >= threshold).alias("is_dominant"))


def entropy(contributions: DataFrame) -> DataFrame:
    p = F.col("contribution") / 100
    g = contributions.groupBy("change_point").agg(F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).alias("entropy"), F.count("*").alias("k"))
    return g.select("change_point", "entropy", F.coalesce(F.col("entropy") / F.nullif(F.ln("k"), F.lit(0.0)), F.lit(0.0)).alias("normalized"))


def mahalanobis(parts: DataFrame, features: list[str] | None = None, ridge: float = 1e-6) -> DataFrame:
    """(change_point, distance, feature, share): the distance between the means before and after under the pooled covariance plus
    a small ridge, and each feature's share of the squared differences over their variances (0 where nothing moved).

    The covariances are aggregates, and the system is solved by elimination over columns: one row a change point, its size the
    number of features squared. Days that lack a feature are left out; a side of fewer than two days gives no row."""
    names = features or ["cv", "mean", "skewness", "pct_severe"]
    k = range(len(names))
    wide = parts.where(F.col("feature").isin(names)).groupBy("change_point", "day", "post").pivot("feature", names).agg(F.first("value")).dropna(subset=names)
    on = lambda side, f: F.when(F.col("post") == side, F.col(f))
    moments = [F.count_if(F.col("post") == side).alias(f"n{side:d}") for side in (False, True)]
    moments += [(F.avg(on(True, f)) - F.avg(on(False, f))).alias(f"z{i}") for i, f in enumerate(names)]
    moments += [F.covar_samp(on(side, names[i]), on(side, names[j])).alias(f"c{side:d}_{i}_{j}") for side in (False, True) for i in k for j in k if i <= j]
    g = wide.groupBy("change_point").agg(*moments).where("n0 >= 2 AND n1 >= 2")
    pooled = {f"s{i}_{j}": ((F.col("n0") - 1) * F.col(f"c0_{i}_{j}") + (F.col("n1") - 1) * F.col(f"c1_{i}_{j}")) / (F.col("n0") + F.col("n1") - 2) + (ridge if i == j else 0.0) for i in k for j in k if i <= j}
    g = g.withColumns(pooled)
    part = F.array(*(F.struct(F.lit(f).alias("feature"), (F.col(f"z{i}") * F.col(f"z{i}") / F.col(f"s{i}_{i}")).alias("part")) for i, f in enumerate(names)))
    g = g.select("change_point", *(f"z{i}" for i in k), *pooled, part.alias("parts"))
    for p in k[:-1]:  # the pivots stay above 0: the matrix is positive definite by its ridge
        by = {i: F.col(f"s{p}_{i}") / F.col(f"s{p}_{p}") for i in k if i > p}
        g = g.withColumns({f"z{i}": F.col(f"z{i}") - f * F.col(f"z{p}") for i, f in by.items()} | {f"s{i}_{j}": F.col(f"s{i}_{j}") - f * F.col(f"s{p}_{j}") for i, f in by.items() for j in k if i <= j})
    distance = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") / F.col(f"s{i}_{i}") for i in k), F.lit(0.0)))
    total = F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["part"])
    g = g.select("change_point", distance.alias("distance"), F.nullif(total, F.lit(0.0)).alias("total"), F.explode("parts").alias("p"))
    return g.select("change_point", "distance", "p.feature", F.coalesce(F.col("p.part") / F.col("total") * 100, F.lit(0.0)).alias("share"))


def tested(parts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Rank tests with their two-sided p value (normal, with corrections), and significance after Bonferroni over all rows."""
    from .labels import upper_tail

    u = mann_whitney(parts)
    p = F.least(F.lit(1.0), 2 * upper_tail(F.greatest(F.lit(0.0), F.coalesce("z", F.lit(0.0)))))
    m = F.count("*").over(Window.partitionBy())  # one row for each change point and feature
    return u.withColumn("p_value", p).withColumn("alpha_corrected", alpha / m).withColumn("significant", F.col("p_value") < F.col("alpha_corrected"))


def effects_with_tests(parts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Effects and tests of each change point and feature, joined."""
    t = tested(parts, alpha).select("change_point", "feature", "u", "p_value", "alpha_corrected", "significant")
    return effects(parts).join(t, ["change_point", "feature"])


def significant_effects(full: DataFrame) -> DataFrame:
    """The significant ones, by change point, the largest effect first; `place` is that order."""
    place = F.row_number().over(Window.partitionBy("change_point").orderBy(F.desc(F.round("cohens_d", 9)), "feature"))
    return full.where("significant").withColumn("place", place)


def hypotheses(full: DataFrame, contributions: DataFrame, least: float = 30.0) -> DataFrame:
    """(change_point, driver, contribution, confirmed): is each change point's first feature large enough, and significant?"""
    first = contributions.where("rank = 1").select("change_point", F.col("feature").alias("driver"), "contribution")
    t = full.select("change_point", F.col("feature").alias("driver"), "significant")
    return first.join(t, ["change_point", "driver"]).withColumn("confirmed", (F.col("contribution") >= least) & F.col("significant")).drop("significant")


def evidence(contributions: DataFrame, correlations: DataFrame, confirmed: DataFrame) -> DataFrame:
    """One row: four pieces of evidence for more than one feature at work, their number, and the verdict."""
    from .labels import verdict

    drivers = contributions.where("rank = 1").agg(F.count_distinct("feature").alias("n_drivers"))
    apart = correlations.where("(a = 'cv' OR b = 'cv') AND abs(r) < 0.5").agg(F.count("*").alias("n_independent"))
    spread = entropy(contributions).agg(F.avg("normalized").alias("mean_entropy"))
    yes = confirmed.agg(F.count_if("confirmed").alias("n_confirmed"))
    one = drivers.crossJoin(apart).crossJoin(spread).crossJoin(yes)  # one row each
    hold = ((F.col("n_drivers") > 1), (F.col("n_independent") >= 2), (F.col("mean_entropy") > 0.6), (F.col("n_confirmed") >= 2))
    return one.withColumn("evidence", sum((h.cast("int") for h in hold), F.lit(0))).withColumn("verdict", verdict(F.col("evidence")))
