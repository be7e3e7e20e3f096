"""Change points of many series as folds over arrays: a series is a row, its values an array (one value a day, so short).

Penalised segmentation with the l2 cost is a fold over segment ends, run for every series and penalty as a row of its own;
Bayesian run lengths are a fold over time whose state is the array of run lengths. Everything after the folds (smoothing,
thresholds, peaks, windows around change points, tests) is relational. Nothing here leaves the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import posthoc

PENALTIES = [10 ** (-2 + 3 * i / 49) for i in range(50)]
#: ln Gamma(2) - ln Gamma(3/2) - ln(3 pi) / 2: the constant of Student's t with 3 degrees of freedom.
_T3 = math.lgamma(2.0) - math.lgamma(1.5) - 0.5 * math.log(3 * math.pi)
LONGEST_RUN = 365


def arrays(signals: DataFrame) -> DataFrame:
    """(series_id, n, x): the values of each series (series_id, t, x) in order of t."""
    g = signals.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s"))
    return g.select("series_id", F.size("s").alias("n"), F.transform("s", lambda v: v["x"]).alias("x"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value worked out once and used several times within a lambda."""
    return F.transform(F.array(value), body)[0]


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Over all tasks, for rows that are few and small but costly: left alone they would be gathered by their size."""
    return df.repartition(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _prefix_sums(x: str, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(x, F.array(F.lit(0.0)), lambda s, v: F.concat(s, F.array(F.element_at(s, -1) + f(v))))


def pelt_l2(signals: DataFrame, penalties: list[float] | None = None, min_size: int = 5) -> DataFrame:
    """(series_id, n, penalty, bic, cps): the segmentation of least BIC among the penalties, the smallest of ties.

    A series shorter than two segments has no row."""
    a = arrays(signals).where(F.col("n") >= 2 * min_size).withColumn("p", _prefix_sums("x", lambda v: v)).withColumn("q", _prefix_sums("x", lambda v: v * v))
    grid = _spread(a.drop("x").withColumn("penalty", F.explode(F.array(*map(F.lit, penalties or PENALTIES)))), "series_id", "penalty")
    p, q, n, pen = (F.col(c) for c in ("p", "q", "n", "penalty"))

    def step(s: Column, j: Column) -> Column:
        def total(i: Column) -> Column:
            d = p[j] - p[i]
            return F.struct((s["best"][i] + (q[j] - q[i]) - d * d / (j - i) + pen).alias("c"), i.alias("i"))

        none = F.struct(F.lit(float("inf")).alias("c"), F.lit(0).alias("i"))
        least = F.when(j < min_size, none).otherwise(F.array_min(F.transform(F.sequence(F.lit(0), j - min_size), total)))
        return _let(least, lambda m: F.struct(F.concat(s["best"], F.array(m["c"])).alias("best"), F.concat(s["back"], F.array(m["i"])).alias("back")))

    start = F.struct(F.array(-pen).alias("best"), F.array(F.lit(0)).alias("back"))
    solved = grid.withColumn("s", F.aggregate(F.sequence(F.lit(1), n), start, step)).select("series_id", "n", "penalty", "p", "q", F.col("s.back").alias("back"))

    def before(s: Column, _: Column) -> Column:
        at = F.when(s["j"] > 0, s["back"][s["j"]]).otherwise(0)
        return _let(at, lambda b: F.struct(b.alias("j"), F.when(b > 0, F.concat(F.array(b), s["cps"])).otherwise(s["cps"]).alias("cps"), s["back"].alias("back")))

    # the fold's result is part of the state: named within the lambda it may be worked out again at each step
    walk = F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("j"), F.array().cast("array<int>").alias("cps"), F.col("back")), before)
    each = solved.withColumn("cps", walk["cps"]).withColumn("e", F.concat(F.array(F.lit(0)), "cps", F.array(n)))
    # from the segments alone, so that penalties with the same segments have the same BIC
    d = lambda c, k: c[F.element_at("e", k + 1)] - c[F.element_at("e", k)]
    length = lambda k: F.element_at("e", k + 1) - F.element_at("e", k)
    rss = F.aggregate(F.sequence(F.lit(1), F.size("cps") + 1), F.lit(0.0), lambda s, k: s + d(q, k) - d(p, k) * d(p, k) / length(k))
    each = each.withColumn("bic", n * F.log(F.greatest(rss / n, F.lit(1e-10))) + 2 * (F.size("cps") + 1) * F.log(n.cast("double")))
    best = each.groupBy("series_id", "n").agg(F.min_by(F.struct("penalty", "bic", "cps"), F.struct("bic", "penalty")).alias("best"))
    return best.select("series_id", "n", "best.penalty", "best.bic", "best.cps")


def points(segmented: DataFrame) -> DataFrame:
    """(series_id, n, cp): a row for each change point."""
    return segmented.select("series_id", "n", F.explode("cps").alias("cp"))


def rolling_variance(signals: DataFrame, width: int = 5) -> DataFrame:
    """(series_id, t, i, variance): centred sample variance of full windows; the ends take the nearest full one."""
    own, half = Window.partitionBy("series_id").orderBy("t"), width // 2
    w = own.rowsBetween(-half, half)
    v = signals.withColumn("v", F.when(F.count("x").over(w) == width, F.var_samp("x").over(w)))
    after, ago = own.rowsBetween(0, Window.unboundedFollowing), own.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.first("v", ignorenulls=True).over(after), F.last("v", ignorenulls=True).over(ago))
    return v.select("series_id", "t", (F.row_number().over(own) - 1).alias("i"), filled.alias("variance"))


def hazard(signals: DataFrame, strategy: str = "variance", low: float = 100.0, high: float = 300.0, target: int | None = None) -> DataFrame:
    """(series_id, n, hazard_lambda): expected spacing of change points, 50 at least, within [low, high].

    variance: median spacing of rough change points, where the rolling variance moves more than its 75th percentile, the
    two ends counted; autocorr: decay of the lag-1 correlation; uniform: `target` change points spread evenly."""
    clip = lambda c: F.greatest(F.lit(max(low, 50.0)), F.least(F.lit(high), c))
    sizes = signals.groupBy("series_id").agg(F.count("*").cast("int").alias("n"))
    n = F.col("n")
    if strategy == "uniform":
        k = F.lit(target) if target is not None else F.greatest(F.lit(3), F.least(F.lit(6), F.floor(n / 60)))
        return sizes.select("series_id", "n", clip(n / (k + 1)).alias("hazard_lambda"))
    own = Window.partitionBy("series_id").orderBy("t")
    if strategy == "autocorr":
        r = signals.withColumn("y", F.lead("x").over(own)).groupBy("series_id").agg(F.corr("x", "y").alias("r"))
        r = r.withColumn("r", F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("r"))))
        raw = F.when(n <= 5, n / 4).when(F.col("r") > 0.01, F.least(-1 / F.log("r"), n / 3)).otherwise(n / 5)
        return sizes.join(r, "series_id").select("series_id", "n", clip(raw).alias("hazard_lambda"))
    if strategy != "variance":
        raise ValueError(f"unknown strategy {strategy}")
    by_i = Window.partitionBy("series_id").orderBy("i")
    moved = rolling_variance(signals).withColumn("d", F.abs(F.lead("variance").over(by_i) - F.col("variance"))).where("d IS NOT NULL")
    limit = moved.groupBy("series_id").agg(F.percentile("d", F.lit(0.75)).alias("limit"))
    rough = moved.join(limit, "series_id").where("d > limit").select("series_id", "i")
    at = rough.groupBy("series_id").agg(F.count("*").alias("k"), F.array_sort(F.collect_list("i")).alias("at"))
    edges = sizes.join(at, "series_id", "left").withColumn("e", F.concat(F.array(F.lit(0)), F.coalesce("at", F.array().cast("array<int>")), F.array(n)))
    gap = F.explode(F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda j: F.col("e")[j] - F.col("e")[j - 1]))
    gaps = edges.select("series_id", "n", "k", gap.alias("gap")).groupBy("series_id", "n", "k").agg(F.percentile("gap", F.lit(0.5)).alias("gap"))
    raw = F.when(n < 10, n / 4).when(F.coalesce("k", F.lit(0)) > 1, F.col("gap")).otherwise(n / 5)
    return gaps.select("series_id", "n", clip(raw).alias("hazard_lambda"))


def predictive_hazard(signals: DataFrame, low: float = 30.0, high: float = 300.0, lambdas: int = 20, folds: int = 3, horizon: int = 10) -> DataFrame:
    """(series_id, n, hazard_lambda, score, chosen): a row for each of `lambdas` spacings, evenly spread by logarithm.

    The score is the mean log density of `horizon` held-out points under a Gaussian fitted to what precedes them, over folds
    that end their training at 70, 75, ... per cent. It doesn't depend on the spacing, so all tie and the least is chosen. A
    series too short for every fold has one row, its autocorrelation heuristic, and no score."""
    own = Window.partitionBy("series_id")
    low = max(low, 30.0)
    shares = F.explode(F.array(*(F.lit(0.7 + 0.05 * k) for k in range(folds)))).alias("share")
    rows = signals.select("series_id", "x", (F.row_number().over(own.orderBy("t")) - 1).alias("i"), F.count("*").over(own).cast("int").alias("n")).select("*", shares)
    rows = rows.withColumn("end", F.floor(F.col("n") * F.col("share"))).where(f"end < n - {horizon} AND end >= 5")
    train, test = F.when(F.col("i") < F.col("end"), F.col("x")), F.when((F.col("i") >= F.col("end")) & (F.col("i") < F.col("end") + horizon), F.col("x"))
    g = rows.groupBy("series_id", "n", "share").agg(F.avg(train).alias("mu"), (F.var_pop(train) + 1e-8).alias("var"), F.count(test).alias("m"), F.avg(test).alias("at"), F.var_pop(test).alias("spread"))
    far = F.col("m") * (F.col("spread") + (F.col("at") - F.col("mu")) ** 2)
    ll = -0.5 * far / F.col("var") - 0.5 * F.col("m") * F.log(2 * math.pi * F.col("var"))
    scored = g.groupBy("series_id", "n").agg(F.avg(ll).alias("score"))
    step = math.log10(high / low) / (lambdas - 1)
    k = F.explode(F.sequence(F.lit(0), F.lit(lambdas - 1))).alias("k")
    grid = scored.select("series_id", "n", "score", k).select("series_id", "n", F.pow(F.lit(10.0), math.log10(low) + F.col("k") * step).alias("hazard_lambda"), "score", (F.col("k") == 0).alias("chosen"))
    other = hazard(signals, "autocorr", low, high).join(scored, "series_id", "left_anti")
    return grid.unionByName(other.withColumns({"score": F.lit(None).cast("double"), "chosen": F.lit(True)}))


def run_length_posterior(signals: DataFrame, hazards: DataFrame, likelihood: str = "student_t", prior: tuple[float, float] | None = None, whole: bool = False) -> DataFrame:
    """(series_id, t, p): the probability that a run begins at position t (from 0; 0 at t = 0), with a prior (mean, variance)
    that is given or from the whole series. Series of fewer than five values have no rows."""
    # with `whole`, p is the array of all run lengths' probabilities, [1] at t = 0
    if likelihood not in ("student_t", "gaussian"):
        raise ValueError(f"unknown likelihood {likelihood}")
    a = arrays(signals).where("n >= 5").join(hazards.select("series_id", "hazard_lambda"), "series_id")
    m0 = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("n")
    if prior:
        a = a.withColumn("m0", F.lit(float(prior[0]))).withColumn("v0", F.lit(max(1e-8, float(prior[1]))))
    else:
        a = a.withColumn("m0", m0).withColumn("v0", F.greatest(F.lit(1e-8), F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("m0")) * (v - F.col("m0"))) / F.col("n")))
    a = _spread(a.withColumn("h", F.least(F.lit(0.99), 1 / F.col("hazard_lambda"))), "series_id")

    def predictive(v: Column, m: Column, s2: Column, c: Column) -> Column:
        scale = s2 * (1 + 1 / c) + 1e-8
        z = (v - m) * (v - m) / scale
        return _T3 - 0.5 * F.log(scale) - 2 * F.log1p(z / 3) if likelihood == "student_t" else -0.5 * (F.log(2 * math.pi * scale) + z)

    run = lambda l, m, v, c: F.struct(l.alias("l"), m.alias("m"), v.alias("v"), c.alias("c"))  # noqa: E731, E741
    one = F.lit(1.0)

    def step(s: Column, v: Column) -> Column:
        # the state carries the constants too: a column used within a fold may be worked out again at each step
        m0, v0, h = s["m0"], s["v0"], s["h"]

        def longer(r: Column) -> Column:
            c, d = r["c"] + 1, v - r["m"]
            m = r["m"] + d / c
            return run(r["l"] + predictive(v, r["m"], r["v"], r["c"]) + F.log(1 - h), m, F.greatest(F.lit(1e-8), (r["c"] * r["v"] + d * (v - m)) / c), c)

        # the state is normalised: its log probabilities add up to 0
        new = run(F.log(h) + predictive(v, m0, v0, one), m0, v0, one)
        runs = F.slice(F.concat(F.array(new), F.transform(s["r"], longer)), 1, LONGEST_RUN)

        def told(rs: Column, k: Column) -> Column:
            return F.transform(rs, lambda r: F.exp(r["l"] - k)) if whole else F.exp(rs[0]["l"] - k)

        def normal(rs: Column) -> Column:
            top = F.array_max(F.transform(rs, lambda r: r["l"]))
            z = _let(top, lambda t: t + F.log(F.aggregate(rs, F.lit(0.0), lambda u, r: u + F.exp(r["l"] - t))))
            return _let(z, lambda k: F.struct(F.transform(rs, lambda r: run(r["l"] - k, r["m"], r["v"], r["c"])).alias("r"), F.concat(s["p"], F.array(told(rs, k))).alias("p"), m0.alias("m0"), v0.alias("v0"), h.alias("h")))

        return _let(runs, normal)

    start = F.struct(F.array(run(F.lit(0.0), F.col("m0"), F.col("v0"), one)).alias("r"), F.array(F.array(one) if whole else F.lit(0.0)).alias("p"), F.col("m0"), F.col("v0"), F.col("h"))
    done = a.withColumn("s", F.aggregate(F.slice(F.col("x"), F.lit(2), F.col("n") - 1), start, step))
    return done.select("series_id", F.posexplode("s.p").alias("t", "p"))


def posterior_map(signals: DataFrame, likelihood: str = "student_t", strategy: str = "variance", least: float = 0.0) -> DataFrame:
    """(series_id, t, run_length, p): rows of a heat map, the probability of each run length at each position; those of p at or
    below `least` are left out. For one t all p add up to 1."""
    cells = run_length_posterior(signals, hazard(signals, strategy), likelihood, whole=True)
    return cells.select("series_id", "t", F.posexplode("p").alias("run_length", "p")).where(F.col("p") > least)


def smooth(posterior: DataFrame, sigma: float = 3.0) -> DataFrame:
    """(series_id, t, p): a Gaussian over neighbours, the ends repeated beyond themselves."""
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    own = Window.partitionBy("series_id").orderBy("t")
    whole = Window.partitionBy("series_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = posterior.withColumn("first", F.first("p").over(whole)).withColumn("last", F.last("p").over(whole))
    total = F.lit(0.0)
    for k, weight in enumerate(w):
        at = k - radius
        value = F.lead("p", at).over(own) if at >= 0 else F.lag("p", -at).over(own)
        total = total + weight / sum(w) * F.coalesce(value, F.col("last") if at > 0 else F.col("first"))
    return rows.select("series_id", "t", total.alias("p"))


def persistent_peaks(posterior: DataFrame, k: float = 1.5, persistence: int = 5) -> DataFrame:
    """(series_id, t, p, threshold, run): the highest place, the first of ties, of each run above the series' threshold that
    lasts long enough; persistence 1 takes every place above it."""
    own = Window.partitionBy("series_id")
    level = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.avg("p").over(own) + k * F.greatest(F.stddev_pop("p").over(own), F.lit(1e-6))))
    above = posterior.withColumn("threshold", level).where("p > threshold")
    island = above.withColumn("island", F.col("t") - F.row_number().over(own.orderBy("t")) if persistence > 1 else F.col("t"))
    runs = island.groupBy("series_id", "threshold", "island").agg(F.count("*").alias("run"), F.max_by(F.struct("t", "p"), F.struct(F.col("p"), -F.col("t"))).alias("top"))
    return runs.where(F.col("run") >= persistence).select("series_id", "top.t", "top.p", "threshold", "run")


def bocpd(signals: DataFrame, likelihood: str = "student_t", strategy: str = "variance", sigma: float = 3.0, persistence: int = 5) -> DataFrame:
    """(series_id, cp, posterior, threshold, hazard_lambda, n, position) of every series' persistent peaks."""
    h = hazard(signals, strategy)
    found = persistent_peaks(smooth(run_length_posterior(signals, h, likelihood), sigma), persistence=persistence)
    return found.join(h, "series_id").select("series_id", F.col("t").cast("int").alias("cp"), F.col("p").alias("posterior"), "threshold", "hazard_lambda", "n", (F.col("t") / F.col("n")).alias("position"))


def top_posterior(posterior: DataFrame, k: int = 10) -> DataFrame:
    own = Window.partitionBy("series_id").orderBy(F.desc("p"), "t")
    return posterior.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def segments(segmented: DataFrame) -> DataFrame:
    """(series_id, segment, start, end, length) between change points (series_id, n, cps)."""
    edges = F.concat(F.array(F.lit(0)), "cps", F.array("n"))
    e = segmented.select("series_id", edges.alias("e"), F.explode(F.sequence(F.lit(1), F.size("cps") + 1)).alias("k"))
    return e.select("series_id", (F.col("k") - 1).alias("segment"), F.element_at("e", F.col("k")).alias("start"), F.element_at("e", F.col("k") + 1).alias("end")).withColumn("length", F.col("end") - F.col("start"))


def indexed(signals: DataFrame) -> DataFrame:
    return signals.withColumn("i", F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1)


def segment_statistics(segmented: DataFrame, signals: DataFrame) -> DataFrame:
    """(series_id, segment, length, mean, std, variance, residual): each value belongs to the segment numbered by the change
    points up to it; residual is the sum of absolute distances from the segment's mean."""
    cps = segmented.select("series_id", "cps")
    at = F.size(F.filter("cps", lambda c: c <= F.col("i")))
    rows = indexed(signals).join(cps, "series_id").withColumn("segment", at)
    rows = rows.withColumn("mean", F.avg("x").over(Window.partitionBy("series_id", "segment")))
    return rows.groupBy("series_id", "segment", "mean").agg(F.count("*").alias("length"), F.stddev_pop("x").alias("std"), F.var_pop("x").alias("variance"), F.sum(F.abs(F.col("x") - F.col("mean"))).alias("residual"))


def validate(cps: DataFrame, signals: DataFrame, window: int = 5, least_side: int = 7, alpha: float = 0.05, least_effect: float = 0.3) -> DataFrame:
    """(series_id, cp, n, reason, p_value, p_adjusted, cohens_d, significant) of change points (series_id, n, cp).

    Rejected in this order: out of bounds, nearer than 5 % to an end, a side too short, a window too short. The others are
    tested by the exact permutation of the windows' means, corrected over their series, and need a meaningful effect."""
    cp, n = F.col("cp"), F.col("n")
    reason = F.when((cp <= 0) | (cp >= n), "out of bounds").when(cp / n < 0.05, "too early").when(cp / n > 0.95, "too late").when((cp < least_side) | (n - cp < least_side), "side too short")
    reason = F.coalesce(reason, F.when(F.least(cp, F.lit(window)) + F.least(n - cp, F.lit(window)) < 2 * window, "window too short"))
    told = cps.select("series_id", "n", "cp", reason.alias("reason"))
    tested = told.where("reason IS NULL")
    near = tested.select("series_id", "cp").join(indexed(signals), "series_id").where((F.col("i") >= cp - window) & (F.col("i") < cp + window))
    parts = near.select(F.col("cp").alias("change_point"), F.col("series_id").alias("feature"), F.col("i").alias("day"), F.col("x").alias("value"), (F.col("i") >= cp).alias("post"))
    p = posthoc.permutation_exact(parts, window)
    d = posthoc.effects(parts).select("change_point", "feature", "cohens_d")
    both = posthoc.bh(p.select("change_point", "feature", "p_value"), by=["feature"]).join(d, ["change_point", "feature"])
    out = told.join(both.select(F.col("feature").alias("series_id"), F.col("change_point").alias("cp"), "p_value", F.col("p_bh").alias("p_adjusted"), "cohens_d"), ["series_id", "cp"], "left")
    good = F.coalesce((F.col("p_adjusted") < alpha) & (F.abs("cohens_d") >= least_effect), F.lit(False))
    return out.select("series_id", "cp", "n", "reason", "p_value", "p_adjusted", "cohens_d", good.alias("significant"))


def test_summary(validated: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row a series: change points, those significant and meaningful, their share, and effects of the tested ones."""
    tested = F.col("reason").isNull()
    g = validated.groupBy("series_id").agg(F.count("*").alias("n_changepoints"), F.count_if("significant").alias("n_significant"), F.coalesce(F.avg(F.when(tested, F.col("cohens_d"))), F.lit(0.0)).alias("mean_effect_size"), F.coalesce(F.max(F.when(tested, F.abs("cohens_d"))), F.lit(0.0)).alias("max_effect_size"))
    return g.withColumn("fraction_significant", F.col("n_significant") / F.col("n_changepoints")).withColumn("overall_significant", F.col("n_significant") > 0)
