"""Penalised segmentation of many series under several costs: tables of segment costs, and a fold over them that prunes.

A cost table has a row for each start of a segment, so its work spreads over starts as well as series: a fold that lengthens the
segment by one value a step and keeps what the cost needs (the values in order for l1, kernel sums for rbf), or differences of
sums over prefixes (l2, ar). The search is a fold over ends whose state is the least cost up to each place and the starts that
can still matter. A start that costs more than the best at some end can't win at an end that leaves room for a segment after
it, so it is dropped then; nothing else is, so the result is that of the full search. Nothing here leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import detect
from .detect import PENALTIES, _let, _spread, arrays

COSTS = ("l1", "l2", "rbf", "ar")
ORDER = 4
#: Copies of a cost table that share its penalties.
SHARES = 8


def _each_end(body: Callable[[Column], Column]) -> Column:
    """An array over the ends i + 1, ..., n of segments that start at i."""
    return F.transform(F.sequence(F.col("i") + 1, F.col("n")), body)


def _prefix(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(values, F.array(zero), lambda s, v: F.concat(s, F.array(add(F.element_at(s, -1), v))))


def _l1(a: DataFrame) -> DataFrame:
    """Sums of distances from the median: the upper half of the values in order less the lower half."""

    def step(s: Column, v: Column) -> Column:
        below = F.filter(s["o"], lambda u: u <= v)
        above = F.filter(s["o"], lambda u: u > v)
        order = F.concat(below, F.array(v), above)

        def cost(o: Column) -> Column:
            half = F.floor(F.size(o) / 2).cast("int")
            total = lambda part: F.aggregate(part, F.lit(0.0), lambda t, u: t + u)
            return F.struct(o.alias("o"), F.concat(s["c"], F.array(total(F.slice(o, F.size(o) - half + 1, half)) - total(F.slice(o, F.lit(1), half)))).alias("c"))

        return _let(order, cost)

    none = F.array().cast("array<double>")
    rest = F.slice("x", F.col("i") + 1, F.col("n") - F.col("i"))
    return a.withColumn("c", F.aggregate(rest, F.struct(none.alias("o"), none.alias("c")), step)["c"])


def _l2(a: DataFrame) -> DataFrame:
    a = a.withColumn("p", _prefix(F.col("x"), F.lit(0.0), lambda s, v: s + v)).withColumn("q", _prefix(F.col("x"), F.lit(0.0), lambda s, v: s + v * v))
    p, q, i = F.col("p"), F.col("q"), F.col("i")
    return a.withColumn("c", _each_end(lambda j: q[j] - q[i] - (p[j] - p[i]) * (p[j] - p[i]) / (j - i)))


def _rbf(a: DataFrame, wide: DataFrame) -> DataFrame:
    """Length less the mean row sum of a Gaussian kernel whose width is the median squared distance of the series' values."""
    x = F.col("x")
    places = F.explode(F.sequence(F.lit(0), F.col("n") - 2))
    gaps = wide.where("n > 1").select("series_id", "n", "x", places.alias("k")).select("series_id", F.explode(F.transform(F.slice("x", F.col("k") + 2, F.col("n")), lambda v: (v - x[F.col("k")]) * (v - x[F.col("k")]))).alias("d"))
    middle = gaps.groupBy("series_id").agg(F.percentile("d", F.lit(0.5)).alias("m"))
    a = a.join(middle, "series_id", "left").withColumn("g", F.coalesce(1 / F.nullif("m", F.lit(0.0)), F.lit(1.0)))

    def step(s: Column, v: Column) -> Column:
        # the state carries the width: a column named within the fold may be worked out again at each step
        near = lambda u: F.exp(-F.greatest(F.lit(1e-2), F.least(F.lit(1e2), (u - v) * (u - v) * s["g"])))
        grown = s["k"] + 1 + 2 * F.aggregate(s["o"], F.lit(0.0), lambda t, u: t + near(u))
        m = F.size(s["o"]) + 1
        return _let(grown, lambda k: F.struct(F.concat(s["o"], F.array(v)).alias("o"), k.alias("k"), F.concat(s["c"], F.array(m - k / m)).alias("c"), s["g"].alias("g")))

    none = F.array().cast("array<double>")
    rest = F.slice("x", F.col("i") + 1, F.col("n") - F.col("i"))
    return a.withColumn("c", F.aggregate(rest, F.struct(none.alias("o"), F.lit(0.0).alias("k"), none.alias("c"), F.col("g")), step)["c"])


def _ar(a: DataFrame, order: int = ORDER) -> DataFrame:
    """Squared residuals of a regression on the last `order` values and a constant, by elimination in the matrix of sums of
    products; a direction that adds nothing is skipped. Before the start the first value stands, and the first `order` targets
    are the value at place `order`. Values are scaled by the largest, so that what counts as nothing doesn't depend on the unit."""
    large = F.array_max(F.transform("x", F.abs))
    a = a.withColumn("scale", F.coalesce(F.nullif(large, F.lit(0.0)), F.lit(1.0))).withColumn("x", F.transform("x", lambda v: v / F.col("scale")))
    x, n, m = F.col("x"), F.col("n"), order + 2
    lag = lambda t, k: F.when(t >= k, x[F.greatest(t - k, F.lit(0))]).otherwise(x[0])
    row = lambda t: F.array(*(lag(t, k) for k in range(1, order + 1)), F.lit(1.0), F.when(t < order, x[F.least(F.lit(order), n - 1)]).otherwise(x[t]))
    cells = [(r, c) for r in range(m) for c in range(r, m)]
    products = F.transform(F.sequence(F.lit(0), n - 1), lambda t: _let(row(t), lambda v: F.array(*(v[r] * v[c] for r, c in cells))))
    a = a.withColumn("s", _prefix(products, F.array(*(F.lit(0.0) for _ in cells)), lambda s, v: F.zip_with(s, v, lambda p, q: p + q)))

    def eliminate(v: Column, size: int) -> Column:
        if size == 1:
            return F.greatest(F.lit(0.0), v[0])
        place = {rc: k for k, rc in enumerate((r, c) for r in range(size) for c in range(r, size))}
        inverse = F.when(v[0] > 1e-11, 1 / v[0]).otherwise(0.0)
        left = F.array(*(v[place[r, c]] - v[r] * v[c] * inverse for r in range(1, size) for c in range(r, size)))
        return _let(left, lambda w: eliminate(w, size - 1))

    s, i, square = F.col("s"), F.col("i"), F.col("scale") * F.col("scale")
    return a.withColumn("c", _each_end(lambda j: _let(F.zip_with(s[j], s[i], lambda p, q: p - q), lambda v: eliminate(v, m)) * square))


def cost_table(signals: DataFrame, cost: str) -> DataFrame:
    """(series_id, n, i, c) for each place i from 0: c holds the costs of the segments [i, i + 1), [i, i + 2), ..., [i, n)."""
    if cost not in COSTS:
        raise ValueError(f"unknown cost {cost}")
    wide = arrays(signals.where("x IS NOT NULL"))
    starts = _spread(wide.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))), "series_id", "i")
    out = {"l1": _l1, "l2": _l2, "ar": _ar}[cost](starts) if cost != "rbf" else _rbf(starts, wide)
    return out.select("series_id", "n", "i", "c")


def tuning_curve(signals: DataFrame, cost: str = "l2", penalties: list[float] | None = None, min_size: int = 5) -> DataFrame:
    """(series_id, n, penalty, bic, cps) of the segmentation of least cost under each penalty; of equal ones the one whose
    segments start first. A series shorter than two segments has no row."""
    table = cost_table(signals, cost).where(F.col("n") >= 2 * min_size)
    whole = table.groupBy("series_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda v: v["c"]).alias("c"))
    grid = penalties or PENALTIES
    shares = F.array(*(F.array(*map(F.lit, grid[k::SHARES])) for k in range(min(SHARES, len(grid)))))
    each = _spread(whole.withColumn("share", F.explode(shares)), "series_id", "share").select("series_id", "n", "c", F.explode("share").alias("penalty"))
    n, c, never = F.col("n"), F.col("c"), F.lit((1 << 31) - 1)

    def step(s: Column, j: Column) -> Column:
        fresh = F.when(j - min_size >= min_size, F.array(F.struct((j - min_size).alias("i"), never.alias("until")))).otherwise(F.array().cast("array<struct<i:int,until:int>>"))
        price = lambda a: s["best"][a["i"]] + c[a["i"]][j - a["i"] - 1]
        # medians tie exactly, and the sums of their costs but for rounding: equal to ten digits goes to the smaller start
        priced = F.transform(F.concat(s["alive"], fresh), lambda a: _let(price(a), lambda v: F.struct(F.rint(v * 1e10).alias("k"), a["i"].alias("i"), v.alias("v"), a["until"].alias("until"))))

        def settle(found: Column) -> Column:
            def keep(top: Column) -> Column:
                best = top["v"] + s["pen"]
                aged = F.transform(found, lambda a: F.struct(a["i"].alias("i"), F.when(a["v"] > best + 1e-9, F.least(a["until"], j + min_size)).otherwise(a["until"]).alias("until")))
                return F.struct(F.concat(s["best"], F.array(best)).alias("best"), F.concat(s["back"], F.array(top["i"])).alias("back"), F.filter(aged, lambda a: a["until"] > j + 1).alias("alive"), s["pen"].alias("pen"))

            return _let(F.array_min(found), keep)

        return _let(priced, settle)

    inf, zero = F.lit(float("inf")), F.lit(0)
    start = F.struct(
        F.concat(F.array(-F.col("penalty")), F.array_repeat(inf, min_size - 1)).alias("best"), F.array_repeat(zero, min_size).alias("back"),
        F.array(F.struct(zero.alias("i"), never.alias("until"))).alias("alive"), F.col("penalty").alias("pen"),
    )
    solved = each.withColumn("s", F.aggregate(F.sequence(F.lit(min_size), n), start, step)).select("series_id", "n", "penalty", F.col("s.back").alias("back"))

    def before(s: Column, _: Column) -> Column:
        at = F.when(s["j"] > 0, s["back"][s["j"]]).otherwise(0)
        return _let(at, lambda b: F.struct(b.alias("j"), F.when(b > 0, F.concat(F.array(b), s["cps"])).otherwise(s["cps"]).alias("cps"), s["back"].alias("back")))

    walk = F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("j"), F.array().cast("array<int>").alias("cps"), F.col("back")), before)
    return _with_bic(solved.withColumn("cps", walk["cps"]).drop("back"), signals)


def _with_bic(each: DataFrame, signals: DataFrame) -> DataFrame:
    """The information criterion of segments, from squared distances from their means whatever the cost was: the same number for
    the same segments."""
    sums = arrays(signals.where("x IS NOT NULL")).withColumn("p", _prefix(F.col("x"), F.lit(0.0), lambda s, v: s + v)).withColumn("q", _prefix(F.col("x"), F.lit(0.0), lambda s, v: s + v * v))
    n, p, q = F.col("n"), F.col("p"), F.col("q")
    e = each.join(sums.select("series_id", "p", "q"), "series_id").withColumn("e", F.concat(F.array(F.lit(0)), "cps", F.array(n)))
    at = lambda c, k: c[F.element_at("e", k + 1)] - c[F.element_at("e", k)]
    length = lambda k: F.element_at("e", k + 1) - F.element_at("e", k)
    rss = F.aggregate(F.sequence(F.lit(1), F.size("cps") + 1), F.lit(0.0), lambda s, k: s + at(q, k) - at(p, k) * at(p, k) / length(k))
    bic = n * F.log(F.greatest(rss / n, F.lit(1e-10))) + 2 * (F.size("cps") + 1) * F.log(n.cast("double"))
    return e.select("series_id", "n", "penalty", bic.alias("bic"), "cps")


def pelt(signals: DataFrame, cost: str = "l2", penalties: list[float] | None = None, min_size: int = 5) -> DataFrame:
    """(series_id, n, penalty, bic, cps): the segmentation of least BIC among the penalties, the smallest of ties."""
    best = tuning_curve(signals, cost, penalties, min_size).groupBy("series_id", "n").agg(F.min_by(F.struct("penalty", "bic", "cps"), F.struct("bic", "penalty")).alias("best"))
    return best.select("series_id", "n", "best.penalty", "best.bic", "best.cps")


def detected(signals: DataFrame, costs: tuple[str, ...] = COSTS, likelihoods: tuple[str, ...] = ("student_t", "gaussian"), strategy: str = "variance", penalties: list[float] | None = None, min_size: int = 5, alpha: float = 0.05, least_effect: float = 0.3, smoothing: float = 3.0, persistence: int = 5) -> DataFrame:
    """(series_id, model_id, parameter, cp, position, p_value, cohens_d, significant, reason, posterior): the change points of
    every series under every model, pelt_<cost> and bocpd_<likelihood>. Segments' change points are tested, corrected within
    their series and model; the run lengths' count as significant."""
    out = None
    if costs:
        model = lambda c: F.struct("series_id", F.lit(f"pelt_{c}").alias("model_id")).alias("series_id")
        found = None
        for c in costs:
            one = pelt(signals, c, penalties, min_size).select(model(c), "n", "penalty", F.explode("cps").alias("cp"))
            found = one if found is None else found.unionAll(one)
        found = stored(found, "change-points")
        names = F.explode(F.array(*(F.lit(f"pelt_{c}") for c in costs))).alias("model_id")
        each = signals.where("x IS NOT NULL").select("series_id", "t", "x", names).select(F.struct("series_id", "model_id").alias("series_id"), "t", "x")
        told = detect.validate(found.select("series_id", "n", "cp"), each, alpha=alpha, least_effect=least_effect).join(found.select("series_id", "cp", "penalty"), ["series_id", "cp"])
        out = told.select(
            "series_id.series_id", "series_id.model_id", F.col("penalty").alias("parameter"), "cp", (F.col("cp") / F.col("n")).alias("position"), F.col("p_value"), "cohens_d", "significant", "reason",
            F.lit(None).cast("double").alias("posterior"),
        )
    for name in likelihoods:
        none = F.lit(None)
        b = detect.bocpd(signals, name, strategy, smoothing, persistence).select(
            "series_id", F.lit(f"bocpd_{name}").alias("model_id"), F.col("hazard_lambda").alias("parameter"), "cp", "position", none.cast("double").alias("p_value"), none.cast("double").alias("cohens_d"),
            F.lit(True).alias("significant"), none.cast("string").alias("reason"), "posterior",
        )
        out = b if out is None else out.unionByName(b)
    return out
