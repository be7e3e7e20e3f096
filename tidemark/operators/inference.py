"""Tests of two windows and of normality, as columns: Student's t, permutations exact or by seeded shuffles, the choice among
them, and Shapiro-Wilk. parts: (change_point, feature, day, value, post); value null takes no part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import posthoc
from .labels import upper_tail

#: Lanczos' approximation of the gamma function with g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
#: Rational approximations of the normal quantile near the middle, in the tails, and far out (numerators, denominators).
_MIDDLE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3], [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3])
_TAIL = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4], [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9])
_FAR = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7], [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])
#: Royston's polynomials for the two outer weights, and for mean and deviation of the transformed statistic.
_OUTER, _NEXT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_FEW = ([-2.273, 0.459], [0.5440, -0.39978, 0.025054, -6.714e-4], [1.3822, -0.77857, 0.062767, -0.0020322])
_MANY = ([-1.5861, -0.31082, -0.083751, 0.0038915], [-0.4803, -0.082676, 0.0030302])
MOST_SHAPIRO = 5000


def _poly(c: list[float], x: Column) -> Column:
    out = F.lit(c[-1])
    for v in reversed(c[:-1]):
        out = out * x + v
    return out


def ln_gamma(z: Column) -> Column:
    """For z of 0.5 or more."""
    y = z - 1
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(total)


def _fraction(x: Column, a: Column, b: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, from the front; both ends kept away from 0."""
    safe = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
    one = F.lit(1.0)
    start = F.struct(one.alias("c"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("d"), (1 / safe(1 - (a + b) * x / (a + 1))).alias("h"), x.alias("x"), a.alias("a"), b.alias("b"))

    def half(s: Column, k: Column) -> Column:
        d, c = 1 / safe(1 + k * s["d"]), safe(1 + k / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"), s["x"].alias("x"), s["a"].alias("a"), s["b"].alias("b"))

    def step(s: Column, m: Column) -> Column:
        a, b, x = s["a"], s["b"], s["x"]
        even = half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return F.transform(F.array(even), lambda e: half(e, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))))[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["h"]


def incomplete_beta(x: Column, a: Column, b: Column, steps: int = 120) -> Column:
    """The regularised incomplete beta function for a, b of 0.5 or more and x within [0, 1]."""
    inside = F.greatest(F.lit(1e-300), F.least(F.lit(1 - 1e-16), x))
    front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(inside) + b * F.log1p(-inside))
    value = F.when(inside < (a + 1) / (a + b + 2), front * _fraction(inside, a, b, steps) / a).otherwise(1 - front * _fraction(1 - inside, b, a, steps) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(value)


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5))


def _sides(parts: DataFrame) -> DataFrame:
    a, b = F.when(~F.col("post"), F.col("value")), F.when(F.col("post"), F.col("value"))
    return parts.groupBy("change_point", "feature").agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))


def t_test(parts: DataFrame) -> DataFrame:
    """(change_point, feature, n1, n2, t, df, p_value) with equal variances, before less after; without spread t is null and p is 1
    for equal means, else 0. Fewer than two values on a side give no row."""
    g = _sides(parts).where("n1 >= 2 AND n2 >= 2").withColumn("df", (F.col("n1") + F.col("n2") - 2).cast("double"))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / F.col("df")
    t = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))), F.lit(0.0))
    g = g.withColumn("t", t)
    p = F.when(F.col("t").isNull(), (F.col("m1") == F.col("m2")).cast("double")).otherwise(t_tail(F.col("t"), F.col("df")))
    return g.select("change_point", "feature", "n1", "n2", "t", F.col("df").cast("long").alias("df"), p.alias("p_value"))


def permutation(parts: DataFrame, seed: int = 0, most: int = 100_000, shuffles: int = 10_000) -> DataFrame:
    """(change_point, feature, n1, n2, exact, n_splits, p_value): two-sided p of the difference of means. All splits if they are
    no more than `most`, else as many shuffles, each ordered by hashes of seed, shuffle and place: the same seed, the same p.
    Splits are made by each row as it is read, none is written into the plan."""
    ordered = F.array_sort(F.collect_list(F.struct("day", "value", "post")))
    g = parts.where("value IS NOT NULL").groupBy("change_point", "feature").agg(ordered.alias("s"))
    side = lambda post: F.transform(F.filter("s", lambda v: v["post"] if post else ~v["post"]), lambda v: v["value"])
    g = g.withColumns({"a": side(False), "b": side(True)}).withColumns({"n1": F.size("a"), "n2": F.size("b"), "x": F.concat("a", "b")}).where("n1 > 0 AND n2 > 0")
    n, n1, n2 = F.col("n1") + F.col("n2"), F.col("n1"), F.col("n2")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    ways = F.aggregate(F.sequence(F.lit(1), n1), F.lit(1.0), lambda s, k: s * (n2 + k) / k)
    g = g.withColumns({"total": total("x"), "seen": F.abs(total("a") / n1 - total("b") / n2), "exact": (ways <= most + 0.5) & (n <= 30)})
    far = lambda part: (F.abs(part / n1 - (F.col("total") - part) / n2) >= F.col("seen") - 1e-12).cast("double")
    bits = F.filter(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), n).cast("long") - 1), lambda m: F.bit_count(m) == n1)
    masks = g.where("exact").select("*", F.explode(bits).alias("mask"))
    picked = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.when(F.getbit("mask", i) == 1, F.col("x")[i]).otherwise(0.0))
    drawn = g.where("NOT exact").select("*", F.explode(F.sequence(F.lit(1), F.lit(shuffles))).alias("mask"))
    mixed = F.array_sort(F.transform("x", lambda v, i: F.struct(F.xxhash64(F.lit(seed), F.col("mask"), i).alias("h"), v.alias("v"))))
    shuffled = total(F.transform(F.slice(mixed, F.lit(1), n1), lambda v: v["v"]))
    keys = ["change_point", "feature", "n1", "n2", "exact"]
    each = masks.select(*keys, far(picked).alias("far")).unionAll(drawn.select(*keys, far(shuffled).alias("far")))
    return each.groupBy(*keys).agg(F.count("*").alias("n_splits"), F.avg("far").alias("p_value")).select(*keys, "n_splits", "p_value")


def chosen_tests(parts: DataFrame, seed: int = 0, least: int = 10, t_from: int | None = None) -> DataFrame:
    """(change_point, feature, test, statistic, p_value): a rank test for ten values or more on both sides that vary, Student's t
    for `t_from` or more if that is set, else permutations."""
    g = _sides(parts.where("value IS NOT NULL")).where("n1 > 0 AND n2 > 0")
    fewest, flat = F.least("n1", "n2"), F.least(F.coalesce("v1", F.lit(0.0)), F.coalesce("v2", F.lit(0.0))) < 1e-10
    name = F.when((fewest < least) | flat, "permutation")
    name = name.when(fewest >= t_from, "t") if t_from is not None else name
    g = g.select("change_point", "feature", name.otherwise("mann_whitney").alias("test"), (F.col("m1") - F.col("m2")).alias("shift"))
    key = ["change_point", "feature"]
    of = lambda test: parts.where("value IS NOT NULL").join(g.where(F.col("test") == test).select(*key), key, "left_semi")
    u = posthoc.mann_whitney(of("mann_whitney"))
    ranked = u.select(*key, F.lit("mann_whitney").alias("test"), F.col("u").cast("double").alias("statistic"), F.least(F.lit(1.0), 2 * upper_tail(F.greatest(F.lit(0.0), F.coalesce("z", F.lit(0.0))))).alias("p_value"))
    student = t_test(of("t")).select(*key, F.lit("t").alias("test"), F.col("t").alias("statistic"), "p_value")
    split = permutation(of("permutation"), seed).join(g.select(*key, "shift"), key).select(*key, F.lit("permutation").alias("test"), F.col("shift").alias("statistic"), "p_value")
    return ranked.unionAll(student).unionAll(split)


def normal_quantile(p: Column) -> Column:
    q = p - 0.5
    ratio = lambda c, r: _poly(c[0], r) / _poly(c[1], r)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    out = F.when(r <= 5, ratio(_TAIL, r - 1.6)).otherwise(ratio(_FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(_MIDDLE, 0.180625 - q * q)).otherwise(F.when(q < 0, -out).otherwise(out))


def shapiro_wilk(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, n, w, p_value) of each group: normality by Royston's approximation for 3 to 5,000 values; fewer, more, or values
    without spread give null. Ranks are a window over groups that are not too large, the rest is one aggregation."""
    x = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    sizes = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("x").alias("high"), F.min("x").alias("low"))
    fit = x.join(sizes.where((F.col("n") >= 3) & (F.col("n") <= MOST_SHAPIRO) & (F.col("high") > F.col("low"))), by)
    i, n = F.row_number().over(Window.partitionBy(*by).orderBy("x")), F.col("n")
    r = fit.withColumn("i", i).withColumn("m", normal_quantile((F.col("i") - 0.375) / (n + 0.25)))
    pick = lambda back: F.max(F.when(F.col("i") == n - back, F.col("m")))
    shift = F.col("x") - F.col("mean")
    top, second = (F.sum(F.when(F.col("i") == n - k, shift).when(F.col("i") == 1 + k, -shift)) for k in (0, 1))
    inner = F.sum(F.when((F.col("i") > 2) & (F.col("i") < n - 1), F.col("m") * shift))
    between = F.sum(F.when((F.col("i") > 1) & (F.col("i") < n), F.col("m") * shift))
    g = r.groupBy(*by, "n").agg(F.sum(F.col("m") * F.col("m")).alias("mm"), pick(0).alias("m0"), pick(1).alias("m1"), top.alias("d0"), second.alias("d1"), F.coalesce(inner, F.lit(0.0)).alias("inner"), F.coalesce(between, F.lit(0.0)).alias("between"), F.sum(shift * shift).alias("ss"))
    root, u = F.sqrt("mm"), 1 / F.sqrt(n.cast("double"))
    g = g.withColumn("a0", F.when(n == 3, math.sqrt(0.5)).otherwise(F.col("m0") / root + _poly(_OUTER, u))).withColumn("a1", F.col("m1") / root + _poly(_NEXT, u))
    a0, a1, m0, m1, mm = (F.col(c) for c in ("a0", "a1", "m0", "m1", "mm"))
    wide = F.sqrt((mm - 2 * m0 * m0 - 2 * m1 * m1) / (1 - 2 * a0 * a0 - 2 * a1 * a1))
    narrow = F.sqrt((mm - 2 * m0 * m0) / (1 - 2 * a0 * a0))
    top = a0 * F.col("d0")
    weighted = F.when(n == 3, top).when(n <= 5, top + F.col("between") / narrow).otherwise(top + a1 * F.col("d1") + F.col("inner") / wide)
    g = g.withColumn("w", F.least(F.lit(1.0), weighted * weighted / F.col("ss")))
    y = F.log(F.greatest(1 - F.col("w"), F.lit(1e-300)))
    size, large = n.cast("double"), F.log(n.cast("double"))
    gamma = _poly(_FEW[0], size)
    few = (-F.log(gamma - y) - _poly(_FEW[1], size)) / F.exp(_poly(_FEW[2], size))
    many = (y - _poly(_MANY[0], large)) / F.exp(_poly(_MANY[1], large))
    z = F.when(n <= 11, few).otherwise(many)
    tail = F.when(z >= 0, upper_tail(z)).otherwise(1 - upper_tail(-z))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    p = F.when(n == 3, three).when((n <= 11) & (y >= gamma), 0.0).otherwise(tail)
    return sizes.select(*by, "n").join(g.select(*by, "w", p.alias("p_value")), by, "left")
