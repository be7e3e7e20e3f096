"""How many clusters of days: k-means of many datasets, numbers of clusters and reference sets at once, as joins in rounds.

Days are dealt into k slices of equal size along the first feature; then each round takes the slices' means and moves every
day to the nearest one, ties to the smaller number. A slice that loses all its days is gone. The number of rounds is a
parameter; a fit that hasn't settled by then is kept as it is. Rows with a null feature take no part; an empty table gives
no rows; equal days go to one slice after the first round. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clusters import silhouette

LARGEST, ROUNDS, RUNS = 6, 8, 4
STARTS, SETTLED = 9, 12
FIT = ["dataset", "run", "k"]


def fits(points: DataFrame, features: list[str], smallest: int = 1, largest: int = LARGEST, rounds: int = ROUNDS) -> DataFrame:
    """(dataset, run, k, day, the features, label, square: the squared distance from the day's centre) for every k."""
    had = points if "run" in points.columns else points.withColumn("run", F.lit(-1))
    base = had.select("dataset", "run", "day", *(F.col(f).cast("double").alias(f) for f in features)).dropna(subset=features)
    own = Window.partitionBy("dataset", "run")
    placed = base.withColumns({"__n": F.count("*").over(own), "__i": F.row_number().over(own.orderBy(F.round(features[0], 9), "day")) - 1})
    grid = placed.withColumn("k", F.explode(F.sequence(F.lit(smallest), F.lit(largest)))).where("k <= __n")
    at = grid.select(*FIT, "day", *features, F.expr("CAST(floor(__i * k / __n) AS INT)").alias("label"))
    days = at.drop("label")

    def far(centre: Column) -> Column:
        return reduce(lambda a, b: a + b, ((F.col(f) - centre[f]) * (F.col(f) - centre[f]) for f in features))

    for _ in range(rounds):
        means = at.groupBy(*FIT, "label").agg(*(F.avg(f).alias(f) for f in features))
        held = means.groupBy(*FIT).agg(F.collect_list(F.struct("label", *features)).alias("__means"))
        near = F.array_min(F.transform("__means", lambda c: F.struct(F.round(far(c), 9).alias("d"), c["label"].alias("label"), far(c).alias("square"))))
        at = days.join(held, FIT).withColumn("__near", near).select(*FIT, "day", *features, F.col("__near.label").alias("label"), F.col("__near.square").alias("square"))
    return at


def two_clusters(points: DataFrame, features: list[str], starts: int = STARTS, rounds: int = SETTLED) -> DataFrame:
    """(dataset, day, mean, label): k-means with two clusters, the cheapest of several starts; label 0 is the cluster of the lower
    mean of the first feature, `mean` that feature.

    Start j cuts the days along the first feature after their j-th share of `starts` + 1 equal shares. The days of a dataset
    are one window, so all rounds of all starts need a single exchange of the table of days. Ties go to label 0 and to the
    smaller start. Rows with a null feature take no part; a dataset whose days are all equal, or a single one, has label 0."""
    own, fit = Window.partitionBy("dataset"), Window.partitionBy("dataset", "run")
    base = points.select("dataset", "day", *(F.col(f).cast("double").alias(f) for f in features)).dropna(subset=features)
    placed = base.withColumns({"__n": F.count("*").over(own), "__i": F.row_number().over(own.orderBy(F.round(features[0], 9), "day")) - 1})
    at = placed.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(starts)))).withColumn("label", F.expr(f"CAST(__i * {starts + 1} >= __n * run AS INT)"))
    square = [reduce(lambda a, b: a + b, ((F.col(f) - F.col(f"__{side}_{f}")) * (F.col(f) - F.col(f"__{side}_{f}")) for f in features)) for side in (0, 1)]
    for _ in range(rounds):
        at = at.withColumns({f"__{side}_{f}": F.avg(F.when(F.col("label") == side, F.col(f))).over(fit) for side in (0, 1) for f in features})
        # a cluster without days has no mean, and no day goes to it
        at = at.withColumns({"__a": square[0], "__b": square[1]}).withColumn("label", F.coalesce((F.round("__b", 9) < F.round("__a", 9)).cast("int"), F.col("__a").isNull().cast("int")))
    at = at.withColumn("__cost", F.sum(F.when(F.col("label") == 1, F.col("__b")).otherwise(F.col("__a"))).over(fit))
    best = at.withColumn("__best", F.min(F.struct(F.round("__cost", 6), "run")).over(own)["run"]).where("run = __best")
    best = best.withColumn("__mean", F.avg(features[0]).over(Window.partitionBy("dataset", "label")))
    label = F.dense_rank().over(own.orderBy(F.round("__mean", 9), F.col("label"))) - 1
    return best.select("dataset", "day", F.col(features[0]).alias("mean"), label.alias("label"))


def inertias(fitted: DataFrame) -> DataFrame:
    """(dataset, run, k, inertia): the squared distances from the centres of the last round."""
    return fitted.groupBy(*FIT).agg(F.sum("square").alias("inertia"))


def elbows(costs: DataFrame) -> DataFrame:
    """(dataset, k) of the point farthest from the chord between the first and the last cost, both axes scaled to [0, 1]; the
    least k of ties, and 2 where all costs are equal."""
    w = Window.partitionBy("dataset")
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif((F.max(c).over(w) - F.min(c).over(w)).cast("double"), F.lit(0.0))
    s = costs.select("dataset", "k", scale("k").alias("x"), scale("inertia").alias("y"))
    return s.groupBy("dataset").agg(F.coalesce(F.max_by("k", F.when(F.col("y").isNotNull(), F.struct(F.round(F.abs(F.col("x") + F.col("y") - 1), 9).alias("d"), (-F.col("k")).alias("m")))), F.lit(2)).alias("k"))


def choose(points: DataFrame, features: list[str], largest: int = LARGEST, rounds: int = ROUNDS) -> DataFrame:
    """(dataset, k, inertia, silhouette, elbow, chosen) for k from 2: rows of an optimisation plot. elbow: k of the bend;
    chosen: k of the largest silhouette, the least of ties."""
    fitted = fits(points, features, 2, largest, rounds)
    # every fit is a dataset of its own for the silhouettes
    each = silhouette(fitted.withColumn("dataset", F.struct("dataset", "k")), features).select("dataset.dataset", "dataset.k", "silhouette")
    costs = inertias(fitted).drop("run")
    bend = elbows(costs).select("dataset", F.col("k").alias("__bend"))
    best = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(F.round("silhouette", 9)), "k")) == 1
    return costs.join(each, ["dataset", "k"]).join(bend, "dataset").select("dataset", "k", "inertia", "silhouette", (F.col("k") == F.col("__bend")).alias("elbow"), best.alias("chosen"))


def references(points: DataFrame, features: list[str], runs: int = RUNS, seed: int = 1234) -> DataFrame:
    """As many uniform rows as each dataset has, within its features' bounds, for every run: a hash of seed, run, day and
    feature is the chance, so the rows are the same each time they are worked out."""
    base = points.dropna(subset=features)
    bounds = base.groupBy("dataset").agg(*(F.min(f).cast("double").alias(f"__lo_{f}") for f in features), *(F.max(f).cast("double").alias(f"__hi_{f}") for f in features))

    def even(f: str) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "run", "dataset", "day", F.lit(f)))
        u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32
        return F.col(f"__lo_{f}") + u * (F.col(f"__hi_{f}") - F.col(f"__lo_{f}"))

    many = base.select("dataset", "day", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")).join(bounds, "dataset")
    return many.select("dataset", "run", "day", *(even(f).alias(f) for f in features))


def gap(points: DataFrame, features: list[str], largest: int = LARGEST, runs: int = RUNS, rounds: int = ROUNDS, seed: int = 1234) -> DataFrame:
    """(dataset, k, inertia, expected, spread, gap, chosen) for k from 1: the mean log cost of uniform references less the log
    cost of the days; chosen has the largest gap, the least k of ties. Every run has references of its own."""
    own = points.select("dataset", F.lit(-1).alias("run"), "day", *features)
    costs = inertias(fits(own.unionByName(references(points, features, runs, seed)), features, 1, largest, rounds))
    log, data = F.log(F.greatest("inertia", F.lit(1e-10))), F.col("run") < 0
    g = costs.groupBy("dataset", "k").agg(F.max(F.when(data, F.col("inertia"))).alias("inertia"), F.avg(F.when(~data, log)).alias("expected"), F.stddev_pop(F.when(~data, log)).alias("spread"))
    g = g.withColumn("gap", F.col("expected") - F.log(F.greatest("inertia", F.lit(1e-10))))
    best = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(F.round("gap", 9)), "k")) == 1
    return g.withColumn("chosen", best)
