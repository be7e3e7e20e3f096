"""Agglomerative clusters of many datasets at once: rounds of reciprocal nearest neighbours over a table of distances.

Ward's, complete and average linkage are reducible: two clusters that are each other's nearest stay so whatever else is merged,
so all such pairs of all datasets are merged in one round, and the tree is the one that merging pair by pair gives. A round is a
minimum by cluster, a join of the merges to both ends of the distances, and one aggregation that puts the distances of parts
together. Distances are kept once a pair (i < j); ties go to the pair of smallest i, then j.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

METHODS = ("ward", "complete", "average")


def agglomerate(distances: DataFrame, method: str = "average") -> DataFrame:
    """(dataset, left, right, height, size, round) of every merge, from distances (dataset, i, j, d) with i < j; a cluster is
    named by its smallest member. A dataset of n points has n - 1 merges."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    one = F.lit(1.0)
    # ward: v is the squared distance of centres, from which the linkage follows by the sizes
    now = stored(distances.where("i < j").select("dataset", "i", "j", (F.col("d") * F.col("d") if method == "ward" else F.col("d")).alias("v"), one.alias("ni"), one.alias("nj")), "distances")
    linked = F.col("v") * 2 * F.col("ni") * F.col("nj") / (F.col("ni") + F.col("nj")) if method == "ward" else F.col("v")
    merges, number = None, 0
    while not now.isEmpty():
        pair = F.struct("h", "i", "j", "v", "ni", "nj")
        ends = now.withColumn("h", linked).select("dataset", F.explode(F.array("i", "j")).alias("c"), pair.alias("p"))
        nearest = ends.groupBy("dataset", "c").agg(F.min("p").alias("p"))
        both = nearest.groupBy("dataset", "p").agg(F.count("*").alias("n")).where("n = 2").select("dataset", "p.*")
        both = stored(both, "merges")
        size = F.col("ni") + F.col("nj")
        done = both.select("dataset", F.col("i").alias("left"), F.col("j").alias("right"), (F.sqrt("h") if method == "ward" else F.col("h")).alias("height"), size.cast("long").alias("size"), F.lit(number).alias("round"))
        merges = done if merges is None else merges.unionAll(done)
        share = lambda part, c: F.struct(F.col(part).alias("of"), F.col("i").alias("to"), (F.col(c) / size).alias("w"), size.alias("n"), (F.col("v") * F.col("ni") * F.col("nj") / size / size).alias("within"))  # noqa: E731, B023
        moved = both.select("dataset", F.explode(F.array(share("i", "ni"), share("j", "nj"))).alias("m")).select("dataset", "m.*")
        for end in ("i", "j"):
            to = moved.select("dataset", F.col("of").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("to", "w", "n", "within")))
            now = now.join(to, ["dataset", end], "left")
        now = now.select(
            "dataset", "v", *(F.coalesce(f"{e}_to", e).alias(e) for e in "ij"), *(F.coalesce(f"{e}_n", f"n{e}").alias(f"n{e}") for e in "ij"),
            *(F.coalesce(f"{e}_w", F.lit(1.0)).alias(f"w{e}") for e in "ij"), *(F.coalesce(f"{e}_within", F.lit(0.0)).alias(f"b{e}") for e in "ij"),
        ).where("i <> j")
        swap = F.col("i") > F.col("j")
        turned = [F.when(swap, F.col(f"{a}{y}")).otherwise(F.col(f"{a}{x}")).alias(f"{a}{x}") for a in ("n", "w", "b") for x, y in ("ij", "ji")]
        now = now.select("dataset", "v", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *turned)
        weight = F.col("wi") * F.col("wj")
        joined = {"complete": F.max("v"), "average": F.sum(weight * F.col("v")), "ward": F.sum(weight * F.col("v")) - F.first("bi") - F.first("bj")}[method]
        now = stored(now.groupBy("dataset", "i", "j", "ni", "nj").agg(joined.alias("v")).select("dataset", "i", "j", "v", "ni", "nj"), "distances")
        number += 1
    if merges is None:
        kinds = {c: t for c, t in distances.dtypes}
        schema = f"dataset {kinds['dataset']}, left {kinds['i']}, right {kinds['j']}, height double, size long, round int"
        return distances.sparkSession.createDataFrame([], schema)
    return merges


def cut(points: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(dataset, i, label) of points (dataset, i) in k clusters, all points if there are fewer: the k - 1 highest merges are left
    out. Labels count from 0 by the smallest member."""
    sizes = points.groupBy("dataset").agg(F.count("*").alias("n"))
    low = Window.partitionBy("dataset").orderBy("height", "round", "left", "right")
    kept = merges.withColumn("place", F.row_number().over(low)).join(sizes, "dataset").where(F.col("place") <= F.col("n") - k)
    up = stored(kept.select("dataset", F.col("right").alias("i"), F.col("left").alias("root")), "pointers")
    while True:  # a pointer leads twice as far each time
        far = up.select("dataset", F.col("i").alias("root"), F.col("root").alias("next"))
        moved = stored(up.join(far, ["dataset", "root"], "left").select("dataset", "i", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "pointers")
        up = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    at = points.join(up, ["dataset", "i"], "left").withColumn("root", F.coalesce("root", "i"))
    return at.select("dataset", "i", (F.dense_rank().over(Window.partitionBy("dataset").orderBy("root")) - 1).alias("label"))


def temporal_distances(features: DataFrame, names: list[str], weight: float = 0.3, standardize: bool = True) -> DataFrame:
    """(dataset, i, j, d) of the days (dataset, day, features): distance in features and, by `weight`, in place in time, as a
    share of the longest. i and j are places from 0. Days are few and paired within their dataset only."""
    own, all_of = Window.partitionBy("dataset").orderBy("day"), Window.partitionBy("dataset")
    scaled = {n: (F.col(n) - F.avg(n).over(all_of)) / F.coalesce(F.nullif(F.stddev_pop(n).over(all_of), F.lit(0.0)), F.lit(1.0)) for n in names} if standardize else {}
    x = features.withColumns(scaled | {"i": F.row_number().over(own) - 1, "last": F.count("*").over(all_of) - 1})
    y = x.select("dataset", F.col("i").alias("j"), *(F.col(n).alias(f"o_{n}") for n in names))
    apart = F.sqrt(reduce(lambda a, b: a + b, ((F.col(n) - F.col(f"o_{n}")) * (F.col(n) - F.col(f"o_{n}")) for n in names)))
    time = (F.col("j") - F.col("i")) / F.greatest("last", F.lit(1))
    return x.join(y, "dataset").where("i < j").select("dataset", "i", "j", ((1 - weight) * apart + weight * time).alias("d"))


def temporal_clusters(features: DataFrame, names: list[str], k: int = 3, weight: float = 0.3, method: str = "average", standardize: bool = True) -> DataFrame:
    """(dataset, day, label) of each dataset's days in k clusters that hold together in time too."""
    place = F.row_number().over(Window.partitionBy("dataset").orderBy("day")) - 1
    days = features.select("dataset", "day", place.alias("i"))
    labels = cut(days.select("dataset", "i"), agglomerate(temporal_distances(features, names, weight, standardize), method), k)
    return days.join(labels, ["dataset", "i"]).select("dataset", "day", "label")
