"""How good a clustering of days is, and how many clusters to take. Days are few (a row each), so pairs of them are joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import separation


def silhouette(labelled: DataFrame, features: list[str]) -> DataFrame:
    """(dataset, silhouette, quality) with euclidean distances; -1 with fewer than two clusters; a day alone in its cluster
    counts 0. labelled: (dataset, day, label, the features)."""
    b = labelled.select("dataset", F.col("day").alias("other"), F.col("label").alias("l"), *(F.col(f).alias(f"b_{f}") for f in features))
    square = reduce(lambda x, y: x + y, ((F.col(f) - F.col(f"b_{f}")) * (F.col(f) - F.col(f"b_{f}")) for f in features))
    pairs = labelled.join(b, "dataset").withColumn("d", F.sqrt(square))
    each = pairs.groupBy("dataset", "day", "label", "l").agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    own = F.max(F.when(F.col("label") == F.col("l"), F.struct("n", (F.col("s") / F.nullif(F.col("n") - 1, F.lit(0))).alias("a"))))
    g = each.groupBy("dataset", "day").agg(own.alias("own"), F.min(F.when(F.col("label") != F.col("l"), F.col("s") / F.col("n"))).alias("b"))
    a, far = F.coalesce("own.a", F.lit(0.0)), F.col("b")
    one = F.when(F.col("own.n") == 1, 0.0).otherwise(F.coalesce((far - a) / F.nullif(F.greatest(a, far), F.lit(0.0)), F.lit(0.0)))
    out = g.groupBy("dataset").agg(F.avg(F.when(far.isNotNull(), one)).alias("silhouette")).withColumn("silhouette", F.coalesce("silhouette", F.lit(-1.0)))
    return out.withColumn("quality", separation(F.col("silhouette")))


def elbow_by_bend(costs: DataFrame) -> DataFrame:
    """(k): where the second difference of (k, inertia) is least, two places on; the least k of ties; 2 when too few."""
    w = Window.orderBy("k")
    second = F.lead("inertia", 2).over(w) - 2 * F.lead("inertia", 1).over(w) + F.col("inertia")
    bent = costs.withColumn("second", second).withColumn("then", F.lead("k", 2).over(w))
    return bent.agg(F.coalesce(F.min_by("then", F.when(F.col("second").isNotNull(), F.struct("second", "k"))), F.lit(2)).alias("k"))


def best_silhouette(scores: DataFrame) -> DataFrame:
    """(k) of the largest silhouette, the least k of ties."""
    return scores.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k"))


def choose(obs: DataFrame, largest: int = 6, restarts: int = 3, seed: int = 1234) -> DataFrame:
    """(k, inertia, silhouette, chosen) of k-means for each k on the days' features; chosen is the best silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from .daily import daily_features

    names = ["mean", "std", "cv", "n_obs", "pct_severe"]
    v = VectorAssembler(inputCols=names, outputCol="raw").transform(daily_features(obs))
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v).select("day", "features").persist()
    rows = []
    for k in range(2, largest + 1):
        best = min((KMeans(k=k, seed=seed + i, maxIter=500).fit(v) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
        wide = best.transform(v).select(F.lit("days").alias("dataset"), "day", F.col("prediction").alias("label"), *(vector_to_array("features")[i].alias(n) for i, n in enumerate(names)))
        rows.append((k, float(best.summary.trainingCost), silhouette(wide, names).first()["silhouette"]))
    v.unpersist()
    out = obs.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")  # a row for each k
    return out.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("silhouette"), "k")) == 1)
