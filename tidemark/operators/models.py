"""Agreement and ranking of models, ranking of datasets, clusters of days."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


WEIGHTS = {"n_significant": 0.30, "effect": 0.30, "stability": 0.20, "mass": 0.20}


def _by_series(df: DataFrame) -> tuple[DataFrame, bool]:
    """With a series_id, and whether it had one: a table without is one series."""
    return (df, True) if "series_id" in df.columns else (df.withColumn("series_id", F.lit("")), False)


def agreement(points: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(series_id, model_id, consensus, density, n_cp, stability) of change points (series_id, model_id, cp as a share of the
    series): nearness of the nearest change point of any other model of the series, mean nearness of all of theirs, and the
    mean of both. Only points of one series meet, and a series has few."""
    points, had = _by_series(points)
    o = points.select("series_id", F.col("model_id").alias("other"), F.col("cp").alias("q"))
    near = F.exp(-F.pow((F.col("cp") - F.col("q")) / tolerance, 2))
    each = points.join(o, "series_id").where(F.col("model_id") != F.col("other")).groupBy("series_id", "model_id", "cp").agg(F.max(near).alias("c"), F.avg(near).alias("d"))
    m = each.groupBy("series_id", "model_id").agg(F.avg("c").alias("consensus"), F.avg("d").alias("density"), F.count("*").alias("n_cp"))
    out = m.withColumn("stability", (F.col("consensus") + F.col("density")) / 2)
    return out if had else out.drop("series_id")


def score_models(detected: DataFrame, tolerance: float = 0.02, weights: dict[str, float] | None = None) -> DataFrame:
    """(series_id, model_id, n_cp, n_significant, effect, mass, stability, score) of each series' models that have a significant
    change point: metrics normalised over these models and weighted, and a quarter of the stability; one model has score 1.
    A metric that `weights` (by default WEIGHTS) don't name counts nothing."""
    weights = WEIGHTS if weights is None else weights
    detected, had = _by_series(detected)
    key, tested = ["series_id", "model_id"], F.col("p_value").isNotNull()
    g = detected.groupBy(*key).agg(F.count("*").alias("n_cp"), F.count_if("significant").alias("n_valid"), F.count_if(tested & F.col("significant")).alias("n_significant"), F.coalesce(F.avg(F.when(tested, F.col("cohens_d"))), F.lit(0.0)).alias("effect"), F.coalesce(F.avg("posterior"), F.lit(0.0)).alias("mass"))
    valid = g.where("n_valid > 0").drop("n_valid")
    points = detected.join(valid.select(*key), key, "left_semi").select(*key, F.col("position").alias("cp"))
    out = valid.join(agreement(points, tolerance).select(*key, "stability"), key, "left").withColumn("stability", F.coalesce("stability", F.lit(0.0)))
    total = 0.25 * F.col("stability")
    for metric, weight in weights.items():
        out = normalize(out.withColumn(f"{metric}_scaled", F.col(metric).cast("double")), f"{metric}_scaled")
        total = total + weight * F.col(f"{metric}_scaled")
    score = F.when(F.count("*").over(Window.partitionBy("series_id")) == 1, 1.0).otherwise(total)
    return out.select(*(["series_id"] if had else []), "model_id", "n_cp", "n_significant", "effect", "mass", "stability", score.alias("score"))


def rank_models(scored: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Ranks within each series. Scores within the tolerance of the best tie; ties go to fewer change points, then effect size,
    then stability."""
    scored, had = _by_series(scored)
    own = Window.partitionBy("series_id")
    tied = F.col("score") >= F.max("score").over(own) - tolerance
    even = lambda c: F.round(c, 12)
    order = own.orderBy(F.desc("tied"), F.when(F.col("tied"), F.col("n_cp")).otherwise(0), F.when(F.col("tied"), -even(F.abs("effect"))).otherwise(-even(F.col("score"))), F.desc(even(F.col("stability"))), "model_id")
    out = scored.withColumn("tied", tied).withColumn("rank", F.row_number().over(order))
    return out if had else out.drop("series_id")


def normalize(df: DataFrame, column: str) -> DataFrame:
    """Robust min-max on the 5th to 95th percentile of each series, clipped; 0.5 when there is no spread."""
    w = Window.partitionBy("series_id") if "series_id" in df.columns else Window.partitionBy()
    lo, hi = (F.percentile(column, F.lit(q)).over(w) for q in (0.05, 0.95))
    out = df.withColumns({"__lo": lo, "__hi": hi})
    lo, hi = F.col("__lo"), F.col("__hi")
    share = (F.col(column) - lo) / F.nullif(hi - lo, F.lit(0.0))
    return out.withColumn(column, F.when(hi - lo < 1e-9, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))).drop("__lo", "__hi")


def kmeans_days(features: DataFrame, k: int = 2, restarts: int = 10, seed: int = 1234, standardize: bool = False) -> DataFrame:
    """(day, label), labels by ascending mean: the best of several starts, on the features as they are or standardised."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=["mean", "std", "cv", "n_obs", "pct_severe"], outputCol="raw" if standardize else "features").transform(features)
    if standardize:
        v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    v = v.persist()
    best = min((KMeans(k=k, seed=seed + i, maxIter=500).fit(v) for i in range(restarts)), key=lambda m: m.summary.trainingCost)
    v.unpersist()
    out = best.transform(v).select("day", "mean", F.col("prediction").alias("p"))
    order = out.groupBy("p").agg(F.avg("mean").alias("m")).withColumn("label", (F.row_number().over(Window.orderBy("m", "p")) - 1).cast("int"))
    return out.join(F.broadcast(order), "p").select("day", "label")


def cluster_profile(features: DataFrame, labels: DataFrame) -> DataFrame:
    g = features.join(labels, "day").groupBy("label").agg(F.count("*").alias("n_days"), F.avg("mean").alias("avg_score"), F.avg("std").alias("std_score_daily"), F.avg("n_obs").alias("n_obs_avg"), F.min("mean").alias("min_score"), F.max("mean").alias("max_score"))
    a = F.col("avg_score")
    return g.withColumn("severity", F.when(a >= 20, "Severe").when(a >= 15, "Moderate").when(a >= 10, "Mild").otherwise("Minimal"))


def elbow(inertias: DataFrame) -> DataFrame:
    """k of the point farthest from the chord of (k, inertia), both scaled to [0, 1]."""
    w = Window.partitionBy()
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / F.nullif((F.max(c).over(w) - F.min(c).over(w)).cast("double"), F.lit(0.0))
    s = inertias.select("k", scale("k").alias("x"), scale("inertia").alias("y"))
    return s.agg(F.max_by("k", F.struct(F.round(F.abs(F.col("x") + F.col("y") - 1), 9), -F.col("k"))).alias("k"))


def linkage(distance: np.ndarray, k: int, method: str = "average") -> np.ndarray:
    """Agglomerative labels from a distance matrix by Lance-Williams updates; ties to the first pair."""
    d, n = distance.astype(float).copy(), len(distance)
    np.fill_diagonal(d, np.inf)
    if method == "ward":
        d = d**2
    size, label = np.ones(n), np.arange(n)
    for _ in range(n - k):
        i, j = divmod(int(np.argmin(d)), n)
        a, b, dij = size[i], size[j], d[i, j]
        if method == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        else:
            new = ((a + size) * d[i] + (b + size) * d[j] - size * dij) / (a + b + size)
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += b
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]
