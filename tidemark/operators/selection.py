"""Choosing a model by agreement: eligible models, normalised metrics, ranking, and the reason in words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .models import rank_models, score_models

STRATEGIES = ("agreement_first",)
#: Columns of the metrics by their names in the settings.
COLUMNS = {"n_significant_cps": "n_significant", "mean_effect_size": "effect", "posterior_mass": "mass", "stability_score": "stability"}


def canonical(detected: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(model_id, family, cp, position, significant, p_value, cohens_d, posterior): positions are shares of the series;
    lengths (series_id, n) turn indices without a position into one."""
    rows = detected.withColumn("family", F.split("model_id", "_")[0])
    if lengths is not None:
        rows = rows.join(F.broadcast(lengths), "series_id").withColumn("position", F.coalesce("position", F.col("cp") / F.greatest(F.col("n"), F.lit(1))))
    return rows.select("series_id", "model_id", "family", "cp", "position", "significant", "p_value", "cohens_d", "posterior")


def eligible(rows: DataFrame, families: tuple[str, ...] = ("pelt", "bocpd"), model_ids: tuple[str, ...] | None = None) -> DataFrame:
    kept = rows.where(F.col("family").isin(list(families)))
    return kept.where(F.col("model_id").isin(list(model_ids))) if model_ids else kept


def normalized(df: DataFrame, column: str, method: str = "robust") -> DataFrame:
    """robust: from the 5th to the 95th percentile, clipped; minmax; zscore; rank (0 the least, ties by the first place).
    Without spread every value is 0.5, or 0 for zscore. Within each series, if there is a series_id."""
    w, c = Window.partitionBy("series_id") if "series_id" in df.columns else Window.partitionBy(), F.col(column).cast("double")
    if method == "rank":
        n = F.count("*").over(w)
        return df.withColumn(column, F.when(n > 1, (F.rank().over(w.orderBy(column)) - 1) / (n - 1)).otherwise(0.5))
    if method == "zscore":
        return df.withColumn(column, F.coalesce((c - F.avg(c).over(w)) / F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(0.0)))
    if method == "robust":
        low, high = F.percentile(c, F.lit(0.05)).over(w), F.percentile(c, F.lit(0.95)).over(w)
    elif method == "minmax":
        low, high = F.min(c).over(w), F.max(c).over(w)
    else:
        raise ValueError(f"unknown method {method}")
    share = (c - low) / F.nullif(high - low, F.lit(0.0))
    return df.withColumn(column, F.when(high - low < 1e-9, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))))


def select(detected: DataFrame, families: tuple[str, ...] = ("pelt", "bocpd"), model_ids: tuple[str, ...] | None = None, strategy: str = "agreement_first", weights: dict[str, float] | None = None) -> DataFrame:
    """(series_id, best_model, ranking, n_candidates, n_valid, explanation), a row for each series: with no eligible or no valid
    model the first two are null and empty, and the explanation says which; a single valid model has score 1. weights of metrics,
    by their names in the settings; one that isn't named counts nothing."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if weights is not None and (unknown := sorted(set(weights) - set(COLUMNS))):
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    own = None if weights is None else {COLUMNS[k]: w for k, w in weights.items()}
    rows, key = eligible(canonical(detected), families, model_ids), ["series_id", "model_id"]
    n = rows.groupBy("series_id").agg(F.count_distinct("model_id").alias("n_candidates"))
    ranked = rank_models(score_models(rows, weights=own)).join(rows.select(*key, "family").distinct(), key)
    places = F.transform(F.array_sort(F.collect_list(F.struct(F.col("position")))), lambda s: F.format_string("%.2f%%", s["position"] * 100))
    points = rows.groupBy(*key).agg(F.slice(places, 1, 5).alias("places"))
    why = F.when(F.col("family") == "pelt", F.format_string("effect size %.2f, %d significant change points", F.col("effect"), F.col("n_significant"))).otherwise(F.format_string("posterior mass %.2f", F.col("mass")))
    line = F.struct("rank", "model_id", "score", "stability", "n_cp", why.alias("why"), "places")
    all_of = ranked.join(points, key).groupBy("series_id").agg(F.array_sort(F.collect_list(line)).alias("r"), F.count("*").alias("n_valid"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    words = F.format_string("%s has the highest score (%.3f), stability %.2f, %s, and %d change points at %s", first["model_id"], first["score"], first["stability"], first["why"], first["n_cp"], F.concat_ws(", ", first["places"]))
    words = F.when(F.col("n_valid") > 1, F.concat(words, F.format_string("; %.3f ahead of %s", first["score"] - second["score"], second["model_id"]))).otherwise(F.concat(F.lit("the only valid model: "), words))
    reason = F.when(F.col("n_candidates") == 0, "no eligible models").when(F.col("n_valid") == 0, F.format_string("none of %d models is valid", F.col("n_candidates"))).otherwise(words)
    zero = F.lit(0).cast("long")
    each = detected.select("series_id").distinct().join(n, "series_id", "left").join(all_of, "series_id", "left").withColumns({"n_candidates": F.coalesce("n_candidates", zero), "n_valid": F.coalesce("n_valid", zero)})
    ranking = F.coalesce(F.transform("r", lambda x: x["model_id"]), F.array().cast("array<string>"))
    return each.select("series_id", F.when(F.col("n_valid") > 0, first["model_id"]).alias("best_model"), ranking.alias("ranking"), "n_candidates", "n_valid", reason.alias("explanation"))
