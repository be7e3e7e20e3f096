"""Writers of results: tables as Parquet (and CSV where people read them), one-row summaries as JSON lines.

Folders are made by the writers; a run replaces what an earlier one wrote under the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(df: DataFrame, folder: str, name: str, csv: bool = False) -> str:
    path = f"{folder.rstrip('/')}/{name}"
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else c for c, t in df.dtypes)) if csv else df
    w = flat.write.mode("overwrite")
    w.option("header", True).csv(path) if csv else w.parquet(path)
    return path


def json(df: DataFrame, folder: str, name: str) -> str:
    """Rows as JSON lines; what isn't finite becomes null."""
    finite = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    path = f"{folder.rstrip('/')}/{name}"
    df.select(*finite).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def eda(folder: str, summary: DataFrame, clusters: DataFrame, labels: DataFrame, patterns: DataFrame, report: DataFrame) -> list[str]:
    """summary_statistics, cluster_characteristics, cluster_labels and response_pattern_analysis as CSV, analysis_summary as JSON."""
    named = {"summary_statistics": summary, "cluster_characteristics": clusters, "cluster_labels": labels, "response_pattern_analysis": patterns}
    return [table(df, folder, name, csv=True) for name, df in named.items()] + [json(report, folder, "analysis_summary")]


def comparison(folder: str, ranked: DataFrame) -> list[str]:
    return [table(ranked, folder, "dataset_comparison", csv=True), json(ranked.where("rank = 1"), folder, "recommendation")]


def validation(folder: str, checks: DataFrame, stamp: str) -> list[str]:
    """The checks under a time stamp, and as the latest."""
    return [json(checks, folder, f"validation_report_{stamp}"), json(checks, folder, "validation_report_latest")]


def detection(folder: str, detected: DataFrame, tests: DataFrame | None = None, selected: DataFrame | None = None) -> list[str]:
    """model_results (partitioned by model), change_points of all models by position, tests, diagnostics, the selection."""
    path = f"{folder.rstrip('/')}/model_results"
    detected.write.mode("overwrite").partitionBy("model_id").parquet(path)
    compared = detected.select("model_id", F.split("model_id", "_")[0].alias("method"), F.col("cp").alias("change_point_index"), F.col("position").alias("normalized_position"), F.concat(F.lit("Day_"), F.col("cp") + 1).alias("day_label"))
    found = [path, table(compared.orderBy("normalized_position", "model_id"), folder, "change_points", csv=True)]
    diagnostics = detected.groupBy("model_id").agg(F.count("*").alias("n_changepoints"), F.count_if("significant").alias("n_significant"), F.first("parameter").alias("parameter"))
    found.append(table(diagnostics, folder, "diagnostics", csv=True))
    if tests is not None:
        found.append(table(tests, folder, "statistical_tests", csv=True))
    if selected is not None:
        found.append(json(selected, folder, "best_model"))
    return found


def posthoc(folder: str, full: DataFrame, evidence: DataFrame) -> list[str]:
    return [table(full.orderBy("change_point", F.desc("cohens_d")), folder, "decomposition_full_analysis", csv=True), json(evidence, folder, "decomposition_analysis_summary")]
