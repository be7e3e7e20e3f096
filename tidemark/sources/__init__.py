"""Readers: long observations (patient_id, day, score) from wide CSV, Parquet and the driver's tables; JSON sidecars."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide matrix (rows Day_<d>, columns Patient_<id>) as long rows; missing and NaN scores are left out."""
    try:
        header = spark.read.option("header", True).csv(path).columns
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise RuntimeError(f"can't read {path}") from e
    schema = f"`{header[0]}` string, " + ", ".join(f"`{c}` double" for c in header[1:])
    wide = spark.read.option("header", True).schema(schema).csv(path)
    long = wide.unpivot([header[0]], header[1:], "patient", "score").where(F.col("score").isNotNull() & ~F.isnan("score"))
    return long.select(F.regexp_extract("patient", r"_(\d+)$", 1).cast("int").alias("patient_id"), F.split(header[0], "_")[1].cast("int").alias("day"), "score")


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("patient_id").cast("int"), F.col("day").cast("int"), F.nanvl(F.col("score").cast("double"), F.lit(None).cast("double")).alias("score")).where("score IS NOT NULL")


def detection_results(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, cp, position, p_value, cohens_d, significant, posterior) from stored results, a JSON document for each model: a
    row for each change point. A point without a test has nulls; a model without points has no rows; a document without a
    model_id is an error. Points that are stored as shares become whole indices, rounded to the nearest; without tests the
    model's own word and mean posterior stand for all its points."""
    test = "change_point_index: int, normalized_position: double, p_value: double, p_value_corrected: double, cohens_d: double, significant_after_correction: boolean"
    told = f"tests: map<string, struct<{test}>>, overall_significant: boolean, summary: struct<mean_posterior_at_cp: double>"
    schema = f"model_id string, signal_length long, change_points array<double>, validation struct<{told}>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("model_id", F.coalesce("model_id", F.raise_error(F.lit("stored results need a model_id"))))
    v = F.col("validation")
    whole = (F.when(v["tests"].isNull(), v["overall_significant"]).alias("all"), v["summary"]["mean_posterior_at_cp"].alias("posterior"))
    at = docs.select("model_id", "signal_length", F.map_values(v["tests"]).alias("tests"), *whole, F.explode("change_points").alias("c"))
    cp = F.when(F.col("c") == F.floor("c"), F.col("c")).otherwise(F.round(F.col("c") * F.col("signal_length"))).cast("int")
    rows = at.withColumn("cp", cp)
    rows = rows.withColumn("test", F.get(F.filter("tests", lambda t: t["change_point_index"] == F.col("cp")), F.lit(0)))
    t = F.col("test")
    return rows.select(
        "model_id", "cp", F.coalesce(t["normalized_position"], F.col("cp") / F.col("signal_length")).alias("position"), F.coalesce(t["p_value_corrected"], t["p_value"]).alias("p_value"), t["cohens_d"].alias("cohens_d"),
        F.coalesce(t["significant_after_correction"], "all").alias("significant"), "posterior",
    )


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON sidecar as one row; pattern counts stay a map."""
    return spark.read.option("multiLine", True).schema(SIDECAR).json(path)


def sidecar_of(path: str) -> str:
    """The sidecar that belongs to a CSV file."""
    return f"{path.removesuffix('.csv')}.metadata.json"


def discover(folder: str, names: list[str], suffix: str = ".csv") -> dict[str, str]:
    """Of the named datasets those that are there, with their paths."""
    found = {n: f"{folder.rstrip('/')}/{n}{suffix}" for n in names}
    return {n: p for n, p in found.items() if os.path.exists(p)}


def together(datasets: dict[str, DataFrame]) -> DataFrame:
    """Several tables of observations as one, with their names in `dataset`."""
    out = None
    for name, df in datasets.items():
        one = df.withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no datasets")
    return out


SIDECAR = """generation_timestamp string, random_seed int, config_hash string,
study_design struct<n_patients:int,total_days:int,min_surveys_per_patient:int,max_surveys_per_patient:int>,
model_parameters struct<ar_coefficient:double,baseline_mean:double,baseline_std:double,recovery_rate_mean:double,recovery_rate_std:double,noise_std:double>,
relapse_config struct<distribution:string,probability:double,magnitude_mean:double>,
missingness_config struct<dropout_rate:double,mcar_rate:double>,
features struct<response_patterns_enabled:boolean,plateau_logic_enabled:boolean>,
response_pattern_distribution map<string,int>,
generation_statistics struct<total_observations:int,missingness_rate:double,n_observation_days:int,patients_in_plateau:int>"""


def write_wide_csv(obs: DataFrame, path: str) -> None:
    """The export in the wide format: one column for each patient that was observed, up to 10,000 of them."""
    ids = [r[0] for r in obs.select("patient_id").distinct().orderBy("patient_id").limit(10_001).collect()]
    if len(ids) > 10_000:
        raise ValueError("more patients than a wide file holds; write Parquet")
    wide = obs.groupBy("day").pivot("patient_id", ids).agg(F.first("score")).orderBy("day")
    wide.select(F.concat(F.lit("Day_"), "day").alias("Day"), *(F.col(f"`{i}`").alias(f"Patient_{i}") for i in ids)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _collapse(rows: DataFrame, keys: list, score) -> DataFrame:
    return rows.groupBy(*keys).agg(score.alias("score"))


def _week(c: str):
    return (F.floor(F.datediff(F.col(c), F.lit("1995-01-01").cast("date")) / 7) + 1).cast("int").alias("day")


def obs_orders(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet")
    return _collapse(t, [F.col("o_custkey").alias("patient_id"), _week("o_orderdate")], F.least(F.lit(27.0), F.avg("o_totalprice") * 27 / 500000))


def obs_events(spark: SparkSession, d: str, by_type: bool = False) -> DataFrame:
    """Values are added up in order of their events' ids, which is the order of the table: in another order a mean may differ in its
    last bit, and so fall on the other side of an edge, by the tasks that its rows came from."""
    t = spark.read.parquet(f"{d}/events.parquet")
    keys = ["patient_id", "day"] + ["dataset"] * by_type
    rows = t.select(F.col("user_id").alias("patient_id"), (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).alias("day"), *([F.col("event_type").alias("dataset")] * by_type), "ts", "event_id", "value")
    so_far = Window.partitionBy(*keys).orderBy("event_id", "ts", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select(*keys, F.sum("value").over(so_far).alias("sum"), F.count("value").over(so_far).alias("n"))
    return _collapse(sums, keys, F.least(F.lit(27.0), F.max_by("sum", "n") / F.nullif(F.max("n"), F.lit(0)) * 0.27))


def obs_lineitem(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    return _collapse(t, [F.col("l_suppkey").alias("patient_id"), _week("l_shipdate")], F.avg("l_quantity") * 27 / 50)
