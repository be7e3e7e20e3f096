"""What the operators share: the folder that all machines see, distributed components, sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder


def shared_dir(spark: SparkSession) -> str:
    return shared_folder(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"] or 0)


def power_of_two(n: float) -> int:
    return 1 << max(0, int(max(1, n) - 1e-9).bit_length() if n > 1 else 0)


def extended(schema: T.StructType, **more: str) -> T.StructType:
    """A schema with further columns; the given one stays as it is."""
    return T.StructType([*schema.fields, *(T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items())])


def numbered(df: DataFrame) -> DataFrame:
    """The columns as c0, c1, ..., so that no name of the input clashes with one of ours."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table has no more rows than a bound; reads no more than needed."""
    return df.limit(rows + 1).count() <= rows


def roots(pointers: DataFrame) -> DataFrame:
    """(node, label) of pointers (a, b) where b < a and each a points once: what is reached at the end of its pointers, by
    doubling; one row a node and round."""
    now = materialize(pointers.select(F.col("a").alias("node"), F.col("b").alias("label")), "roots")
    while True:
        far = now.select(F.col("node").alias("label"), F.col("label").alias("next"))
        moved = now.join(far, "label", "left").select("node", F.coalesce("next", "label").alias("label"), F.col("next").isNotNull().alias("moved"))
        now = materialize(moved, "roots")
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    now = now.drop("moved")
    return now.unionAll(now.select(F.col("label").alias("node"), "label").distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, label), label the smallest node that is reachable.

    Alternates large-star and small-star steps over a table of edges until no edge changes; each round is written to the
    shared folder. Groups are only ever reduced to their minimum, so a hub needs no task that holds all its neighbours.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        before = now
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is tied to the smallest of u and its neighbours
        large = now.join(low.withColumnRenamed("u", "v"), "v").select("u", "m").where("u <> m").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        least = large.groupBy("u").agg(F.min("m").alias("m"))
        small = large.withColumnRenamed("m", "v").join(least, "u").select(F.col("v").alias("u"), "m").where("u <> m")
        now = materialize(small.unionAll(least).distinct().withColumnRenamed("m", "v"), "edges")
        if now.count() == before.count() and now.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
