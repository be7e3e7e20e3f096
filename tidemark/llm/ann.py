"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables has PROJECTIONS Gaussian projections, cut into cells of a width set by the spread of the data (from
a bounded sample). A query visits, in each table, PROBES buckets: its own and perturbed ones in the order of the squared
distances to the cell walls that must be crossed, the estimated order of success. Vectors and queries meet in their
buckets; distances to all vectors met are computed exactly, on the original vectors, and merged over tables.

Every vector is indexed in every table. Equal vectors are indexed up to k + 1 times, by smallest id: more can't be among
the k nearest. Buckets beyond BLOCK vectors are split into parts that each query visits. Queries that met fewer than k
vectors are searched again over all vectors, so that a result is short only if there are too few vectors.

Cases: vectors that are null, empty, zero, hold null or non-finite components, or have another length than most, take no
part; ties go to the smaller id; a null id takes no part; rows repeated whole count as one vector; an id with several vectors
is as near as the nearest of them, asked or found, and comes once in a result; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

TABLES = 12
PROJECTIONS = 6
WIDTH = 1.2
PROBES = 150
SAMPLE = 4096
BLOCK = 8192
GROUP_ROWS = 40_000


def valid(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): ids and vectors as doubles, of those that take part."""
    v = F.col(column).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (most["n"] if most else -1))


class Hashes:
    """The tables' projections, the same for the same seed and dimension."""

    def __init__(self, dim: int, width: float, tables: int, projections: int, seed: int):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, dim, projections))
        self.b = rng.uniform(0, 1, (tables, projections))
        self.width, self.tables, self.k = width, tables, projections
        self.mix = rng.integers(1, 1 << 62, (tables, projections), dtype=np.int64) * 2 + 1
        self.steps = np.array(list(product((-1, 0, 1), repeat=projections)), dtype=np.int64)

    def cells(self, v: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        f = v @ self.a[t] / self.width + self.b[t]
        whole = np.floor(f)
        return whole.astype(np.int64), f - whole

    def key(self, cells: np.ndarray, t: int) -> np.ndarray:
        h = (cells * self.mix[t]).sum(axis=-1)
        h ^= (h >> 29) & 0x7FFFFFFFF
        return h * 0x2545F4914F6CDD1D + t

    def probes(self, v: np.ndarray, t: int, most: int) -> np.ndarray:
        """Keys of the buckets to visit, (rows, probes), likeliest first."""
        cells, inside = self.cells(v, t)
        cost = np.stack([inside**2, np.zeros_like(inside), (1 - inside) ** 2], axis=1)  # down, stay, up
        total = sum(cost[:, self.steps[:, j] + 1, j] for j in range(self.k))
        best = np.argsort(total, axis=1, kind="stable")[:, :most]
        return self.key(cells[:, None, :] + self.steps[best], t)


def nearest(q: np.ndarray, ids: np.ndarray, v: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact distances in double precision; the k nearest, ties to smaller ids."""
    d = np.sqrt(((v - q) ** 2).sum(axis=1))
    d, ids = d[ids != own], ids[ids != own]
    if len(d) > 4 * k:
        few = d <= np.partition(d, k - 1)[k - 1]
        d, ids = d[few], ids[few]
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


_META = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<f8").reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values as equal numbers from 0."""
    return column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _meet(k: int):
    """Vectors and queries of a group of buckets: for each query the k nearest of all that share a bucket with it."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return _META.empty_table()
        bucket, ids, v = index.column("bucket").to_numpy(), index.column("id").to_numpy(), _vectors(index.column("v"))
        order = np.argsort(bucket, kind="stable")
        vector = _numbers(index.column("v"))[order]
        bucket, ids, v = bucket[order], ids[order], v[order]
        place = np.unique(ids, return_inverse=True)[1]
        row = vector * len(ids) + place  # one number for each id and vector
        asked = _numbers(queries.column("v"))
        qb, qid, qv = queries.column("bucket").to_numpy(), queries.column("id").to_numpy(), _vectors(queries.column("v"))
        lo, hi = np.searchsorted(bucket, qb, "left"), np.searchsorted(bucket, qb, "right")
        by: dict[tuple[int, int], list[int]] = {}
        for r in np.flatnonzero(lo < hi).tolist():
            by.setdefault((int(qid[r]), int(asked[r])), []).append(r)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for (q, _), rows in by.items():
            at = np.concatenate([np.arange(lo[r], hi[r]) for r in rows])
            at = at[np.unique(row[at], return_index=True)[1]]
            at = at[np.argsort(ids[at], kind="stable")]
            found = ids[at]
            several = len(found) > 1 and bool((found[1:] == found[:-1]).any())
            got, d = nearest(qv[rows[0]], found, v[at], q, len(at) if several else k)
            if several:  # an id with several vectors counts once, by its nearest
                near = np.sort(np.unique(got, return_index=True)[1])[:k]
                got, d = got[near], d[near]
            out.append((np.full(len(got), q), got, d))
        if not out:
            return _META.empty_table()
        return pa.table([np.concatenate(x) for x in zip(*out, strict=True)], schema=_META)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, probes: int = PROBES, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables have vec_id and embedding; a query's own id is no neighbour of it."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = valid(vectors)
    own = Window.partitionBy("v").orderBy("id")
    rows = materialize(rows.distinct().withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1).drop("r"), "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], schema)
    x = np.stack(sample["v"].to_numpy())
    spread = float(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1).mean())) or 1.0
    h = Hashes(x.shape[1], width * spread, tables, projections, seed)
    probes = min(probes, len(h.steps))

    def index(batches):
        for batch in batches:
            v, ids = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1)), batch.column(0)
            raw = pa.array([r.astype("<f8").tobytes() for r in v], pa.binary())
            for t in range(h.tables):
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(h.key(h.cells(v, t)[0], t)), ids, raw], ["bucket", "id", "v"])

    def visit(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                v = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                raw = pa.array([r.astype("<f8").tobytes() for r in v], pa.binary())
                for t in range(h.tables):
                    keys = h.probes(v, t, probes)
                    at = pa.array(np.repeat(np.arange(len(v)), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(at), raw.take(at)], ["bucket", "id", "v"])

    kind = "bucket long, id long, v binary"
    asked = valid(queries).where(F.size("v") == x.shape[1]).distinct()
    indexed, visits = rows.mapInArrow(index, kind), asked.mapInArrow(visit, kind)
    sizes = indexed.groupBy("bucket").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    groups = max(1, -(-rows.count() * tables // GROUP_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = F.coalesce("parts", F.lit(1))

    def grouped(df: DataFrame, part) -> DataFrame:
        return df.join(large, "bucket", "left").withColumn("part", part).withColumn("part", F.col("part").cast("int")).withColumn("g", F.pmod(F.xxhash64("bucket", "part"), F.lit(groups)).cast("int")).select("g", F.xxhash64("bucket", "part").alias("bucket"), "id", "v")

    left = grouped(indexed, F.pmod(F.xxhash64("id"), parts))
    right = grouped(visits, F.explode(F.sequence(F.lit(0), parts - 1)))
    met = left.groupBy("g").cogroup(right.groupBy("g")).applyInArrow(_meet(k), "query_id long, vec_id long, score double")
    met = materialize(met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "met")
    found = met.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = asked.join(found, "id", "left_anti").select(F.lit(0).cast("long").alias("bucket"), "id", F.col("v"))
    if not short.isEmpty():  # too few met: these queries go past all vectors, block by block
        def raw(batches):
            for batch in batches:
                v = batch.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.array(r, "<f8").tobytes() for r in v], pa.binary())], ["bucket", "id", "v"])

        g = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")
        all_rows = rows.select(F.lit(0).cast("long").alias("bucket"), "id", "v").mapInArrow(raw, kind).select(g, "bucket", "id", "v")
        all_short = short.mapInArrow(raw, kind).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "bucket", "id", "v")
        met = met.unionAll(all_rows.groupBy("g").cogroup(all_short.groupBy("g")).applyInArrow(_meet(k), "query_id long, vec_id long, score double")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_hundredths(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """Queries are the rows whose id is divisible by 100, against all rows."""
    return search(embeddings, embeddings.where(F.col("vec_id") % 100 == 0), k)
