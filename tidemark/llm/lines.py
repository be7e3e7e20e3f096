"""Line deduplication by content-defined chunks of lines.

A rolling hash over MIN_LINES lines decides where chunks lie: in each text the place of the least hash becomes a chunk,
then the least of those that overlap none taken, and so on; of equal hashes (a line or a short cycle said again and
again) the first. A line that no chunk takes stands alone and stays. Chunks are thus dense and of one length, an inserted
line moves them only near by, and a block has the same chunks wherever it stands, but for its ends. Chunks that occur more
than once anywhere are compared byte by byte; the first occurrence (by doc_id, then text hash, then place) stays and the
others are removed. What stays of a repeated block: its lines at the ends that are in a chunk with a line outside, and
lines between two chunks.

Cases: null text stays null and has no lines; empty text is one empty line; a text of fewer than MIN_LINES lines is
never changed; a very long text is cut whole, in time n log n of its lines; rows repeated whole count as one document and
are treated alike; null doc_id is a document of its own and comes first; ids may be of any type that has an order. Other
columns pass through unchanged, whatever their names (own columns begin with __line or __list).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import extended, materialize, numbered

MIN_LINES = 2
_M = (1 << 64) - 1


def chunks(data: bytes, min_lines: int = MIN_LINES) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The lines, and the chunks as ranges of lines, with the lines that stand alone; together they are the whole text."""
    import xxhash

    lines = data.split(b"\n")
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    turn = 7 * min_lines % 64
    rolled, order = 0, []
    for i, h in enumerate(hashes):
        rolled = ((rolled << 7) | (rolled >> 57)) & _M
        old = hashes[i - min_lines] if i >= min_lines else 0
        rolled ^= h ^ (((old << turn) | (old >> (64 - turn))) & _M)
        if i + 1 >= min_lines:
            order.append((rolled * 0x9E3779B97F4A7C15 & _M, i + 1 - min_lines))
    order.sort()
    taken, begins = bytearray(len(lines)), bytearray(len(lines))
    for _, i in order:
        if not any(taken[i : i + min_lines]):
            taken[i : i + min_lines] = b"\1" * min_lines
            begins[i] = 1
    out, at = [], 0
    while at < len(lines):
        end = at + (min_lines if begins[at] else 1)
        out.append((at, end))
        at = end
    return lines, out


def _emit(min_lines: int, only_listed: bool):
    """Rows of chunks: of all, hashes only; or of those listed in __line_at, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            row: list[int] = []
            at: list[int] = []
            high: list[int] = []
            low: list[int] = []
            body: list[bytes] = []
            texts = batch.column(1).cast(pa.large_binary())
            listed = batch.column(2) if only_listed else None
            for r in range(batch.num_rows):
                data = texts[r].as_py()
                if data is None:
                    continue
                lines, found = chunks(data, min_lines)
                wanted = set(listed[r].as_py()) if only_listed else None
                for k, (a, b) in enumerate(found):
                    if b - a < min_lines or (wanted is not None and k not in wanted):
                        continue
                    part = b"\n".join(lines[a:b])
                    h = xxhash.xxh3_128_intdigest(part)
                    row.append(r)
                    at.append(k)
                    high.append((h >> 64) - (1 << 63))
                    low.append((h & _M) - (1 << 63))
                    if only_listed:
                        body.append(part)
            key = batch.column(0).take(pa.array(row, pa.int32()))
            out = [key, pa.array(at, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(body, pa.binary())] if only_listed else []), ["key", "at", "h1", "h2"] + ["body"] * only_listed)

    return run


def _rewrite(batches: Iterator[pa.RecordBatch], at: int, min_lines: int) -> Iterator[pa.RecordBatch]:
    """Column number `at` is the text, the last one the list of chunks to leave out."""
    for batch in batches:
        names = batch.schema.names
        texts, gone = batch.column(at).cast(pa.large_binary()), batch.column(len(names) - 1)
        new: list[str | None] = []
        counts: list[int] = []
        removed: list[int] = []
        for t, g in zip(texts, gone, strict=True):
            data, drop = t.as_py(), g.as_py()
            if data is None:
                new.append(None)
                counts.append(0)
                removed.append(0)
                continue
            if not drop:
                new.append(data.decode())
                counts.append(data.count(b"\n") + 1)
                removed.append(0)
                continue
            lines, found = chunks(data, min_lines)
            out = set(drop)
            kept = [x for k, (a, b) in enumerate(found) if k not in out for x in lines[a:b]]
            new.append(b"\n".join(kept).decode())
            counts.append(len(lines))
            removed.append(len(lines) - len(kept))
        cols = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
        cols[at] = pa.array(new, pa.string())
        yield pa.RecordBatch.from_arrays(cols, [*names[:-1], "__line_n", "__line_removed"])


def dedup(documents: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """All columns of the documents, text without repeated chunks, and __line_n and __line_removed."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    kind = f"struct<id:{documents.schema['doc_id'].dataType.simpleString()},text:bigint>"
    hashed = documents.select(key.alias("key"), "text").mapInArrow(_emit(min_lines, False), f"key {kind}, at int, h1 long, h2 long")
    hashed = materialize(hashed, "chunks")
    repeated = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    listed = hashed.join(repeated, ["h1", "h2"]).groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("__line_at"))
    rows = documents.withColumn("__line_id", F.col("doc_id")).withColumn("__line_key", F.xxhash64("text"))

    def with_lists(left: DataFrame, lists: DataFrame, name: str) -> DataFrame:
        right = lists.select(F.col("key.id").alias("__list_id"), F.col("key.text").alias("__list_key"), name)
        return left.join(right, F.col("__line_id").eqNullSafe(F.col("__list_id")) & (F.col("__line_key") == F.col("__list_key")), "left").drop("__list_id", "__list_key")

    texts = with_lists(rows.select("__line_id", "__line_key", key.alias("key"), "text"), listed, "__line_at").where(F.col("__line_at").isNotNull())
    bodies = texts.select("key", "text", "__line_at").mapInArrow(_emit(min_lines, True), f"key {kind}, at int, h1 long, h2 long, body binary")
    bodies = materialize(bodies, "bodies")
    place = F.struct("key", "at")
    first = bodies.groupBy("h1", "h2", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = bodies.join(first, ["h1", "h2", "body"]).where(F.struct(F.col("key"), F.col("at")) != F.col("first"))
    gone = later.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("__line_gone"))
    full = numbered(with_lists(rows, gone, "__line_gone").drop("__line_id", "__line_key"))
    at, named = documents.columns.index("text"), numbered(documents)
    done = full.mapInArrow(lambda batches: _rewrite(batches, at, min_lines), extended(named.schema, __line_n="long", __line_removed="long"))
    return done.toDF(*documents.columns, "__line_n", "__line_removed")


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and kept_bytes."""
    done = dedup(documents.select("doc_id", "text"))
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return done.select("doc_id", F.col("__line_n").alias("n_lines"), F.col("__line_removed").alias("n_removed"), F.sha2(text, 256).alias("kept_sha256"), F.octet_length(text).cast("long").alias("kept_bytes"))


def without_repeats(documents: DataFrame) -> DataFrame:
    """The documents, text without repeated chunks; n_chars, where there is one, follows the text."""
    done = dedup(documents).drop("__line_n", "__line_removed")
    if "n_chars" in documents.columns:
        done = done.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return done
