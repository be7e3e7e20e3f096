"""Importance resampling of documents by hashed n-gram models.

Two generative models, of target text and of all raw text, are counts of hashed words and word pairs in BUCKETS buckets.
A document's log weight is the sum over its n-grams of the log ratio of the two; the buckets' ratios are shrunk towards 1
by PRIOR expected counts, so that n-grams too rare for the target sample say little. Gumbel noise, fixed by a hash of the
document, is added, and the documents with the k largest keys are the sample: k is the share of target rows among the
labelled rows, of all documents, unless a share is given. The exact k-th key comes from a histogram of all keys, refined
in the one bin that holds it; no sort of all rows and no list of keys on the driver.

The target model is fitted on a bounded sample of labelled rows (TARGET_ROWS, by hash order); the raw model on all rows.

Cases: null, empty or blank text has log weight 0; ties in key are broken by id, then text hash; repeated rows have equal
keys and are chosen or left one by one; with no labels or no documents the result has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from ._text import U, Words, buffers, gram_hashes, gram_mask, slices

BITS = 20
PRIOR = 8.0
TARGET_ROWS = 20_000
BINS = 4096
_PART = 1 << 15


def _buckets(words: Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words and of pairs, each with the document they are in."""
    doc = words.doc
    yield (words.hash >> U(64 - bits)).astype(np.int64), doc
    ok = gram_mask(words.first, len(words), 2)
    yield (gram_hashes(words.hash, 2)[ok] >> U(64 - bits)).astype(np.int64), doc[: len(ok)][ok]


def counts(texts: DataFrame, bits: int = BITS) -> np.ndarray:
    """Counts of all n-grams of a column of texts, by bucket: each task adds up its own, Spark the tasks'."""
    n = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            buf, off = buffers(batch.column(0))
            for i, j in slices(off):
                words = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                for b, _ in _buckets(words, bits):
                    total += np.bincount(b, minlength=n)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), _PART):
            some = at[lo : lo + _PART]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    found = texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2 ** bits rows at most
    out = np.zeros(n, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    expected = raw * (target.sum() / max(1, raw.sum()))
    return np.log((target + prior) / (expected + prior)).astype(np.float32)


def weights(documents: DataFrame, ratio: np.ndarray, seed: int = 0) -> DataFrame:
    """doc_id, h, log_weight, key."""
    bits = int(len(ratio)).bit_length() - 1
    shared = documents.sparkSession.sparkContext.broadcast(ratio)  # 4 bytes for each of a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            buf, off = buffers(batch.column(2))
            out = np.zeros(batch.num_rows)
            for i, j in slices(off):
                words = Words(buf[off[i] : off[j]], off[i : j + 1] - off[i], lower=True)
                for b, doc in _buckets(words, bits):
                    out[i:j] += np.bincount(doc, weights=table[b], minlength=j - i)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["doc_id", "h", "log_weight"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("h", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Exactly the k rows with the largest keys: whole bins of a histogram, and the rest from the bin where k falls."""
    if k <= 0:
        return scored.limit(0)
    low, high = scored.agg(F.min("key"), F.max("key")).first()
    if low is None:
        return scored.limit(0)
    kept: list = []
    rest = scored
    while True:
        width = (high - low) / BINS
        if not width > 0 or low + width == low:
            break
        b = F.least(F.floor((F.col("key") - low) / width), F.lit(BINS - 1))
        found = sorted(rest.groupBy(b.alias("b")).count().collect(), reverse=True)  # BINS rows at most
        at, taken = None, 0
        for r in found:
            if taken + r["count"] >= k:
                at, size = r["b"], r["count"]
                break
            taken += r["count"]
        if at is None:
            kept.append(rest)
            rest = None
            break
        kept.append(rest.where(b > at))
        rest, k = rest.where(b == at), k - taken
        if size == k:
            kept.append(rest)
            rest = None
            break
        if size <= 100_000:
            break
        low, high = rest.agg(F.min("key"), F.max("key")).first()
    if rest is not None:  # one bin, or rows of equal keys: those of one document count as one, and come back at the end
        each = rest.groupBy(*rest.columns).agg(F.count("*").alias("n"))
        order = Window.orderBy(F.desc("key"), "doc_id", "h")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        each = each.withColumn("n", F.least(F.col("n"), k - before)).where("n > 0")
        kept.append(each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "copy"))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionAll(part)
    return out


def target_rows(documents: DataFrame, labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """Texts of good rows, at most `most`, first in a hash order."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()
    few = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.join(F.broadcast(few), "doc_id", "left_semi").select("text")


def resample(documents: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, key of the documents that are sampled."""
    if share is None:
        seen = labels.agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good")).first()
        share = seen["good"] / seen["n"] if seen["n"] else 0.0
    ratio = log_ratio(counts(target_rows(documents, labels)), counts(documents.select("text")))
    scored = materialize(weights(documents, ratio, seed), "weights")
    return top_k(scored, round(share * scored.count())).select("doc_id", "log_weight", "key")
