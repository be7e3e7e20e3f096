"""Exact counts over a corpus without a row for each n-gram.

Documents are dealt into chunks of a few MB by a hash. A chunk sends each of its distinct n-grams once, as sorted packed
hashes, to the bucket that holds that range of hashes; the bucket adds up the counts of all chunks and answers with one
count for each n-gram that was sent, in the order it was sent. So a frequent n-gram costs one entry a chunk, whatever
its count, chunks and buckets are bounded in size, and the documents themselves are dealt out only once: both rounds and
the last pass read the same exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import power_of_two, text_bytes

U = np.uint64
CHUNK_BYTES = 4 << 20
#: Beyond so many chunks they may grow as the root of the input, so that chunks times buckets is in proportion to it; up to so many bytes.
MANY = 256
LARGEST_BYTES = 32 << 20
REQUEST = "bucket int, chunk int, kind int, tokens binary, counts binary"
REPLY = "bucket int, chunk int, kind int, counts binary"
#: Rows of kinds below 0 pass a bucket unchanged: what a chunk leaves for its own next pass.


def small(counts: np.ndarray) -> bytes:
    """Counts as compressed bytes, most of them 1; those of 255 or more follow in full."""
    import zstandard

    low = np.minimum(counts, 255).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(low.tobytes() + np.asarray(counts)[low == 255].astype("<i8").tobytes()) + len(low).to_bytes(4, "little")


def full(body: bytes) -> np.ndarray:
    import zstandard

    n, raw = int.from_bytes(body[-4:], "little"), zstandard.ZstdDecompressor().decompress(body[:-4])
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", offset=n)
    return out


def planes(packed: np.ndarray) -> bytes:
    """Sorted tokens, first bytes, second bytes and so on: the leading bytes of sorted tokens compress to little."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(packed.T).tobytes())


def unplaned(body: bytes, n: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(-1, n).T


class Layout:
    """How many chunks and buckets; both follow the bytes of text, or with `growing` chunks their root."""

    def __init__(self, total: int, chunk_bytes: int = CHUNK_BYTES, growing: bool = False):
        if growing and total > MANY * chunk_bytes:
            chunk_bytes = max(chunk_bytes, min(LARGEST_BYTES, int((total * chunk_bytes / MANY) ** 0.5)))
        self.chunks = max(1, -(-total // chunk_bytes))
        self.bits = power_of_two(self.chunks).bit_length() - 1
        self.buckets = 1 << self.bits

    def cut(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Hashes to as many leading bits as a bucket and `width` bytes hold."""
        return hashes >> U(max(0, 64 - self.bits - 8 * width))

    def send(self, chunk: int, kind: int, tokens: np.ndarray, counts: np.ndarray, width: int, out: list, check: np.ndarray | None = None) -> None:
        """Sorted distinct tokens, as cut, and their counts, to the buckets; check: four bytes more of each."""
        top = min(64, self.bits + 8 * width) - self.bits
        edges = np.searchsorted(tokens, np.arange(self.buckets, dtype=U) << U(top)) if self.bits else np.zeros(1, np.int64)
        edges = np.append(edges, len(tokens))
        rest = tokens & U((1 << top) - 1) if top < 64 else tokens
        packed = np.ascontiguousarray(rest).view(np.uint8).reshape(-1, 8)[:, :width]
        if check is not None:
            packed = np.concatenate([packed, np.ascontiguousarray(check.astype("<u4")).view(np.uint8).reshape(-1, 4)], axis=1)
        for b in range(self.buckets):
            lo, hi = int(edges[b]), int(edges[b + 1])
            if lo < hi:
                out.append((b, chunk, kind, planes(packed[lo:hi]), small(counts[lo:hi])))

    def keep(self, chunk: int, kind: int, body: bytes, out: list, bucket: int | None = None) -> None:
        out.append((chunk % self.buckets if bucket is None else bucket, chunk, -abs(kind), b"", body))


def layout(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES, growing: bool = False) -> Layout:
    return Layout(text_bytes(documents), chunk_bytes, growing)


def dealt(documents: DataFrame, plan: Layout) -> DataFrame:
    """doc_id, text, h and h2 (hashes of the row), chunk."""
    h = F.xxhash64("doc_id", "text")
    return documents.select("doc_id", "text", h.alias("h"), F.hash("text", "doc_id").alias("h2"), F.pmod(h, F.lit(plan.chunks)).cast("int").alias("chunk"))


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a chunk in the same order in every pass; rows with equal hashes are equal."""
    keys = [table.column(k).to_numpy() for k in ("h2", "h")]
    return table.take(pa.array(np.lexsort(keys)))


def rows(found: list, schema: pa.Schema) -> pa.Table:
    cols = list(zip(*found, strict=True)) if found else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


REQUEST_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary())])
REPLY_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary())])


def add_up(table: pa.Table) -> pa.Table:
    """A bucket: for each request the counts over all requests of its kind."""
    bucket, chunk, kind = (table.column(i).to_pylist() for i in range(3))
    out: list = []
    by: dict[int, list[int]] = {}
    for r, k in enumerate(kind):
        if k < 0:
            out.append((bucket[r], chunk[r], k, table.column(4)[r].as_py()))
        else:
            by.setdefault(k, []).append(r)
    for k, members in by.items():
        counts = [full(table.column(4)[r].as_py()) for r in members]
        parts = [unplaned(table.column(3)[r].as_py(), len(c)) for r, c in zip(members, counts, strict=True)]
        width = parts[0].shape[1]
        raw, each = np.concatenate(parts), np.concatenate(counts)
        wide = np.zeros((len(raw), 16 if width > 8 else 8), np.uint8)
        wide[:, :width] = raw
        keys = wide.view("<u8")
        order = np.argsort(keys[:, 0], kind="stable") if width <= 8 else np.lexsort((keys[:, 1], keys[:, 0]))
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        group = np.cumsum(new) - 1
        total = np.empty(len(keys), np.int64)
        total[order] = np.bincount(group, weights=each[order])[group].astype(np.int64)
        at = 0
        for r, c in zip(members, counts, strict=True):
            out.append((bucket[r], chunk[r], k, small(total[at : at + len(c)])))
            at += len(c)
    return rows(out, REPLY_SCHEMA)


class Replies:
    """What came back to a chunk, by kind: counts in the order of the tokens it had sent."""

    def __init__(self, table: pa.Table):
        self.found: dict[int, list[tuple[int, bytes]]] = {}
        for b, k, body in zip(*(table.column(i).to_pylist() for i in ("bucket", "kind", "counts")), strict=True):
            self.found.setdefault(k, []).append((b, body))

    def counts(self, kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(full(x) for _, x in sorted(self.found.get(kind, [])))])

    def raw(self, kind: int) -> list[tuple[int, bytes]]:
        return sorted(self.found.get(kind, []))


def ask(docs: DataFrame, request: Callable[[pa.Table, Replies | None], list], replies: DataFrame | None = None) -> DataFrame:
    """One round: requests of every chunk, added up by bucket; gives the replies."""
    if replies is None:
        sent = docs.groupBy("chunk").applyInArrow(lambda t: rows(request(ordered(t), None), REQUEST_SCHEMA), REQUEST)
    else:
        sent = docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda t, r: rows(request(ordered(t), Replies(r)) if t.num_rows else [], REQUEST_SCHEMA), REQUEST)
    return sent.groupBy("bucket").applyInArrow(add_up, REPLY)


def answer(docs: DataFrame, replies: DataFrame, finish: Callable[[pa.Table, Replies], pa.Table], schema: str, empty: pa.Schema) -> DataFrame:
    """The last pass over the chunks."""
    return docs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda t, r: finish(ordered(t), Replies(r)) if t.num_rows else empty.empty_table(), schema)
