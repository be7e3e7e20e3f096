"""Removal of every byte under a string of `length` bytes that also starts anywhere else: a sparse suffix array of the corpus.

1. Suffixes. Of the 16-byte grams that begin in the first 256 bytes of a window of 400 bytes the one of least hash is the
   window's anchor (the first of ties). Equal windows have equal anchors at equal offsets, so it is enough to sort the
   suffixes that begin at anchors, about one in 130 bytes. A suffix carries what its windows reach: up to 400 bytes to the
   right, then up to 255 to the left, read backwards. Suffixes whose first 145 bytes occur once in the corpus are left out
   beforehand, for every window of theirs holds these bytes.
2. Buckets. Splitters that Spark samples range-partition the distinct suffixes by their bytes into buckets of bounded size.
   A bucket sorts its suffixes by multikey quicksort; for each offset of the anchor, windows are equal if their right parts
   share as many bytes and their left parts too, read off the common prefixes of neighbours in both orders.
3. Boundaries. A group of suffixes with equal leading bytes at the edge of a bucket may go on in the next one. Such groups
   are compared again across the boundary, in a further round, each suffix as two with half of the offsets and so more
   leading bytes in common; at one offset a suffix is its window and equal ones are one row with a count. So a group of
   any size is spread over buckets, and no task holds it.

Equal texts are sorted once with their number; whole suffixes that recur are one row with a count, added up before they
are shuffled too. Sorting, not hashes, decides; hashes of 128 bits only name texts and suffixes.

Cases: null text is empty; texts below `length` bytes lose nothing but are listed; rows repeated whole repeat each other; a
very long text is cut in blocks, whole; a text of one short period has as many suffixes as the period; an empty table gives
no rows; doc_id may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, shared_dir
from ._text import U, buffers

LENGTH = 400
GRAM = 16
#: Bytes of suffixes in a bucket, window starts worked on at once, and segments below which quicksort hands over.
BUCKET_BYTES, BLOCK, SMALL = 32 << 20, 1 << 17, 16


def shape(length: int) -> tuple[int, int]:
    """How many offsets an anchor can have within a window (a power of two), and the bytes that an anchor's gram has."""
    if length < 4:
        raise ValueError("length must be 4 or more")
    offsets = 1 << ((length * 2 // 3).bit_length() - 1)
    return offsets, min(GRAM, length - offsets + 1)


def _gram_keys(data: np.ndarray, n: int, gram: int) -> np.ndarray:
    """For n places a hash of the gram there in the upper half and the place in the lower."""
    load = lambda at: np.ndarray((n,), "<u8", data, at, (1,)).astype(U)
    x = load(0)
    if gram < 8:
        x &= U((1 << (8 * gram)) - 1)
    else:
        x *= U(0x9E3779B97F4A7C15)
        x ^= x >> U(32)
        x += load(gram - 8)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xA0761D6478BD642B)
    x &= U(0xFFFFFFFF00000000)
    x |= np.arange(n, dtype=U)
    return x


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor, first window, last window) of each run of windows with one anchor; places count from the buffer's start."""
    reach, gram = shape(length)
    ends, found = offsets[1:], []
    total = len(buf) - length + 1
    for lo in range(0, max(0, total), BLOCK):
        hi = min(total, lo + BLOCK)
        n = hi - lo + reach - 1
        data = np.zeros(n + gram + 8, np.uint8)
        part = buf[lo : lo + n + gram + 7]
        data[: len(part)] = part
        best, span = _gram_keys(data, n, gram), 1
        while span < reach:
            best, span = np.minimum(best[:-span], best[span:]), 2 * span
        start = np.arange(lo, hi)
        text = np.searchsorted(ends, start, "right")
        inside = ends[text] - start >= length
        start, text = start[inside], text[inside]
        at = (best[inside] & U(0xFFFFFFFF)).astype(np.int64) + lo
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        found.append((text[head], at[head], start[head], start[np.append(head[1:], len(start)) - 1]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    text, at, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
    new = np.ones(len(at), bool)  # runs cut by a block
    new[1:] = (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return text[head], at[head], first[head], last[np.append(head[1:], len(at)) - 1]


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of unsigned words: three parts by a pivot of one word, the equal part goes on with the next word."""
    n, width = words.shape
    order, raw, stride = np.arange(n), words.astype(">u8").tobytes(), 8 * width
    todo = [(0, n, 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == width:
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = sorted(part.tolist(), key=lambda r, d=8 * depth: raw[r * stride + d : (r + 1) * stride])
            continue
        v = words[part, depth]
        pivot = np.sort(v[:: max(1, len(v) // 9)])[len(v[:: max(1, len(v) // 9)]) // 2]
        less, more = v < pivot, v > pivot
        a, b = int(np.count_nonzero(less)), len(v) - int(np.count_nonzero(more))
        if b - a < len(v):
            order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        todo += [(lo, lo + a, depth), (lo + a, lo + b, depth + 1), (lo + b, hi, depth)]
    return order


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Byte strings as rows of `width` bytes, ended by zeros."""
    raw = b"".join([p.ljust(width, b"\0") for p in parts])
    return np.frombuffer(raw, np.uint8).reshape(len(parts), width)


def _common(m: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bytes that each row in order shares with the one before it; none across groups."""
    out = np.zeros(len(order), np.int32)
    for lo in range(1, len(order), 8192):
        a, b = order[lo - 1 : lo + 8191][: min(8192, len(order) - lo)], order[lo : lo + 8192]
        differ = m[a] != m[b]
        out[lo : lo + 8192] = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
        out[lo : lo + 8192][group[a] != group[b]] = -1
    if len(out):
        out[0] = -1
    return out


def equal_windows(tails: list[bytes], lefts: list[bytes], group: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int) -> np.ndarray:
    """Which offsets of each suffix have a window that another suffix of its group has at the same offset: rows x width.

    At the k-th offset a window takes width - 1 - k bytes of the tail and k of the left part; lo and hi bound a suffix' own k."""
    room = 8 * max(1, -(-(width - 1) // 8))
    out, ids = np.zeros((len(tails), width), bool), []
    for parts in (tails, lefts):
        m = _matrix(parts, room)
        words = np.concatenate([group.astype(U)[:, None], m.view(">u8").astype(U)], axis=1)
        order = multikey_quicksort(words)
        ids.append((order, _common(m, order, group)))
    for k in range(width):
        own = np.flatnonzero((lo <= k) & (hi >= k))
        if len(own) < 2:
            continue
        pair = np.zeros(len(tails), np.int64)
        for (order, common), depth in zip(ids, (width - 1 - k, k), strict=True):
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(common < depth)
            pair = pair * (len(tails) + 1) + number
        pair = pair[own]
        by = np.argsort(pair, kind="stable")
        same = pair[by][1:] == pair[by][:-1]
        again = np.zeros(len(own), bool)
        again[by[1:][same]] = True
        again[by[:-1][same]] = True
        out[own[again], k] = True
    return out


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of true in each row."""
    edge = np.diff(np.pad(mark.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


_PLACES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("m", pa.int64()), ("at", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("core", pa.int64())])
_CUT = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("at", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("name", pa.binary()), ("suffix", pa.binary()), ("w", pa.int64())])
_SOLVED = pa.schema([("name", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("child", pa.binary()), ("suffix", pa.binary()), ("w", pa.int64())])
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _batch(schema: pa.Schema, cols) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _places(length: int):
    """Texts to their anchors, with a hash of the bytes that all windows of an anchor hold."""
    reach, _ = shape(length)
    core = length - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            buf, offsets = buffers(b.column("text"))
            h1, h2, m = (b.column(k).to_numpy() for k in ("h1", "h2", "m"))
            text, at, first, last = anchors(buf, offsets, length)
            raw = memoryview(np.ascontiguousarray(buf)).cast("B")
            for i in range(0, len(at), 1 << 17):
                t, a = text[i : i + (1 << 17)], at[i : i + (1 << 17)]
                hashes = np.array([digest(raw[x : x + core]) for x in a.tolist()], U).view(np.int64)
                yield _batch(_PLACES, [h1[t], h2[t], m[t], a - offsets[t], (a - last[i : i + len(a)]).astype(np.int32), (a - first[i : i + len(a)]).astype(np.int32), hashes])

    return run


def _name(low: int, lo: int, hi: int, body: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b"%d,%d,%d," % (low, lo, hi) + body)


def _cut(length: int):
    """Texts and their listed anchors to suffixes; a suffix that recurs within a batch carries its bytes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, known, size = [], {}, 0
            for h1, h2, m, text, listed in zip(b.column("h1").to_pylist(), b.column("h2").to_pylist(), b.column("m").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), b.column("listed"), strict=True):
                for place in listed.as_py():
                    at, lo, hi = place["at"], place["lo"], place["hi"]
                    body = text[at : at + length - lo] + text[at - hi : at][::-1]
                    name = _name(0, lo, hi, body)
                    if name in known:
                        rows[known[name]][7] += m
                        rows.append([h1, h2, at, lo, hi, name, None, 0])
                        continue
                    known[name] = len(rows)
                    rows.append([h1, h2, at, lo, hi, name, b"\0\0" + body, m])
                    size += len(body)
                    if size > BUCKET_BYTES:
                        yield _batch(_CUT, zip(*rows, strict=True))
                        rows, known, size = [], {}, 0
            if rows:
                yield _batch(_CUT, zip(*rows, strict=True))

    return run


def _solve(length: int, width: int, alone: bool):
    """A bucket of distinct suffixes (name, suffix, lo, hi, w), whose anchors have `width` offsets from the first two bytes
    on: rows of repeated offsets (child null), and of suffixes of groups at the edges as two halves."""
    lead = 2 + length - width + 1

    def halves(low: int, name: bytes, suffix: bytes, lo: int, hi: int, w: int) -> Iterator[tuple]:
        top = low + width - 1
        right_end = lead + top - lo
        right = suffix[2 : 2 + length - top] + suffix[lead:right_end]
        left = suffix[2 + length - top : lead] + suffix[right_end:]
        for first in (low, low + width // 2):
            last = first + width // 2 - 1
            a, b = max(lo, first), min(hi, last)
            if a <= b:
                body = right[: length - last] + left[:first] + right[length - last : length - a] + left[first:b]
                yield name, a, b, _name(first, a, b, body), first.to_bytes(2, "big") + body, w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        name, suffix = table.column("name").to_pylist(), table.column("suffix").to_pylist()
        lo, hi, w = (table.column(k).to_numpy() for k in ("lo", "hi", "w"))
        whole = np.flatnonzero(w > 1)
        if len(whole):
            yield _batch(_SOLVED, [[name[i] for i in whole], lo[whole], hi[whole], *([None] * len(whole) for _ in range(3))])
        if width == 1:
            return
        room = 8 * -(-max(map(len, suffix)) // 8)
        m = _matrix(suffix, room)
        order = multikey_quicksort(m.view(">u8").astype(U))
        new = np.ones(len(order), bool)
        for i in range(1, len(order), 8192):
            a, b = order[i - 1 : i + 8191][: len(order[i : i + 8192])], order[i : i + 8192]
            new[i : i + 8192] = (m[a, :lead] != m[b, :lead]).any(axis=1)
        del m
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        edge = np.zeros(len(size), bool)
        if not alone:
            edge[[0, -1]] = True
        low = np.array([int.from_bytes(suffix[i][:2], "big") for i in order])
        inner = np.flatnonzero((size[group] > 1) & ~edge[group])
        if len(inner):
            rows, base = order[inner], low[inner]
            right_end = lead + base + width - 1 - lo[rows]
            tails = [suffix[i][lead:e] for i, e in zip(rows.tolist(), right_end.tolist(), strict=True)]
            lefts = [suffix[i][e:] for i, e in zip(rows.tolist(), right_end.tolist(), strict=True)]
            mark = equal_windows(tails, lefts, group[inner], lo[rows] - base, hi[rows] - base, width)
            r, first, last = _runs(mark)
            yield _batch(_SOLVED, [[name[i] for i in rows[r]], (first + base[r]).astype(np.int32), (last + base[r]).astype(np.int32), *([None] * len(r) for _ in range(3))])
        out = [x for j in np.flatnonzero(edge[group]) for i in [int(order[j])] for x in halves(int(low[j]), name[i], suffix[i], int(lo[i]), int(hi[i]), int(w[i]))]
        if out:
            yield _batch(_SOLVED, zip(*out, strict=True))

    return run


def _bucketed(texts: DataFrame) -> DataFrame:
    """Texts as a table in buckets of their hashes, as many as the session's shuffles have parts, so that joins with places
    and with hits need not move a text again."""
    spark = texts.sparkSession
    name = f"tidemark_texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.write.bucketBy(n, "h1", "h2").format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _hashed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))


def hits(texts: DataFrame, length: int = LENGTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(h1, h2, first, last): ranges of starts of recurring strings in texts (h1, h2, m, text), m the number of equal texts."""
    reach, _ = shape(length)
    places = materialize(texts.mapInArrow(_places(length), _ddl(_PLACES)), "places")
    # written, so that a join with a core of very many places can be split
    recurring = materialize(places.groupBy("core").agg(F.sum("m").alias("n")).where("n > 1").select("core"), "recurring")
    listed = places.join(recurring, "core", "left_semi").groupBy("h1", "h2").agg(F.collect_list(F.struct("at", "lo", "hi")).alias("listed"))
    cut = materialize(texts.join(listed, ["h1", "h2"]).mapInArrow(_cut(length), _ddl(_CUT)), "suffixes")
    at, suffixes = cut.select("h1", "h2", "at", "lo", "hi", "name"), cut.where("suffix IS NOT NULL").select("name", "suffix", "lo", "hi", "w")
    found, width = None, reach
    while True:
        size = suffixes.agg(F.sum(F.octet_length("suffix").cast("long"))).first()[0] or 0
        n = max(1, -(-int(size) // bucket_bytes))
        dealt = suffixes.repartitionByRange(n, "suffix") if n > 1 else suffixes.coalesce(1)
        distinct = dealt.groupBy("suffix", "name", "lo", "hi").agg(F.sum("w").alias("w"))
        solved = materialize(distinct.mapInArrow(_solve(length, width, n == 1), _ddl(_SOLVED)), "solved")
        now = at.select("h1", "h2", "at", "name").join(solved.where("child IS NULL").select("name", "lo", "hi"), "name").select("h1", "h2", (F.col("at") - F.col("hi")).alias("first"), (F.col("at") - F.col("lo")).alias("last"))
        found = now if found is None else found.unionAll(now)
        rest = solved.where("child IS NOT NULL")
        if width == 1 or rest.isEmpty():
            return found
        at = materialize(at.select("h1", "h2", "at", "name").join(rest.select("name", "lo", "hi", "child"), "name").select("h1", "h2", "at", "lo", "hi", F.col("child").alias("name")), "places")
        suffixes, width = rest.select(F.col("child").alias("name"), "suffix", "lo", "hi", "w"), width // 2


def _spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["first"], r["last"] + length) for r in ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _finish(length: int, with_text: bool):
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("spans", _SPAN), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, sha, keeps = [], [], []
            for text, ranges in zip(b.column("text").cast(pa.large_binary()), b.column("ranges"), strict=True):
                data, cuts = text.as_py(), _spans(ranges.as_py(), length)
                edges = [0, *(x for c in cuts for x in c), len(data)]
                kept = b"".join([data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)])
                spans.append([{"start": i, "end": j} for i, j in cuts])
                sha.append(hashlib.sha256(kept).hexdigest())
                keeps.append(kept)
            yield _batch(schema, [b.column("h1"), b.column("h2"), spans, sha] + [keeps] * with_text)

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, with_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and end in bytes), and with_text kept (binary:
    what is left may begin within a character)."""
    hashed = _hashed(documents)
    long = hashed.where(F.octet_length("text") >= length)
    texts = _bucketed(long.groupBy("h1", "h2").agg(F.first("text").alias("text"), F.count("*").alias("m")))
    ranges = hits(texts, length, bucket_bytes).groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    cut = texts.select("h1", "h2", "text").join(ranges, ["h1", "h2"]).mapInArrow(_finish(length, with_text), "h1 long, h2 long, spans array<struct<start: bigint, end: bigint>>, kept_sha256 string" + ", kept binary" * with_text)
    text = F.coalesce("text", F.lit(""))
    own = hashed.select("doc_id", "h1", "h2", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"), *([text.cast("binary").alias("own")] if with_text else []))
    spans = F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>"))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = own.join(cut, ["h1", "h2"], "left").select("doc_id", "n_bytes", removed.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), spans.alias("spans"), *([F.coalesce("kept", "own").alias("kept")] if with_text else []))
    return out
