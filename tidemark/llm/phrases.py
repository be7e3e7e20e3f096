"""Removal of passages that recur anywhere in the corpus, down to single words.

1. Anchors: of the 8-word hashes in a window of `length` words the smallest one is its anchor. Equal windows have equal
   anchors, so only windows whose anchor occurs at two places or more can recur. A region is a run of such windows.
2. Passages: the windows of all regions are counted over the corpus (96 bits of hash); runs of windows that occur twice or
   more are the recurring passages. One table, shared by all documents, holds each of them once, by its words.
3. Automata: the table is dealt into shards of bounded size, each compiled into an Aho-Corasick automaton over words. The
   regions of all documents stream through the shards that hold one of their passages, whichever document a passage came
   from; every word inside an occurrence goes. Text outside regions can hold no occurrence, so it stays where it is. A
   shard whose passages are in very many regions is compiled once for each slice of them, so no passage is too frequent.

Long passages are compiled in pieces of 128 words or more. All windows of a piece recur, so its occurrences go too, and
an automaton is never deeper than two pieces: repetitive texts take time in proportion to their length.

Cases: null text has no words; texts of fewer words than a window lose nothing; rows repeated whole repeat their windows
like any other copies; a very long text is one document of its chunk, which grows by it; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks as C
from ._shared import materialize
from ._text import U, Words, buffers, gram_hashes

LENGTH = 35
ANCHOR = 8
PIECE = 128
#: Bytes of passages in a shard, and of regions that stream through one of its automata.
SHARD_BYTES, STREAM_BYTES = 4 << 20, 8 << 20
FOUND = pa.schema([("chunk", pa.int32()), ("lo", pa.int32()), ("region", pa.string()), ("passages", pa.list_(pa.string()))])
HITS = pa.schema([("chunk", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest value of each `width` consecutive ones."""
    at = np.arange(len(values))
    best, span = at, 1
    while 2 * span <= width:
        a, b = best[:-span], best[span:]
        best, span = np.where(values[b] < values[a], b, a), 2 * span
    if span < width:
        step = width - span
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
    return best


def _windows(text: pa.ChunkedArray, length: int, anchor: int):
    """The words, the starts of windows within documents, and the place of each window's anchor."""
    words = Words(*buffers(text))
    n, first = len(words), words.first
    inside = np.zeros(max(0, n - length + 1), bool)
    if len(inside):
        ends = np.repeat(first[1:], words.counts)
        inside = ends[: len(inside)] - np.arange(len(inside)) >= length
    starts = np.flatnonzero(inside)
    grams = gram_hashes(words.hash, anchor)
    if not len(starts):
        return words, starts, starts, grams
    return words, starts, _sliding_least(grams, length - anchor + 1)[starts], grams


def _hashes(words: Words, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.uint32)
    return gram_hashes(words.hash, length)[starts], (gram_hashes(words.hashed(2), length)[starts] >> U(32)).astype(np.uint32)


def _distinct(h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, number of its distinct pair for each, and first of each distinct pair, all in sorted order."""
    order = np.lexsort((check, h))
    a, b = h[order], check[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _runs(words: Words, starts: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Runs of recurring windows one word apart: (document, first word, word after the last)."""
    if not len(starts):
        return []
    doc = np.searchsorted(words.first, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] != starts[:-1] + 1) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(starts)) - 1
    return list(zip(doc[begin].tolist(), starts[begin].tolist(), (starts[last] + length).tolist(), strict=True))


def _pieces(n: int, piece: int) -> list[tuple[int, int]]:
    """Ranges that together cover n words: one if n is below two pieces, else of `piece` words each."""
    if n < 2 * piece:
        return [(0, n)]
    return [(i, i + piece) for i in (*range(0, n - piece, piece), n - piece)]


def locate(passages: list[str], regions: list[str], piece: int = PIECE) -> list[np.ndarray]:
    """Which words of each region lie in an occurrence of a passage; both are words joined by single blanks."""
    import ahocorasick

    ids: dict[str, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for passage in passages:
        words = tuple([ids.setdefault(w, len(ids) + 1) for w in passage.split(" ")])
        for i, j in _pieces(len(words), piece):
            automaton.add_word(words[i:j], j - i)
    automaton.make_automaton()
    out = []
    for region in regions:
        words = tuple([ids.get(w, 0) for w in region.split(" ")])
        edge = np.zeros(len(words) + 1, np.int64)
        for end, n in automaton.iter(words) if passages else ():
            edge[end + 1 - n] += 1
            edge[end + 1] -= 1
        out.append(np.cumsum(edge[:-1]) > 0)
    return out


def _ranges(mark: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _occurrences(found: DataFrame, piece: int, shard_bytes: int, stream_bytes: int) -> DataFrame:
    """chunk, lo, hi: ranges of words of a chunk inside occurrences of a passage of the shared table."""
    table = materialize(found.select(F.explode("passages").alias("passage")).groupBy("passage").agg(F.count("*").alias("places")), "phrases")
    total = table.agg(F.sum(F.octet_length("passage").cast("long"))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))

    def shard(passage):
        return F.pmod(F.xxhash64(passage), F.lit(shards))

    routed = found.select("chunk", "lo", "region", F.explode(F.array_distinct(F.transform("passages", shard))).alias("shard"))
    sizes = routed.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("region").cast("long")) / stream_bytes).cast("int").alias("slices"))
    streams = routed.join(sizes, "shard").select("shard", F.pmod(F.hash("chunk", "lo"), "slices").alias("slice"), "chunk", "lo", "region")
    compiled = table.select(shard(F.col("passage")).alias("shard"), "passage").join(sizes, "shard")
    compiled = compiled.select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "passage")

    def stream(phrases: pa.Table, regions: pa.Table) -> pa.Table:
        chunk, lo = (regions.column(k).to_pylist() for k in ("chunk", "lo"))
        marks = locate(phrases.column("passage").to_pylist(), regions.column("region").to_pylist(), piece)
        return C.rows([(c, at + i, at + j) for c, at, mark in zip(chunk, lo, marks, strict=True) for i, j in _ranges(mark)], HITS)

    return compiled.groupBy("shard", "slice").cogroup(streams.groupBy("shard", "slice")).applyInArrow(stream, "chunk int, lo int, hi int")


def remove_repeats(documents: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = False, shard_bytes: int = SHARD_BYTES, stream_bytes: int = STREAM_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with_text the kept words joined by blanks."""
    plan = C.layout(documents)
    docs = C.dealt(documents, plan)

    def anchors(table: pa.Table, _: C.Replies | None) -> list:
        _, _, at, grams = _windows(table.column("text"), length, anchor)
        tokens, counts = np.unique(plan.cut(grams[np.unique(at)], 5), return_counts=True)
        out: list = []
        plan.send(table.column("chunk")[0].as_py(), 1, tokens, counts, 5, out)
        return out

    def candidates(table: pa.Table, replies: C.Replies) -> list:
        words, starts, at, grams = _windows(table.column("text"), length, anchor)
        places = np.unique(at)
        tokens, inverse = np.unique(plan.cut(grams[places], 5), return_inverse=True)
        shared = (replies.counts(1) > 1)[inverse] if len(tokens) else np.zeros(0, bool)
        maybe = shared[np.searchsorted(places, at)] if len(at) else np.zeros(0, bool)
        h, check = _hashes(words, starts[maybe], length)
        _, group, lead = _distinct(h, check)
        order = np.lexsort((check, h))
        chunk, out = table.column("chunk")[0].as_py(), []
        plan.send(chunk, 2, h[order][lead], np.bincount(group), 8, out, check[order][lead])
        plan.keep(chunk, 1, np.packbits(maybe).tobytes(), out)
        return out

    def passages(table: pa.Table, replies: C.Replies) -> pa.Table:
        words, starts, _, _ = _windows(table.column("text"), length, anchor)
        maybe = np.unpackbits(np.frombuffer(b"".join(x for _, x in replies.raw(-1)), np.uint8), count=len(starts)).astype(bool) if len(starts) else np.zeros(0, bool)
        starts = starts[maybe]
        order, group, _ = _distinct(*_hashes(words, starts, length))
        again = np.zeros(len(starts), bool)
        if len(starts):
            again[order] = (replies.counts(2) > 1)[group]
        regions, raw = _runs(words, starts, length), words.buf.tobytes()

        def text(lo: int, hi: int) -> str:
            return b" ".join(raw[words.start[lo] : words.end[hi - 1]].split()).decode()

        inside: dict[int, list[str]] = {}
        begin = np.array([lo for _, lo, _ in regions], np.int64)
        for _, lo, hi in _runs(words, starts[again], length):
            inside.setdefault(int(np.searchsorted(begin, lo, "right")) - 1, []).append(text(lo, hi))
        chunk = table.column("chunk")[0].as_py()
        return C.rows([(chunk, regions[r][1], text(*regions[r][1:]), held) for r, held in inside.items()], FOUND)

    def finish(table: pa.Table, hits: pa.Table) -> pa.Table:
        table = C.ordered(table)
        split = [(x or b"").split() for x in table.column("text").cast(pa.large_binary()).to_pylist()]
        first = np.concatenate([[0], np.cumsum([len(ws) for ws in split], dtype=np.int64)])
        edge = np.zeros(first[-1] + 1, np.int64)
        np.add.at(edge, hits.column("lo").to_numpy(), 1)
        np.add.at(edge, hits.column("hi").to_numpy(), -1)
        gone = np.cumsum(edge[:-1]) > 0
        marks = [gone[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
        kept = [b" ".join([w for w, m in zip(ws, mark.tolist(), strict=True) if not m]) if mark.any() else b" ".join(ws) for ws, mark in zip(split, marks, strict=True)]
        cols = [table.column("doc_id"), pa.array([len(ws) for ws in split], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        if with_text:
            cols.append(pa.array([k.decode() for k in kept], pa.string()))
        return pa.table(cols, empty.names)

    second = C.ask(docs, candidates, C.ask(docs, anchors))
    found = materialize(C.answer(docs, second, passages, "chunk int, lo int, region string, passages array<string>", FOUND), "regions")
    hits = _occurrences(found, max(PIECE, length), shard_bytes, stream_bytes)
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    empty = pa.schema([("doc_id", _arrow(documents)), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string())] * with_text)
    return docs.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(lambda t, h: finish(t, h) if t.num_rows else empty.empty_table(), schema)


def _arrow(documents: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(documents.schema["doc_id"].dataType)


def summary(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents).select("doc_id", "n_words", "n_removed", F.col("kept_sha256"))
