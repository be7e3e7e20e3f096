"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries, and each variant's usual form.

1. Counts. Words are taken from whole texts, hashed and counted a slice of text at a time; Spark adds the counts up.
2. Blocks. Of a word that one inserted, deleted or replaced code point separates from another, the first half or the last half
   stays whole. So each word stands in the forward dictionary by its first half and in the reversed one by its last half,
   once for each length that the shorter word of a pair can have. A block is a range of a dictionary with one shared half. A
   block of more than BLOCK words is subdivided: of the part between what is shared, again the first or the last half stays
   whole. With one code point of the shorter word left between, the alphabet bounds a block.
3. Pairs. The dictionaries are range-partitioned by block and sorted; each block is compared within; a pair is verified, and
   reported by the one block that its first difference belongs to, so no pair comes twice.
4. Forms. The near word of largest count, if far more frequent, is a word's form; roots are found by pointer doubling.

Cases: null text has no words; empty and very long texts are whole slices; rows repeated whole count each time; null doc_id is
written as an empty string before the colon; ties of counts go to the word smallest in code-point order; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, roots
from ._text import LOWER_AZ, Words, buffers, slices

DIVISOR = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words in a block before it is subdivided; words of a partition of the dictionaries.
BLOCK, PART_WORDS = 256, 1 << 17
#: Code points of the words that are compared as rows of a matrix; longer ones are compared one by one.
WIDE = 48
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF, whose second byte may be any


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & np.uint32(1), (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


def crc32_each(buf: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of byte ranges, each going on from its own state (a crc32 so far): one pass for each place, over ranges that reach it."""
    table, c = _table(), state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    length = end - start
    order = np.argsort(-length, kind="stable")
    c, at, left = c[order], start[order], length[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # those longer than k come first
        part = c[:n]
        c[:n] = table[(part ^ buf[at[:n] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty(len(c), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


class Runs(Words):
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased."""

    __slots__ = ()

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        lead = buf == _LEAD
        inside = _LETTER[buf] | lead
        inside[1:] |= lead[:-1]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        self.buf, self.seed, self._hash = LOWER_AZ[buf], 1, None
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)


def _counts(divisor: int, least_length: int):
    """Texts (id, text) to words and their counts within a slice: those of `least_length` code points or more, altered ones altered."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def one(buf: np.ndarray, offsets: np.ndarray, ids: list[str]) -> pa.RecordBatch | None:
        w = Runs(buf, offsets)
        if not len(w):
            return None
        head = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        crc = crc32_each(w.buf, w.start, w.end, head[w.doc])
        points = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)])
        length = points[w.end] - points[w.start]
        hit = crc % np.uint32(divisor) == 0
        plain = np.flatnonzero(~hit & (length >= least_length))
        _, first, n = np.unique(w.hash[plain], return_index=True, return_counts=True)
        raw = w.buf.tobytes()
        found: dict[str, int] = {}
        for i, k in zip(plain[first].tolist(), n.tolist(), strict=True):
            word = raw[w.start[i] : w.end[i]].decode()
            found[word] = found.get(word, 0) + k
        for i in np.flatnonzero(hit & (length > least_length)).tolist():
            word, at = raw[w.start[i] : w.end[i]].decode(), int(crc[i]) % int(length[i])
            word = word[:at] + word[at + 1 :]
            found[word] = found.get(word, 0) + 1
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = buffers(b.column("text"))
            ids = [x or "" for x in b.column("id").to_pylist()]
            for i, j in slices(offsets):
                out = one(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ids[i:j])
                if out is not None:
                    yield out

    return run


def count_words(documents: DataFrame, divisor: int = DIVISOR, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of enough code points and occurrences, after the alteration of runs whose crc32 `divisor` divides."""
    rows = documents.select(F.col("doc_id").cast("string").alias("id"), "text").where("text <> ''")
    return rows.mapInArrow(_counts(divisor, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def blocks(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(short, path, head, tail, word, n): words by what they share, in blocks of at most `limit` words, or with no more than one
    code point of the shorter word between what is shared. head and tail are shared, path says how they were come to."""
    size = F.char_length("word")
    short = F.explode(F.filter(F.array(size, size - 1), lambda k: k > 0))
    now = words.select("word", "n", short.alias("short")).select("*", F.lit(1).alias("path"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    now = _divide(now)
    done = None
    while True:
        now = materialize(now, "blocks")
        key = ["short", "path", "head", "tail"]
        large = materialize(now.where(F.col("short") - F.col("x") - F.col("y") > 1).groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > limit).select(*key), "large")
        small = now.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done
        now = _divide(now.join(large, key, "left_semi").drop("head", "tail"))


def _divide(now: DataFrame) -> DataFrame:
    """Each word in two ranges: what is shared grows by half of what lies between, at the beginning or at the end."""
    between = F.col("short") - F.col("x") - F.col("y")
    half = F.floor(between / 2).cast("int")
    grown = F.explode(F.array(F.struct((2 * F.col("path")).alias("path"), (F.col("x") + half).alias("x"), F.col("y").alias("y")), F.struct((2 * F.col("path") + 1).alias("path"), F.col("x").alias("x"), (F.col("y") + half).alias("y"))))
    out = now.select("word", "n", "short", grown.alias("g")).select("word", "n", "short", "g.path", "g.x", "g.y")
    size = F.char_length("word")
    return out.withColumns({"head": F.substring("word", F.lit(1), F.col("x")), "tail": F.substring("word", size - F.col("y") + 1, F.col("y"))})


def owned(short: np.ndarray, shared: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Whether the range that was come to by `path` (1, then a bit for each subdivision, 1 for the last half) reports pairs whose
    first difference comes after `shared` code points: at each subdivision the first half counts as whole if it is, else the
    last."""
    a, b, p = np.zeros_like(short), np.zeros_like(short), np.ones_like(short)
    depth = np.frexp(path.astype(float))[1] - 1
    for k in range(int(depth.max()) if len(depth) else 0):
        go, half = k < depth, (short - a - b) // 2
        first = shared >= a + half
        a, b = np.where(go & first, a + half, a), np.where(go & ~first, b + half, b)
        p = np.where(go, 2 * p + ~first, p)
    return p == path


def _shared_ends(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (bytes of Latin-1) that pairs of words share at the beginning and at the end."""
    out = np.zeros((2, len(left)), np.int64)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        n = min(len(a), len(b))
        while out[0, i] < n and a[out[0, i]] == b[out[0, i]]:
            out[0, i] += 1
        while out[1, i] < n and a[-1 - out[1, i]] == b[-1 - out[1, i]]:
            out[1, i] += 1
    return out[0], out[1]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted blocks (short, path, head, tail, word, n) to (word, other, n of the other), both ways, for words one edit apart."""
    schema = pa.schema([("word", pa.string()), ("other", pa.string()), ("n", pa.int64())])
    batches = list(batches)
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    short, path, n = (t.column(k).to_numpy().astype(np.int64) for k in ("short", "path", "n"))
    words = np.array(t.column("word").to_pylist(), object)
    latin = [w.encode("latin-1") for w in words]
    size = np.array([len(w) for w in latin])
    heads, tails = (t.column(k).to_pylist() for k in ("head", "tail"))
    new = np.ones(len(words), bool)
    new[1:] = (short[1:] != short[:-1]) | (path[1:] != path[:-1])
    new[1:] |= np.array([a != b or c != d for a, b, c, d in zip(heads[1:], heads, tails[1:], tails, strict=False)], bool)
    begin = np.flatnonzero(new)
    end = np.repeat(np.append(begin[1:], len(words)), np.diff(np.append(begin, len(words))))
    wide = min(WIDE, int(size.max()))
    fit = size <= wide
    front = np.frombuffer(b"".join([w[:wide].ljust(wide, b"\0") for w in latin]), np.uint8).reshape(-1, wide)
    back = np.frombuffer(b"".join([w[:wide][::-1].ljust(wide, b"\0") for w in latin]), np.uint8).reshape(-1, wide)
    active, step = np.arange(len(words)), 1
    while len(active := active[active + step < end[active]]):
        for k in range(0, len(active), 1 << 16):
            i = active[k : k + (1 << 16)]
            j = i + step
            i, j = np.where(size[i] <= size[j], i, j), np.where(size[i] <= size[j], j, i)
            ok = size[i] == short[i]
            i, j = i[ok], j[ok]
            both = fit[i] & fit[j]
            ahead, behind = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            for out, m in ((ahead, front), (behind, back)):
                differ = m[i[both]] != m[j[both]]
                out[both] = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
            if not both.all():
                far = np.flatnonzero(~both)
                ahead[far], behind[far] = _shared_ends([latin[r] for r in i[far]], [latin[r] for r in j[far]])
            same = size[i] == size[j]
            good = (np.minimum(ahead, size[i]) + np.minimum(behind, size[i]) >= size[i] - same) & (words[i] != words[j])
            good[good] = owned(short[i[good]], ahead[good], path[i[good]])
            i, j = i[good], j[good]
            if len(i):
                yield pa.record_batch([pa.array(np.concatenate([words[i], words[j]]), pa.string()), pa.array(np.concatenate([words[j], words[i]]), pa.string()), pa.array(np.concatenate([n[j], n[i]]))], schema=schema)
        step += 1


def near_words(words: DataFrame, limit: int = BLOCK, part_words: int = PART_WORDS) -> DataFrame:
    """(word, other, n): all pairs of words (word, n) one edit apart, both ways, with the other's count."""
    key = ["short", "path", "head", "tail"]
    found = blocks(words, limit)
    parts = max(1, -(-found.count() // part_words))
    dealt = found.repartitionByRange(parts, *key).sortWithinPartitions(*key, "word")
    return dealt.select(*key, "word", "n").mapInArrow(_pairs, "word string, other string, n long")


def variants(documents: DataFrame, divisor: int = DIVISOR, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, limit: int = BLOCK, part_words: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = materialize(count_words(documents, divisor, least_length, least_count), "words")
    met = near_words(words, limit, part_words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("k"), "other")).alias("top"))
    known = words.join(met, "word", "left").withColumn("usual", -F.col("top.k") >= ratio * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("usual"), F.col("top.other")).alias("form"), F.when(F.col("usual"), -F.col("top.k")).alias("form_n"))
    known = materialize(known, "forms")
    ends = roots(known.where("form IS NOT NULL").select(F.col("word").alias("a"), F.col("form").alias("b")))
    return known.join(ends.withColumnRenamed("node", "word"), "word", "left").select("word", "form", F.coalesce("label", "word").alias("root"), "n", "n_near", "form_n")
