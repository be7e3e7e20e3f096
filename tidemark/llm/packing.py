"""Packing tokens into sequences by cutting-stock column generation.

Every document is cut into whole sequences and one rest. The rests' lengths, in steps of QUANTUM tokens, form a
histogram of fixed size; a linear program over patterns (which lengths share a sequence) is solved by column generation,
new patterns priced by a knapsack dynamic program. Pattern counts are rounded down, what is left is packed best fit
first, and the documents, ranked within their length, take the patterns' places in order. Only the histogram and the
patterns, both bounded by the number of lengths, are on the driver.

Cases: null or empty text is one token, the closing id; repeated rows are packed each; ties in rank are broken by id, so
equal rows are interchangeable, and a null id is an id like any
other; a very long text becomes as many pieces as it fills; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

LENGTH = 2048
QUANTUM = 8
END_ID = 1
#: Pieces of one size are numbered in parts of about so many rows.
PART_ROWS = 50_000
#: Stems that a task keeps encoded; twice as many words.
CACHE = 500_000
#: The linear program is solved to this share of its least value.
GAP = 0.0005


#: The normalizer and pre-tokenizer for which a text's ids are those of its words.
BY_WORD = """{"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\\\s+"}, "content": " "}, {"type": "Lowercase"}]},
"pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+"}, "behavior": "Removed", "invert": true},
{"type": "ByteLevel", "add_prefix_space": false, "trim_offsets": true, "use_regex": false}]}}"""


class Encoder:
    """Token ids of texts as little-endian bytes.

    With the normalizer and pre-tokenizer of BY_WORD, which drop white space and never join across it, a text's ids are
    those of its words, one after the other; words are encoded once and kept. Any other tokenizer gets whole texts."""

    _STRANGE = re.compile("[\x1c-\x1f]")  # white space to Python, not to the tokenizer
    _TAIL = ".,!?;:&#$%*+-/=@^~|"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        self.by_word = all(own.get(k) == v for k, v in json.loads(BY_WORD).items()) and all(not a.get("lstrip") and not a.get("rstrip") for a in own["added_tokens"])
        self.words: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, stem: str) -> bytes:
        """Ids of lower-case letters that no normalisation changes: straight from the model, over its alphabet of bytes."""
        return np.array([t.id for t in self.tokenizer.model.tokenize(stem.encode().decode("latin-1").translate(_ALPHABET))], "<u4").tobytes()

    def _learn(self, missing: set[str]) -> None:
        if len(self.stems) > CACHE:
            self.stems = {}
        if len(self.words) > 2 * CACHE:
            self.words = {}
        stems, words, rest = self.stems, self.words, []
        for w in missing:
            low = w.lower()
            stem = low.rstrip(self._TAIL)
            # letters that are one code point each in any case and normal form
            if stem.isalpha() and (stem.isascii() or max(stem) < "ɐ"):
                ids = stems.get(stem)
                if ids is None:
                    ids = stems[stem] = self._plain(stem)
                if len(stem) < len(low):
                    tail = low[len(stem) :]
                    if tail not in stems:
                        stems[tail] = self._raw([tail])[0]
                    ids += stems[tail]
                words[w] = ids
            else:
                rest.append(w)
        words.update(zip(rest, self._raw(rest), strict=True))

    def forget(self) -> None:
        self.words, self.stems = {}, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return self._raw([t or "" for t in texts])
        lists: list[list[str] | None] = []
        missing: set[str] = set()
        for t in texts:
            if not t:
                lists.append([])
            elif self._STRANGE.search(t):
                lists.append(None)
            else:
                lists.append(words := t.split())
                missing.update(words)
        self_words = self.words
        missing = {w for w in missing if w not in self_words}
        if missing:
            before = self.words
            self._learn(missing)
            if self.words is not before:  # the cache began anew: the other words of this call too
                again = {w for x in lists if x for w in x if w not in self.words}
                if again:
                    self._learn(again)
        get = self.words.__getitem__
        return [b"".join(map(get, x)) if x is not None else self._raw([t])[0] for x, t in zip(lists, texts, strict=True)]


def _byte_alphabet() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ALPHABET = _byte_alphabet()
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, h (a hash of the row), start, length, ids_crc32, doc_tokens: whole sequences first, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        try:
            for whole in batches:
                for lo in range(0, whole.num_rows, 256):
                    batch = whole.slice(lo, 256)
                    row: list[int] = []
                    start: list[int] = []
                    size: list[int] = []
                    crc: list[int] = []
                    total: list[int] = []
                    for r, ids in enumerate(coder.encode(batch.column(2).to_pylist())):
                        ids += end
                        n = len(ids) // 4
                        for a in range(0, n, length):
                            part = ids[4 * a : 4 * (a + length)]
                            row.append(r)
                            start.append(a)
                            size.append(len(part) // 4)
                            crc.append(zlib.crc32(part))
                            total.append(n)
                    at = pa.array(row, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))], ["doc_id", "h", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            coder.forget()  # the worker goes on to other tasks

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, h long, start long, length long, ids_crc32 long, doc_tokens long")


def best_pattern(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of the highest price that fits: an unbounded knapsack, by dynamic programming over the capacity."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        value[w] = value[w - 1]
        n = np.searchsorted(sizes, w, "right")
        if n:
            each = value[w - sizes[:n]] + price[:n]
            k = int(np.argmax(each))
            if each[k] > value[w] + 1e-12:
                value[w], choice[w] = each[k], k
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            pattern[choice[w]] += 1
            w -= int(sizes[choice[w]])
    return float(value[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (as columns) and how often each is used, least in sum, so that every demand is met: the linear program."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    use = inverse @ demand
    for _ in range(most):
        price = inverse.sum(axis=0)
        value, pattern = best_pattern(price, sizes, capacity)
        if value <= 1 + 1e-7 or price @ demand / value >= (1 - GAP) * use.sum():  # what no solution can be below (Farley)
            break
        toward = inverse @ pattern
        up = toward > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = use[up] / toward[up]
        leave = int(np.argmin(ratio))
        basis[:, leave] = pattern
        row = inverse[leave] / toward[leave]
        inverse -= toward[:, None] * row
        inverse[leave] = row
        use = np.maximum(inverse @ demand, 0)
    return basis, use


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, count) for a histogram of sizes; a pattern says how many of each size, in order of size."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    left = np.array([histogram[s] for s in sizes], dtype=np.int64)
    basis, use = column_generation(sizes, left.astype(float), capacity)
    out: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-use):
        pattern = basis[:, k].astype(np.int64)
        held = pattern > 0
        if not held.any():
            continue
        count = min(int(use[k] + 1e-6), int((left[held] // pattern[held]).min()))
        if count > 0:
            out.append((pattern, count))
            left = left - count * pattern
    # what rounding left: the largest first, each into the fullest sequence that has room; bounded by patterns, not by data
    room: list[int] = []
    bins: list[np.ndarray] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            fits = [(r, i) for i, r in enumerate(room) if r >= sizes[k]]
            if fits:
                i = min(fits)[1]
            else:
                room.append(capacity)
                bins.append(np.zeros(len(sizes), np.int64))
                i = len(room) - 1
            room[i] -= int(sizes[k])
            bins[i][k] += 1
    return out + [(b, 1) for b in bins]


def assign(rests: DataFrame, length: int = LENGTH, quantum: int = QUANTUM) -> DataFrame:
    """sequence_id and offset for pieces of up to `length` tokens.

    A piece's rank among those of its size is its number within a part of them, dealt by hash, and the rows of the parts
    before; so the whole sequences, a size of their own, are numbered by as many tasks as any other rows."""
    spark = rests.sparkSession
    parts = max(1, -(-rests.count() // PART_ROWS))
    rows = rests.withColumn("size", F.ceil(F.col("length") / quantum).cast("int")).withColumn("part", F.pmod(F.xxhash64("h", "start"), F.lit(parts)).cast("int"))
    counts = materialize(rows.groupBy("size", "part").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    sizes = sorted(histogram)
    places: list[tuple[int, int, int, int, int, int]] = []
    begins, base = dict.fromkeys(sizes, 0), 0
    for pattern, count in plan(histogram, length // quantum):
        order = 0
        for k in np.flatnonzero(pattern)[::-1]:
            many, s = int(pattern[k]), sizes[int(k)]
            places.append((s, begins[s], begins[s] + many * count, base, many, order))
            begins[s] += many * count
            order += many
        base += count
    table = spark.createDataFrame(places or [(0, 0, 0, 0, 1, 0)], "size int, low long, high long, base long, many int, place int").coalesce(1)
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    own = Window.partitionBy("size", "part").orderBy("h", "doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(own)).join(offsets, ["size", "part"]).withColumn("rank", F.col("rank") - 1 + F.col("begins"))
    t = F.broadcast(table.withColumnRenamed("size", "s"))
    put = ranked.join(t, (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    at = F.col("rank") - F.col("low")
    put = put.withColumn("sequence_id", F.col("base") + F.floor(at / F.col("many")).cast("long")).withColumn("place", F.col("place") + F.pmod(at, F.col("many")))
    inside = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return put.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, quantum: int = QUANTUM) -> DataFrame:
    return assign(materialize(pieces(documents, tokenizer, length), "pieces"), length, quantum)
