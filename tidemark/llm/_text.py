"""Vectorised words and hashes over Arrow text columns.

Whole texts are handled as UTF-8 bytes: a table of 256 entries says which bytes belong to words, word boundaries and
64-bit word hashes come from NumPy passes over the buffer, and n-gram hashes from prefix sums over word hashes. Work is
done in slices of whole documents, so memory follows the slice and the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 4 << 20
_BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _random_table(seed: int) -> np.ndarray:
    return mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed))


#: Bytes of words: all but ASCII white space, and ASCII letters, digits and everything beyond ASCII.
NOT_SPACE = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
LOWER_AZ = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_BASE = U(0xD6E8FEB86659FD93)  # 3 modulo 8, so that powers stay well apart
_GRAM = U(0xA0761D6478BD642B)


def _inverse(x: np.uint64) -> np.uint64:
    return U(pow(int(x), -1, 1 << 64))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (U(base), _inverse(U(base))):
        p = np.full(n, b, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i below a power of two that is n or more."""
    return _powers(int(base), 1 << max(16, int(n - 1).bit_length()))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and its n + 1 offsets; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `size` bytes."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


class Words:
    """The words of some documents: byte ranges, 64-bit hashes, and the first word of each document."""

    __slots__ = ("buf", "start", "end", "first", "_hash", "seed")

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE, lower: bool = False, seed: int = 1):
        self.buf, self.seed = (LOWER_AZ[buf] if lower else buf), seed
        inside = is_word[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(buf), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(buf), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.hashed(self.seed)
        return self._hash

    def hashed(self, seed: int) -> np.ndarray:
        table, out, i, n = _random_table(seed), np.empty(len(self.start), U), 0, len(self.start)
        while i < n:
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + _BLOCK, "right")))
            hi = self.end[j - 1]
            up, down = powers(_BASE, hi - lo)
            value = table[self.buf[lo:hi]] * up[: hi - lo]
            total = np.cumsum(value, dtype=U)
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix((total[e - 1] - total[s] + value[s]) * down[s] + (e - s).astype(U))
            i = j
        return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words, documents not yet told apart: len(words) - n + 1 of them."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    if n <= 6:
        total = words[:m].copy()
        for k in range(1, n):
            total *= _GRAM
            total += words[k : k + m]
        return mix(total + U(n))
    out = np.empty(m, U)
    for lo in range(0, m, _BLOCK):
        hi = min(m, lo + _BLOCK)
        part = words[lo : hi + n - 1]
        up, down = powers(_GRAM, len(part))
        total = np.concatenate([np.zeros(1, U), np.cumsum(part * up[: len(part)], dtype=U)])
        out[lo:hi] = mix((total[n:] - total[:-n]) * down[: hi - lo] + U(n))
    return out


def gram_mask(first: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """Of the n-grams of gram_hashes, those within one document."""
    m = max(0, n_words - n + 1)
    ok = np.ones(m, bool)
    for k in range(1, n):  # a gram that begins at first - k reaches into the next document
        at = first[1:-1] - k
        ok[at[(at >= 0) & (at < m)]] = False
    return ok


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and where each document's begin.

    With fewer than n words the whole sequence is the one shingle; without words there is none."""
    h, first, counts = words.hash, words.first, words.counts
    grams, ok = gram_hashes(h, n), gram_mask(first, len(words), n)
    doc = words.doc[: len(grams)]
    values, docs = grams[ok], doc[ok]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        few = np.array([gram_hashes(h[first[i] : first[i + 1]], int(counts[i]))[0] for i in short], U)
        values, docs = np.concatenate([values, few]), np.concatenate([docs, short])
    if len(short):
        order = np.argsort(docs, kind="stable")
        values, docs = values[order], docs[order]
    edges = np.searchsorted(docs, np.arange(len(counts) + 1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # many times faster than a sort by document and value
        values[lo:hi].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
    values, docs = values[keep], docs[keep]
    return values, np.searchsorted(docs, np.arange(len(counts) + 1))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
