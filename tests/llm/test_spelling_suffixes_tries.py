"""Spelling variants, suffix-array deduplication and the conversation trie against brute force, with nulls, empties, ties,
repeated rows, clashing columns, and limits so small that every further round is taken."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import spelling, suffixes, tries  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_multikey_quicksort_orders_rows():
    rng = np.random.default_rng(1)
    for width in (1, 3):
        words = rng.integers(0, 3, (700, width)).astype(np.uint64) << np.uint64(56)
        got = words[suffixes.multikey_quicksort(words)]
        assert [tuple(r) for r in got] == sorted(tuple(r) for r in words)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data[2000:2600] = data[100:700]
    length = 40
    _, at, first, last = suffixes.anchors(data, np.array([0, 1500, 3000]), length)
    anchor = {p: a - p for a, i, j in zip(at, first, last, strict=True) for p in range(i, j + 1)}
    assert set(anchor) == set(range(1500 - length + 1)) | set(range(1500, 3000 - length + 1))
    assert all(0 <= o < suffixes.shape(length)[0] for o in anchor.values())
    seen = {}
    for p, o in anchor.items():
        assert seen.setdefault(data[p : p + length].tobytes(), o) == o


def removed(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    n = collections.Counter(d[i : i + length] for d in texts for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, texts, strict=True):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if n[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, m in zip(d, gone, strict=True) if not m)
        spans = sum(1 for p in range(len(gone)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "length", "bucket"), [(1, 12, 1 << 20), (2, 24, 2000), (4, 400, 3000)])
def test_suffix_array(spark, seed, length, bucket):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(30)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [say(120) for _ in range(3)]
    rows = [(0, None), (1, ""), (1, "ab" * 500), (2, "a" * 700), (3, shared[0]), (3, shared[0]), (None, "short")]
    for i in range(40):
        copy = list(rng.choice(shared))
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = "#"
        rows.append((10 + i, say(rng.randint(0, 30)) + "".join(copy)[rng.randint(0, 90) :] + say(rng.randint(0, 20))))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, m string, h1 int")
    got = suffixes.remove_repeats(df, length, with_text=True, bucket_bytes=bucket).cache()
    assert rows_of(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == removed(rows, length)
    for r in got.collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] and sum(b - a for a, b in r["spans"]) == r["n_removed"]
    got.unpersist()
    assert suffixes.remove_repeats(df.limit(0), length).count() == 0


def near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    return sum(p != q for p, q in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(rows, divisor):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % divisor == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 5}
    close = {a: [b for b in n if near(a, b)] for a in n}
    best = {a: min(c, key=lambda v: (-n[v], v)) for a, c in close.items() if c}
    form = {a: b for a, b in best.items() if n[b] >= 5 * n[a]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n), key=str)


@pytest.mark.parametrize(("seed", "limit", "part_words", "divisor"), [(1, 4, 50, 7), (3, 2, 1000, 3)])
def test_spelling_variants(spark, seed, limit, part_words, divisor):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abÉé÷cdÀ") for _ in range(rng.randint(5, 10))) for _ in range(25)]
    base += ["aaaaaaa", "aaaaaaaa", "aaaaaab", "x" * 70, "x" * 71]

    def word():
        w = rng.choice(base) if rng.random() < 0.8 else rng.choice(base[:4])
        if rng.random() < 0.3:
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(["", "e", "é", "ab"]) + w[k + (rng.random() < 0.5) :]
        return w if rng.random() < 0.8 else w.upper()

    rows = [(None, "Abcdefg aaaaaaa"), (1, None), (2, ""), (3, "ÀÉ é-x")]
    rows += [(i, rng.choice([" ", ", ", "-", "\n"]).join(word() for _ in range(rng.randint(1, 300)))) for i in range(40)]
    rows += [(5, "aaaaaaa " * 40)] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert rows_of(spelling.variants(df, divisor, limit=limit, part_words=part_words)) == forms(rows, divisor)
    assert spelling.variants(df.limit(0)).count() == 0


def test_crc32_of_many_ranges():
    texts = [b"", b"a", b"abc", bytes(range(256)), b"abcd" * 9]
    buf, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    got = spelling.crc32_each(buf, ends - [len(t) for t in texts], ends, np.array([zlib.crc32(b"7:")] * 5, np.uint32))
    assert got.tolist() == [zlib.crc32(b"7:" + t) for t in texts]


def trie(rows):
    conv = {}
    for c, t, role, text in rows:
        if c is not None:
            conv.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    conv = {c: [v[2:] for v in sorted(ts, key=lambda v: (v[0], v[1], v[2].encode(), v[3].encode()))] for c, ts in conv.items()}
    head = lambda c: zlib.crc32(str(c).encode()) % 9
    built = {c: conv.get(c - c % 5, [])[: head(c)] + conv[c][head(c) :] for c in conv}
    node = collections.defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            node[tuple(t[:d])].append(c)
    children = collections.Counter(k[:-1] for k in node if k)
    out = []
    for k, m in node.items():
        below = [j for j in node if j[: len(k)] == k]
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        saved = sum((len(node[j]) - 1) * len(j[-1][1].encode()) for j in below if j)
        out.append((min(m), len(k), min(node[k[:-1]]) if k else None, len(m), children[k], sum(not children[j] for j in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "stretch"), [(1, 3), (2, 4096)])
def test_conversation_trie(spark, seed, stretch):
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        if c % 7 != 3:
            n = 60 if c == 20 else rng.randint(1, 12)
            rows += [(c, i, rng.choice(["u", "a", None]), rng.choice(["x", "é", "zz"]) if rng.random() < 0.9 else None) for i in range(n)]
    rows += [(None, 1, "u", "x"), (11, None, "u", "n"), (11, 2, "u", "dup"), (11, 2, "u", "dup"), (900, 0, "u", "x"), (4000, 0, "a", "b")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, node string")
    assert rows_of(tries.prefix_trie(df, rows=stretch)) == trie(rows)
    assert tries.prefix_trie(df.limit(0)).count() == 0
