"""Repeated ids, stored maps written again, clashing names, and a session without a checkpoint folder."""

import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")
from tidemark.llm import ann, langid, lm, ngram_join, sharding  # noqa: E402


def test_ids_with_several_vectors_count_by_the_nearest(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=4)]) for i in [*range(40), *range(12), 0, 5]] + [(7, [0.5, 0.5, 0.5, 0.5])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id IN (0, 7, 30)")
    got = {}
    for r in ann.search(df, asked, k=6, probes=400).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 7, 30):
        d = {}
        for i, a in rows:
            for j, b in rows:
                if i == q and j != q:
                    x = float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))
                    d[j] = min(d.get(j, np.inf), x)
        want = sorted((x, j) for j, x in d.items())[:6]
        assert [v for _, v, _ in sorted(got[q])] == [j for _, j in want] and np.allclose([s for *_, s in sorted(got[q])], [x for x, _ in want])


def test_a_map_stored_twice_is_stored_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(50)], "doc_id long, text string")
    runs = [sorted(tuple(r) for r in sharding.shard_documents(df, path=f"{tmp_path}/map").collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 50


def test_names_that_clash(spark):
    text = "the quick brown fox jumps over the lazy dog and runs into the green forest"
    rows = [(i, text if i < 2 else f"{text} {i} and so on", "en", True, i) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, __rejected boolean, __one_kept int")
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and kept.count() <= 8
    one = ngram_join.one_of_each(df)
    assert one.columns == df.columns and {r["__one_kept"] for r in one.collect()} == {r["doc_id"] for r in one.collect()}


def test_without_a_checkpoint_folder(tmp_path):
    code = """
from tidemark.session import session
from tidemark.llm._shared import materialize
s = session("bare", "local[1]", spark__ui__enabled="false")
assert not s.conf.get("spark.checkpoint.dir", None)
assert materialize(s.range(3), "t").count() == 3
"""
    root = Path(__file__).resolve().parents[2]
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(root)}, check=True, timeout=120)


def test_scores_by_rows(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "one", "one two", "one two three", *(" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(12))]
    rows = [(i % 15 or None, t, "x", 1) for i, t in enumerate(texts + texts[-3:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, h int")
    key = lambda r: (r["doc_id"] or 0, r["n_words"], round(r["log_score"], 9), -1 if r["mean_log_score"] is None else round(r["mean_log_score"], 9), r["n_triples"], r["n_pairs"])
    want, got = (sorted(map(key, f(docs).collect())) for f in (lm.score, lm.score_by_rows))
    assert got == want and lm.score_by_rows(docs.limit(0)).count() == 0


def test_blocks_in_proportion_to_the_input():
    """Chunks times buckets, at the text of 6 GB of documents and at twelve times less."""
    from tidemark.llm import _chunks

    large, small = (_chunks.Layout(n << 20, growing=True) for n in (10_400, 867))
    assert small.chunks == _chunks.Layout(867 << 20).chunks
    assert large.chunks * large.buckets <= 24 * small.chunks * small.buckets


def test_small_groups_meet_as_in_trees():
    """Groups of up to FEW members, gone through together, against a tree each; sets of 70 to 85 shingles of 90, so that some pairs may link."""
    rng, words = np.random.default_rng(3), np.random.default_rng(4).integers(0, 2**63, 90).astype("u8")
    lo, rows = [], {k: [] for k in ("n", "m", "pos", "label", "bits")}
    for size in (1, 2, 5, 31, 32):
        lo.append(len(rows["n"]))
        for _ in range(size):
            mine = np.sort(rng.choice(words, int(rng.integers(70, 86)), replace=False))
            for k, v in (("n", len(mine)), ("m", len(mine)), ("pos", int(rng.integers(0, 8))), ("label", int(rng.integers(0, 9))), ("bits", np.frombuffer(ngram_join._signature(mine), "<u8"))):
                rows[k].append(v)
    rows = {k: np.array(v) for k, v in rows.items()}
    lo, hi = np.array(lo), np.array(lo[1:] + [len(rows["n"])])
    got = set(zip(*(x.tolist() for x in ngram_join._within(rows, lo, hi, 75)), strict=True))
    want = set()
    for a, b in zip(lo, hi, strict=True):
        t = ngram_join.Tree(rows["n"][a:b], rows["m"][a:b], (rows["m"] - rows["pos"])[a:b], rows["label"][a:b], rows["bits"][a:b])
        want |= {(int(i + a), int(j + a)) for i, j in zip(*ngram_join.traverse(t, t, True, 75), strict=True)}
    assert got == want and want
