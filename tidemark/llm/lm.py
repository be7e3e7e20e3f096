"""Stupid-backoff language-model scores of all documents, from n-gram counts over all documents.

Count tables are partitioned by hash: every chunk of documents sends its distinct n-grams once to the partitions that
hold them, and each answer joins the corpus-wide count to the chunk's n-grams; scores are summed by document. First
words and word pairs are counted, then word triples, but only those whose two pairs occur twice or more: no other triple
can occur twice, and of one that occurs once nothing is left.

The counts are of the whole corpus less the scored occurrence itself, for else every triple would be known from its own
place. S(w | u v) is (c(u v w) - 1) / (c(u v) - 1) if c(u v w) > 1, else alpha S(w | v); S(w | v) is (c(v w) - 1) /
(c(v) - 1) if c(v w) > 1, else alpha c(w) / N, where the occurrence stays, so that no score is infinite. A document's
first word has c(w) / N, its second S(w | v). The score is the sum of natural logarithms. Nothing is pruned.

Cases: null, empty or blank text has no words, log_score 0 and mean_log_score null; a text of one or two words uses what
it has; a very long text is one document of its chunk, which grows by it; repeated rows count and are scored each, null
ids too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks as C
from ._shared import materialize
from ._text import Words, buffers, gram_hashes, gram_mask

ALPHA = 0.4
WIDTH = 5
SALTS = 4


class _Grams:
    """A chunk's words and n-grams, and the distinct ones as they are sent."""

    def __init__(self, plan: C.Layout, text: pa.ChunkedArray):
        self.words = Words(*buffers(text))
        n = len(self.words)
        self.ok = {2: gram_mask(self.words.first, n, 2), 3: gram_mask(self.words.first, n, 3)}
        self.one, self.at1 = np.unique(plan.cut(self.words.hash, WIDTH), return_inverse=True)
        self.pairs = gram_hashes(self.words.hash, 2)
        self.two, self.at2 = np.unique(plan.cut(self.pairs[self.ok[2]], WIDTH), return_inverse=True)

    def triples(self, plan: C.Layout, pair_known: np.ndarray):
        """Places of triples whose pairs both occur again, and the distinct ones."""
        n = len(self.words)
        known = np.zeros(max(0, n - 1), bool)
        known[self.ok[2]] = pair_known[self.at2] if len(self.at2) else False
        both = self.ok[3] & known[:-1] & known[1:] if n > 2 else np.zeros(0, bool)
        at = np.flatnonzero(both)
        tokens, where = np.unique(plan.cut(gram_hashes(self.words.hash, 3)[at], WIDTH), return_inverse=True)
        return at, tokens, where


def score(documents: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, n_triples and n_pairs (words scored by a triple, by a pair)."""
    plan = C.layout(documents)
    docs = C.dealt(documents, plan)
    total = float(documents.agg(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))).first()[0] or 0)

    def first(table: pa.Table, _) -> list:
        g, out, chunk = _Grams(plan, table.column("text")), [], table.column("chunk")[0].as_py()
        plan.send(chunk, 1, g.one, np.bincount(g.at1, minlength=len(g.one)), WIDTH, out)
        plan.send(chunk, 2, g.two, np.bincount(g.at2, minlength=len(g.two)), WIDTH, out)
        return out

    def second(table: pa.Table, replies: C.Replies) -> list:
        g, out, chunk = _Grams(plan, table.column("text")), [], table.column("chunk")[0].as_py()
        pairs = replies.counts(2)
        _, tokens, where = g.triples(plan, pairs > 1)
        plan.send(chunk, 3, tokens, np.bincount(where, minlength=len(tokens)), WIDTH, out)
        for k in (1, 2):
            for b, body in replies.raw(k):
                plan.keep(chunk, k, body, out, b)
        return out

    def finish(table: pa.Table, replies: C.Replies) -> pa.Table:
        g = _Grams(plan, table.column("text"))
        n, first_word, per = len(g.words), g.words.first, g.words.counts
        c1, c2 = replies.counts(-1).astype(float), replies.counts(-2).astype(float)
        word = c1[g.at1] if n else np.zeros(0)
        s = np.log(word / max(1.0, total))
        kind = np.ones(n, np.int8)
        follows = np.flatnonzero(g.ok[2]) + 1
        pair = c2[g.at2] if len(follows) else np.zeros(0)
        seen, less = pair > 1, lambda c: np.log(np.maximum(c - 1, 1))
        s[follows] = np.where(seen, less(pair) - less(word[follows - 1]), math.log(alpha) + s[follows])
        kind[follows[seen]] = 2
        by_pair = np.zeros(n)
        by_pair[follows] = pair
        at, _, where = g.triples(plan, c2 > 1)
        triple = replies.counts(3).astype(float)[where] if len(at) else np.zeros(0)
        third = np.flatnonzero(g.ok[3]) + 2
        known = np.zeros(n)
        known[at + 2] = triple
        in_table = known[third] > 1
        s[third] = np.where(in_table, less(known[third]) - less(by_pair[third - 1]), math.log(alpha) + s[third])
        kind[third[in_table]] = 3
        begin = first_word[:-1]
        sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (kind == 3, kind == 2)]
        per_doc = np.zeros(len(per))
        some = per > 0
        per_doc[some] = np.add.reduceat(s, begin[some]) if some.any() else 0
        mean = np.divide(per_doc, per, out=np.full(len(per), np.nan), where=some)
        counts = [(x[first_word[1:]] - x[begin]).astype(np.int64) for x in sums]
        return pa.table([table.column("doc_id"), pa.array(per.astype(np.int64)), pa.array(per_doc), pa.array(mean, mask=~some), pa.array(counts[0]), pa.array(counts[1])], NAMES)

    kind = documents.schema["doc_id"].dataType.simpleString()
    from .phrases import _arrow

    schema = f"doc_id {kind}, n_words long, log_score double, mean_log_score double, n_triples long, n_pairs long"
    empty = pa.schema([("doc_id", _arrow(documents)), ("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64()), ("n_triples", pa.int64()), ("n_pairs", pa.int64())])
    return C.answer(docs, C.ask(docs, second, C.ask(docs, first)), finish, schema, empty)


def score_by_rows(documents: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The same scores with a row for each occurrence: count tables by hash, joined to the exploded n-grams, summed by document.

    The plainest form, and in exchanges the costliest: every occurrence travels three times (README has figures). N-grams
    are told apart by 64-bit hashes. A frequent n-gram's occurrences are spread over SALTS rows of its count."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = documents.select(F.col("doc_id"), words.alias("ws")).withColumn("row", F.monotonically_increasing_id())
    docs = materialize(docs.select("doc_id", "row", F.transform("ws", lambda w: F.xxhash64(w)).alias("h")), "word-hashes")
    back = lambda i, k: F.when(i >= k, F.get("h", i - k))
    at = F.transform("h", lambda h, i: F.struct(h.alias("w1"), back(i, 1).alias("v1"), back(i, 2).alias("u1")))
    rows = docs.select("row", F.explode(at).alias("g")).select("row", "g.*")
    pair = lambda a, b: F.when(F.col(a).isNotNull(), F.xxhash64(F.lit(2), a, b))
    grams = rows.select("row", "w1", "v1", pair("v1", "w1").alias("w2"), pair("u1", "v1").alias("v2"), F.when(F.col("u1").isNotNull(), F.xxhash64(F.lit(3), "u1", "v1", "w1")).alias("w3"))
    one = grams.groupBy("w1").agg(F.count("*").alias("n"))
    total = one.agg(F.sum("n")).first()[0] or 1
    two = grams.where("w2 IS NOT NULL").groupBy("w2").agg(F.count("*").alias("n"), F.any_value("v1").alias("v1"))
    # (w2, n, s): what follows from the pair's and its first word's counts; pairs that occur once have no row
    pairs = two.where("n > 1").join(one.select(F.col("w1").alias("v1"), F.col("n").alias("nv")), "v1").select("w2", "n", F.log((F.col("n") - 1) / (F.col("nv") - 1)).alias("s"))
    pairs = materialize(pairs, "pairs")
    three = grams.where("w3 IS NOT NULL").groupBy("w3").agg(F.count("*").alias("n"), F.any_value("v2").alias("v2")).where("n > 1")
    triples = three.join(pairs.select(F.col("w2").alias("v2"), F.col("n").alias("np")), "v2").select("w3", F.log((F.col("n") - 1) / (F.col("np") - 1)).alias("s"))

    def joined(left: DataFrame, table: DataFrame, key: str, name: str) -> DataFrame:
        """The table's s for each row as `name`; rows and copies of the table are salted, so no key's rows meet in one task."""
        salt = F.pmod(F.hash("row"), F.lit(SALTS))
        many = table.select(F.col(key), F.col("s").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        return left.withColumn("salt", salt).join(many, [key, "salt"], "left").drop("salt", key)

    kind = F.when(F.col("w3").isNotNull(), 2).when(F.col("w2").isNotNull(), 1).otherwise(0).cast("byte")
    occurrences = grams.select("row", "w1", "w2", "w3", kind.alias("kind"))
    occurrences = joined(occurrences, one.select("w1", F.log(F.col("n") / F.lit(float(total))).alias("s")), "w1", "s1")
    occurrences = joined(joined(occurrences, pairs, "w2", "s2"), triples, "w3", "s3")
    return docs.select("doc_id", "row", F.size("h").alias("n_words")).join(_summed(occurrences, alpha), "row", "left").select(
        "doc_id", F.col("n_words").cast("long"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"), (F.col("log_score") / F.nullif(F.col("n_words"), F.lit(0))).alias("mean_log_score"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_triples", "n_pairs")),
    )


def _summed(occurrences: DataFrame, alpha: float) -> DataFrame:
    """Sums by document; `kind` of a word is how many words before it there are, two at most."""
    low = F.log(F.lit(alpha))
    second = F.when(F.col("kind") == 0, F.col("s1")).otherwise(F.coalesce("s2", low + F.col("s1")))
    s = F.when(F.col("kind") < 2, second).otherwise(F.coalesce("s3", low + second))
    by_pair = F.col("s3").isNull() & F.col("s2").isNotNull()
    return occurrences.groupBy("row").agg(F.sum(s).alias("log_score"), F.count("s3").alias("n_triples"), F.count_if(by_pair).alias("n_pairs"))


NAMES = ["doc_id", "n_words", "log_score", "mean_log_score", "n_triples", "n_pairs"]
