"""Benchmark decontamination: a prefix-filtered set join of documents with benchmark windows, DataFrame functions only.

A window (item_words consecutive words of an item) is a set that a document must contain whole, so its necessary prefix
is one token: its rarest, by counts over all documents. Documents' words are joined with these tokens; a match fixes the
window's place in the document, which must lie within the document (positional and length bounds), and the words there
are compared with the window's one by one. Which items have a window is joined afterwards, to the windows that occur.
Joins of words with the windows' tokens are broadcast only when the windows take no more than BROADCAST_BYTES; beyond,
the same join is shuffled.

Cases: null or empty text has no words and no hits; a very long text is one row of words like any other, and is hit
anywhere; an item of fewer words than the window, but not none, is one window; an item without id marks words but isn't
counted among the items; a document in repeated rows gives as many rows, a null doc_id is a document of its own text;
empty tables give no hits, or no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What ends a word: ASCII but letters and digits. Everything beyond ASCII belongs to words.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
BROADCAST_BYTES = 16 << 20


def words_of(text: str | Column) -> Column:
    """Words with A-Z as a-z: each character between words becomes a blank, and empty words go."""
    t = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    return F.array_remove(F.split(F.translate(t, BETWEEN + AZ, " " * len(BETWEEN) + az), " "), "")


def windows(benchmark: DataFrame, length: int) -> DataFrame:
    """(window, n, item): the windows of each item, their words joined by blanks."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("words")).where(F.size("words") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - length + 1))
    each = rows.select("item", "words", F.explode(at).alias("at")).select("item", F.slice("words", F.col("at"), F.lit(length)).alias("w"))
    return each.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("n")).distinct()


def prefix_tokens(documents: DataFrame, distinct: DataFrame, small: bool) -> DataFrame:
    """(prefix, at, n, window): each window's rarest word, by its count over all documents, and its place in the window."""
    each = distinct.select("window", "n", F.posexplode(F.split("window", " ")).alias("at", "token"))
    vocabulary = each.select("token").distinct()
    tokens = documents.select(F.explode(words_of("text")).alias("token"))
    count = tokens.join(F.broadcast(vocabulary) if small else vocabulary, "token", "left_semi").groupBy("token").agg(F.count("*").alias("freq"))
    rarest = each.join(count, "token", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "token", "at")).alias("x"))
    return rarest.where("x.freq > 0").select(F.col("x.token").alias("prefix"), F.col("x.at").alias("at"), "n", "window")


KEY = ["doc_id", "text_hash", "n_bytes"]


def hits(documents: DataFrame, benchmark: DataFrame, item_words: int = 10) -> DataFrame:
    """One row for each document: doc_id, text_hash, n_words, spans (start and length of each window that occurs), items."""
    found = materialize(windows(benchmark, item_words), "windows")
    distinct = found.select("window", "n").distinct()
    small = int(distinct.agg(F.sum(F.octet_length("window") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    prefix = prefix_tokens(documents, distinct, small)
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("n_bytes"), words_of("text").alias("words"))
    rows = rows.withColumn("n_words", F.size("words"))
    # the last row of each document has no word: it carries the document itself
    each = rows.select("*", F.posexplode(F.concat(F.col("words"), F.array(F.lit(None).cast("string")))).alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    if small:
        same = F.array_join(F.slice("words", start + 1, F.col("n")), " ") == F.col("window")
        joined = each.join(F.broadcast(prefix), (F.col("word") == F.col("prefix")) & fits & same, "left")
    else:  # rows that are shuffled carry only the words around them
        low = F.greatest(F.lit(0), F.col("pos") - item_words + 1)
        near = each.withColumn("low", low).withColumn("near", F.slice("words", low + 1, F.lit(2 * item_words - 1))).drop("words")
        near = near.withColumn("near", F.when(F.col("word").isNotNull(), F.col("near")))
        same = F.array_join(F.slice("near", start - F.col("low") + 1, F.col("n")), " ") == F.col("window")
        joined = near.join(prefix, (F.col("word") == F.col("prefix")) & fits & same, "left")
    kept = joined.where(F.col("word").isNull() | F.col("window").isNotNull()).select(*KEY, "n_words", start.alias("start"), "n", "window")
    kept = materialize(kept, "hits")  # a row for each document, and one for each window at each place where it occurs
    span = F.when(F.col("window").isNotNull(), F.struct("start", "n"))
    docs = kept.groupBy(*KEY).agg(F.max("n_words").alias("n_words"), F.count_if(F.col("window").isNull()).alias("copies"), F.collect_set(span).alias("spans"))
    items = kept.where("window IS NOT NULL").select(*KEY, "window").distinct().join(found.drop("n"), "window").groupBy(*KEY).agg(F.collect_set("item").alias("items"))
    same_key = None
    for k in KEY:
        same_key = docs[k].eqNullSafe(items[k]) if same_key is None else same_key & docs[k].eqNullSafe(items[k])
    out = docs.join(items, same_key, "left").select(*(docs[k] for k in (*KEY, "n_words", "copies", "spans")), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copy", "copies")


def decontaminate(documents: DataFrame, benchmark: DataFrame, item_words: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and the spans and items themselves."""
    found = hits(documents, benchmark, item_words)
    places = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size(places).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.array_sort("spans").alias("spans"),
        F.array_sort("items").alias("items"),
        "text_hash",
    )


def clean(documents: DataFrame, benchmark: DataFrame, item_words: int = 10) -> DataFrame:
    """The documents without any hit, all their columns kept."""
    bad = hits(documents, benchmark, item_words).where(F.size("spans") > 0).select("text_hash").distinct()
    return documents.join(bad, F.xxhash64("text") == bad["text_hash"], "left_anti")
