"""Language identification by compression: a text is compressed with a raw-content zstandard dictionary for each
language, and the language whose dictionary gives the smallest result wins.

Dictionaries come from a bounded sample of labelled rows: of each language the different texts first in a hash order, of
each an excerpt of EXCERPT_CHARS from a place that its hash chooses, until DICT_BYTES are full; copies count once. Every
language is learned: beyond TOTAL_BYTES / DICT_BYTES of them the dictionaries share TOTAL_BYTES evenly, and a column with
more values than TOTAL_BYTES / LEAST_BYTES isn't one of languages and is refused.

Predictions use whole texts, in lower case, everything but letters as one blank. Each block of BLOCK_BYTES is compressed
by itself and the sizes are summed: what a dictionary saves is bounded, so in one piece the margin would shrink with the
length of the text.

Cases: `und` for null or empty text and text without a letter; also if nothing could be learned. Ties go to the first
language in order of name, and have margin 0. With one learned language the margin is 1. Null languages aren't learned
from; a null doc_id isn't either, and isn't held out. Very long texts are compressed whole, block by block. Repeated rows
are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import extended, numbered

DICT_BYTES = 64 << 10
EXCERPT_CHARS = 1500
BLOCK_BYTES = 64 << 10
LEVEL = 7
#: A prediction is rejected when the second best is less than this share larger.
MIN_MARGIN = 0.002
#: Of all dictionaries, and of one at least.
TOTAL_BYTES = 32 << 20
LEAST_BYTES = 4 << 10
_OTHER = re.compile(r"[\W\d_]+")


def _plain(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


def fit(labelled: DataFrame, dict_bytes: int = DICT_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Dictionaries from rows (text, lang); the sample that reaches the driver is bounded by the two parameters."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    most_languages, h = total_bytes // LEAST_BYTES, F.xxhash64("text")
    seen = rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).limit(most_languages + 1).collect()
    if not seen:
        return {}
    if len(seen) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    dict_bytes = min(dict_bytes, total_bytes // len(seen))
    excerpt = min(EXCERPT_CHARS, dict_bytes)
    most = max(64, 4 * dict_bytes // excerpt)
    # where the excerpt begins: anywhere, by the text's own hash
    begins = F.pmod(F.xxhash64(h, F.lit(1)), F.greatest(F.lit(1), F.length("text") - excerpt + 1)).cast("int")
    # of a language with many texts, those whose hash is in a share that holds about 16 times as many as are wanted
    shares = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, 16 * most / max(1, r["n"]))) for r in seen], "lang string, share double")
    within = F.pmod(F.xxhash64(h, F.lit(2)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    parts = rows.join(F.broadcast(shares), "lang").where(within).select("lang", h.alias("h"), F.substring(F.col("text"), begins + 1, F.lit(excerpt)).alias("part"))
    few = parts.select("lang", "h").distinct().withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("i") <= most).drop("i")
    sample = parts.join(F.broadcast(few), ["lang", "h"]).distinct().orderBy("lang", "h", "part").collect()
    out: dict[str, bytes] = {}
    for r in sample:
        out[r["lang"]] = out.get(r["lang"], b"") + (_plain(r["part"]) + b" " if len(out.get(r["lang"], b"")) < dict_bytes else b"")
    return {k: v[:dict_bytes] for k, v in sorted(out.items())}


@lru_cache(maxsize=2)
def _compressors(items: tuple[tuple[str, bytes], ...], level: int):
    import zstandard as z

    out = []
    for lang, content in items:
        known = z.ZstdCompressionDict(content or b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        out.append((lang, z.ZstdCompressor(dict_data=known, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, models) -> tuple[str, float]:
    if text is None or not models or not any(map(str.isalpha, text)):
        return "und", 0.0
    data = _plain(text)
    blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in models)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0]


def _predicted(documents: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, min_margin: float = MIN_MARGIN, text: str = "text") -> DataFrame:
    """The columns of the documents as c0, c1, ..., so that none clashes, with __lang_pred, __score and __rejected."""
    items, at = tuple(sorted(dictionaries.items())), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _compressors(items, level)
        for batch in batches:
            got = [classify(t.as_py(), models) for t in batch.column(at)]
            lang, score = [x[0] for x in got], [x[1] for x in got]
            rejected = [a == "und" or s < min_margin for a, s in got]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, "__lang_pred", "__score", "__rejected"])

    rows = numbered(documents)
    return rows.mapInArrow(run, extended(rows.schema, __lang_pred="string", __score="double", __rejected="boolean"))


def predict(documents: DataFrame, dictionaries: dict[str, bytes], **options) -> DataFrame:
    """All columns of the documents, with __lang_pred, __score and __rejected."""
    return _predicted(documents, dictionaries, **options).toDF(*documents.columns, "__lang_pred", "__score", "__rejected")


def remainder():
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def identify(documents: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learned from the documents that aren't held out."""
    learned = fit(documents.where(remainder() != 2).select("text", "lang"))
    rows = documents.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, learned, **options).select("doc_id", "held_out", F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"), F.col("__rejected").alias("rejected"))


def keep_known(documents: DataFrame, **options) -> DataFrame:
    """The documents whose language is clear, with the columns they had."""
    learned = fit(documents.where(remainder() != 2).select("text", "lang"))
    return _predicted(documents, learned, **options).where(~F.col("__rejected")).drop("__lang_pred", "__score", "__rejected").toDF(*documents.columns)
