"""The queries of this subpackage, each over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, decontam, langid, lines, lm, ngram_join, packing, phrases, quality, sharding, spelling, suffixes, tries

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(read(spark, sf_dir, "documents"))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(read(spark, sf_dir, "documents"))


def op4_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_hundredths(read(spark, sf_dir, "embeddings"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.score(read(spark, sf_dir, "documents"))
    return scores.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.summary(read(spark, sf_dir, "documents"))


def op9_prefix_filtered_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_resampling,
        op2_signature_tree_join,
        op3_line_chunks,
        op4_compression_language,
        op5_multiprobe_neighbours,
        op6_virtual_slots,
        op7_stupid_backoff,
        op8_repeated_phrases,
        op9_prefix_filtered_decontamination,
        op10_cutting_stock_packing,
        op11_spelling_variants,
        op12_suffix_array,
        op13_conversation_trie,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_AZ = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The 256 steps of crc32, and crc32 of a string whose code points are below U+0100.
_CRC_TABLE = """tb AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


def _crc(s: str) -> str:
    points = f"flatten(list_transform(string_split({s}, ''), lambda k: CASE WHEN ord(k) < 128 THEN [ord(k)] ELSE [195, ord(k) - 64] END))"
    return f"xor(list_reduce(list_prepend(4294967295, {points}), lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)])), 4294967295)"


ORACLE: dict[str, str] = {
    "op2_signature_tree_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n""",
    "op7_stupid_backoff": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, ws[i] AS c, CASE WHEN i > 1 THEN ws[i - 1] END AS b, CASE WHEN i > 2 THEN ws[i - 2] END AS a
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
c1 AS (SELECT c, count(*) AS n FROM w GROUP BY c),
c2 AS (SELECT b, c, count(*) AS n FROM w WHERE b IS NOT NULL GROUP BY b, c),
c3 AS (SELECT a, b, c, count(*) AS n FROM w WHERE a IS NOT NULL GROUP BY a, b, c),
t AS (SELECT sum(n) AS t FROM c1),
x AS (SELECT w.doc_id, w.i, ln(u.n / t.t) AS s1, p.n AS n2, v.n AS nb, q.n AS n3, h.n AS nh
      FROM w CROSS JOIN t JOIN c1 u ON u.c = w.c LEFT JOIN c2 p ON p.b = w.b AND p.c = w.c LEFT JOIN c1 v ON v.c = w.b
      LEFT JOIN c3 q ON q.a = w.a AND q.b = w.b AND q.c = w.c LEFT JOIN c2 h ON h.b = w.a AND h.c = w.b),
y AS (SELECT *, CASE WHEN i = 1 THEN s1 WHEN n2 > 1 THEN ln((n2 - 1) / (nb - 1)) ELSE ln(0.4) + s1 END AS s2 FROM x),
z AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN i <= 2 THEN s2 WHEN n3 > 1 THEN ln((n3 - 1) / (nh - 1)) ELSE ln(0.4) + s2 END) AS s,
      count_if(i > 2 AND n3 > 1) AS n_triples, count_if(i > 1 AND n2 > 1 AND NOT (i > 2 AND n3 > 1)) AS n_pairs FROM y GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(s, 0.0), 4) AS log_score, round(s / n_words, 4) AS mean_log_score,
       CAST(coalesce(n_triples, 0) AS BIGINT) AS n_triples, CAST(coalesce(n_pairs, 0) AS BIGINT) AS n_pairs
FROM d LEFT JOIN z USING (doc_id)""",
    "op8_repeated_phrases": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
r AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i FROM p SEMI JOIN r USING (g)) CROSS JOIN (SELECT unnest(range(0, 35)) AS k)),
m AS (SELECT doc_id, count(*) AS n, list(i) AS gone FROM c GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept
      FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d) ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)""",
    "op9_prefix_filtered_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
v AS (SELECT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + 9], ' ') AS g
      FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
l AS (SELECT DISTINCT n FROM v),
h AS (SELECT doc_id, i, l.n, array_to_string(ws[i:i + l.n - 1], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) CROSS JOIN l WHERE i + l.n - 1 <= len(ws)),
x AS (SELECT h.doc_id, h.i, h.n, v.item FROM h JOIN v ON v.g = h.g AND v.n = h.n),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM x CROSS JOIN (SELECT unnest(range(0, 10)) AS k) WHERE k < n GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM x) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_AZ}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY doc_id, w),
h AS (SELECT w, k, {_crc("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM r, tb),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS w, k FROM h),
c AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM v WHERE length(w) >= 6 GROUP BY w HAVING sum(k) >= 5),
g AS (SELECT w, n, substr(w, 1, CAST(i AS BIGINT)) || '*' || substr(w, CAST(i AS BIGINT) + 2) AS g FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM c)),
u AS (SELECT w, n, substr(w, 1, CAST(i AS BIGINT)) || substr(w, CAST(i AS BIGINT) + 2) AS g FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM c)),
e AS (SELECT a.w, b.w AS o, b.n FROM g a JOIN g b ON a.g = b.g AND a.w <> b.w UNION SELECT a.w, b.w, b.n FROM c a JOIN u b ON b.g = a.w UNION SELECT b.w, a.w, a.n FROM c a JOIN u b ON b.g = a.w),
m AS (SELECT w, count(*) AS k, min({{'n': -n, 'o': o}}) AS t FROM e GROUP BY w),
f AS (SELECT c.w, c.n, coalesce(m.k, 0) AS k, CASE WHEN -m.t.n >= 5 * c.n THEN m.t.o END AS form, CASE WHEN -m.t.n >= 5 * c.n THEN -m.t.n END AS form_n FROM c LEFT JOIN m USING (w)),
z AS (SELECT w, w AS root FROM f WHERE form IS NULL UNION ALL SELECT f.w, z.root FROM f JOIN z ON f.form = z.w)
SELECT f.w AS word, f.form, z.root, f.n, f.k AS n_near, f.form_n FROM f JOIN z USING (w)""",
    "op12_suffix_array": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, b, substr(x, CAST(2 * b + 1 AS BIGINT), 2846) AS x FROM (SELECT r, x, unnest(range(0, length(x) // 2, 1024)) AS b FROM d)),
p AS (SELECT r, b + i AS i, md5(substr(x, CAST(2 * i + 1 AS BIGINT), 800)) AS g FROM (SELECT r, b, x, unnest(range(0, greatest(0, length(x) // 2 - 399))) AS i FROM c)),
q AS (SELECT r, i FROM p WHERE g IN (SELECT g FROM p GROUP BY g HAVING count(*) > 1)),
s AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM q),
t AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM s),
v AS (SELECT r, k, min(i) AS lo, max(i) + 400 AS hi FROM t GROUP BY r, k),
y AS (SELECT r, sum(hi - lo) AS gone, count(*) AS n, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM v GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(list_zip(list_prepend(CAST(0 AS BIGINT), his), list_append(los, CAST(length(x) // 2 AS BIGINT))), lambda c: substr(x, CAST(2 * c[1] + 1 AS BIGINT), CAST(2 * (c[2] - c[1]) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN y USING (r)""",
    "op13_conversation_trie": f"""
WITH {_CRC_TABLE},
o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, w, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM o, tb),
b AS (SELECT h.conv_id, list_concat(coalesce(o.w[1:h], []), h.w[h + 1:]) AS w FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, d = len(w) AS last, CASE WHEN d > 0 THEN strlen(w[d].x) ELSE 0 END AS z, sha256(CAST(w[1:d] AS VARCHAR)) AS k FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM b)),
n AS (SELECT k, d, min(conv_id) AS c, count(*) AS m, min(z) AS z, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS e FROM p GROUP BY k, d),
q AS (SELECT p.conv_id, p.d, n.c FROM p JOIN n USING (k, d)),
a AS (SELECT n.c, n.d, n.m, n.z, n.e, q.c AS up FROM n LEFT JOIN q ON q.conv_id = n.c AND q.d = n.d - 1),
f AS (SELECT a.*, (SELECT count(*) FROM a y WHERE y.up = a.c AND y.d = a.d + 1) AS kids FROM a),
s AS (SELECT q.c, q.d, sum(CASE WHEN f.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.m - 1) * f.z) AS saved FROM f JOIN q ON q.conv_id = f.c AND q.d <= f.d GROUP BY q.c, q.d)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, f.up AS parent_conv_id, f.m AS n_convs, f.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.e AS ends_sha256
FROM f JOIN s USING (c, d)""",
}
