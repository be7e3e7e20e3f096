"""N-gram Jaccard join by signature trees, with the classes of documents that its links connect.

A text's set is its distinct `size`-word shingles (A-Z in lower case; fewer words make one shingle; none make none). Two
texts link when 100 |A n B| >= percent |A u B|.

1. Equal texts are one text from here on. Each chunk of texts learns, by one exchange of counts, how many texts hold each
   of its shingles. A text of n shingles can only link when percent of them are shared, and its links share one of its
   rarest shared shingles, so few enough of them to be beyond what a link may miss: its prefix.
2. Every text is compared with one leader, the least text that shares a prefix shingle, and linked texts are joined. In
   ROUNDS further rounds, or until one joins nothing, every text that shares a prefix shingle with another class is
   compared with one text of another class, so that step 3 needn't meet each pair of two classes that one link joins.
3. Texts of different classes that share a prefix shingle form a group. Its members are put into a signature tree: leaves
   and nodes hold the OR of token bitmaps, ranges of sizes and the class if it is one. Two trees (or one with itself) are
   traversed together; a pair of nodes is left out when its largest possible overlap is too small, or when both hold one
   and the same class. What is left is verified on the sets. Groups beyond BLOCK members are split into blocks, and each
   pair of blocks is a task's own traversal. Groups of up to FEW members are one leaf each, and the leaves of a batch are
   gone through together.

No pair is dropped: a pair that links shares a prefix shingle and is either in one class after step 2 or met in step 3,
whatever the number of rounds.
Sets are compared as 64-bit shingle hashes, texts by 64-bit hashes.

Cases: null or blank text has an empty set and links with nothing; repeated rows and equal texts are in one class; a null
doc_id is never the least id of a class that has another; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks as C
from ._shared import components, materialize, numbered, roots
from ._text import U, Words, buffers, mix, shingle_sets

SIZE = 5
PERCENT = 75
WIDTH = 5
BITS = 4096
LEAF = 4
FAN = 4
FEW = 32
BLOCK = 1024
PAIRS = 8192
ROUNDS = 3


def _least_shared(n: np.ndarray | int, percent: int):
    """The fewest shingles that a set of n has in common with any set that links with it."""
    return -(-n * percent // 100)


def _signature(hashes: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(mix(hashes) >> U(32)).astype(np.int64) % BITS] = 1
    return np.packbits(bits).tobytes()


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once for each task, before it is dealt out."""
    seen: set[int] = set()
    for batch in batches:
        at = []
        for r, h in enumerate(batch.column(0).to_pylist()):
            if h not in seen:
                seen.add(h)
                at.append(r)
        yield batch.take(pa.array(at, pa.int32()))


def _sets(table: pa.Table, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of texts, each once; their shingles; and where each text's begin."""
    th, first = np.unique(table.column("h").to_numpy(), return_index=True)
    text = table.column("text").take(pa.array(first))
    values, bounds = shingle_sets(Words(*buffers(text), lower=True), size)
    return th, values, bounds


def shared_sets(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(th, n) of all texts, and of those that can link: the shared shingles, the prefix and the signature."""
    plan = C.layout(documents, growing=True)
    texts = documents.where(F.col("text").isNotNull()).select(F.xxhash64("text").alias("h"), "text").mapInArrow(_once, "h long, text string")
    docs = texts.select("h", F.lit(0).alias("h2"), "text", F.pmod("h", F.lit(plan.chunks)).cast("int").alias("chunk"))

    def request(table: pa.Table, _) -> list:
        _, values, _ = _sets(table, size)
        out: list = []
        tokens, counts = np.unique(plan.cut(values, WIDTH), return_counts=True)
        plan.send(table.column("chunk")[0].as_py(), 1, tokens, counts, WIDTH, out)
        return out

    def finish(table: pa.Table, replies: C.Replies) -> pa.Table:
        th, values, bounds = _sets(table, size)
        cut = plan.cut(values, WIDTH)
        tokens, where = np.unique(cut, return_inverse=True)
        df = replies.counts(1)[where] if len(tokens) else np.zeros(0, np.int64)
        n = np.diff(bounds)
        common = np.concatenate([[0], np.cumsum(df > 1)])
        m = common[bounds[1:]] - common[bounds[:-1]]
        can = (n > 0) & (m >= _least_shared(n, percent))
        body: list = [None] * len(th)
        prefix: list = [None] * len(th)
        signature: list = [None] * len(th)
        for i in np.flatnonzero(can):
            lo, hi = bounds[i], bounds[i + 1]
            held = df[lo:hi] > 1
            mine, often, short = values[lo:hi][held], df[lo:hi][held], cut[lo:hi][held]
            k = int(m[i] - _least_shared(n[i], percent) + 1)
            body[i] = mine.astype("<u8").tobytes()
            prefix[i] = short[np.lexsort((short, often))[:k]].view(np.int64)
            signature[i] = _signature(mine)
        return pa.table([pa.array(th), pa.array(n.astype(np.int32)), pa.array(body, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(signature, pa.binary())], schema=_SETS)

    return C.answer(docs, C.ask(docs, request), finish, "th long, n int, shared binary, prefix array<long>, signature binary", _SETS)


_SETS = pa.schema([("th", pa.int64()), ("n", pa.int32()), ("shared", pa.binary()), ("prefix", pa.list_(pa.int64())), ("signature", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those that link, by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                x = np.frombuffer(batch.column(3)[r].as_py(), "<u8")
                y = np.frombuffer(batch.column(5)[r].as_py(), "<u8")
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(y) else 0
                ok[r] = 100 * both >= percent * (int(na[r]) + int(nb[r]) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], schema=_PAIRS)

    # sizes first, so that sets meet only for pairs whose sizes allow a link
    sized = pairs.join(sets.select(F.col("th").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa")), "a")
    sized = sized.join(sets.select(F.col("th").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb")), "b")
    sized = sized.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def _leaf(n: np.ndarray, m: np.ndarray, left: np.ndarray, label: np.ndarray, bits: np.ndarray) -> dict:
    pop = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    return {"low": n, "high": n, "m": m, "left": left, "pop": pop, "bits": bits, "label": label, "one": np.ones(len(n), bool)}


class Tree:
    """A signature tree over the members of one block: level 0 holds the members, each further level FAN times fewer nodes."""

    def __init__(self, n: np.ndarray, m: np.ndarray, left: np.ndarray, label: np.ndarray, bits: np.ndarray):
        self.levels = [_leaf(n, m, left, label, bits)]
        step = LEAF
        while len(self.levels[-1]["low"]) > 1:
            x = self.levels[-1]
            at = np.arange(0, len(x["low"]), step)
            self.levels.append(
                {
                    "low": np.minimum.reduceat(x["low"], at),
                    "high": np.maximum.reduceat(x["high"], at),
                    "m": np.maximum.reduceat(x["m"], at),
                    "left": np.maximum.reduceat(x["left"], at),
                    "pop": np.minimum.reduceat(x["pop"], at),
                    "bits": np.bitwise_or.reduceat(x["bits"], at, axis=0),
                    "label": np.minimum.reduceat(x["label"], at),
                    "one": np.logical_and.reduceat(x["one"], at) & (np.minimum.reduceat(x["label"], at) == np.maximum.reduceat(x["label"], at)),
                }
            )
            step = FAN


def _possible(x: dict, i: np.ndarray, y: dict, j: np.ndarray, percent: int) -> np.ndarray:
    """Of node pairs, those that may hold a link between classes: sizes are near enough, and the largest possible overlap,
    the shared shingles less the bits that the other node's OR lacks, is enough for the smallest union. A link is met, among
    others, under its first common shingle; there no more overlap than what either member has left from that place on."""
    low, high = np.maximum(x["low"][i], -(-y["low"][j] * percent // 100)), np.maximum(y["low"][j], -(-x["low"][i] * percent // 100))
    near = (low <= x["high"][i]) & (high <= y["high"][j])
    both = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):  # the bitmaps of so many pairs at once
        few = slice(at, at + PAIRS)
        both[few] = np.bitwise_count(x["bits"][i[few]] & y["bits"][j[few]]).sum(axis=1)
    most = np.minimum(x["m"][i] - np.maximum(0, x["pop"][i] - both), y["m"][j] - np.maximum(0, y["pop"][j] - both))
    most = np.minimum(most, np.minimum(x["left"][i], y["left"][j]))
    # a link needs (100 + percent) |A n B| >= percent (|A| + |B|)
    enough = (100 + percent) * most >= percent * (low + high)
    return near & enough & ~(x["one"][i] & y["one"][j] & (x["label"][i] == y["label"][j]))


def traverse(a: Tree, b: Tree, same: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that may link, by descending both trees together; same: a tree with itself, each pair once."""
    while len(a.levels) < len(b.levels):
        a.levels.append(a.levels[-1])
    while len(b.levels) < len(a.levels):
        b.levels.append(b.levels[-1])
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for level in range(len(a.levels) - 1, -1, -1):
        x, y = a.levels[level], b.levels[level]
        keep = _possible(x, i, y, j, percent)
        if same:
            keep &= i <= j if level else i < j
        i, j = i[keep], j[keep]
        if level and len(i):
            i, j = _children(a, level, i), _children(b, level, j)
            i, j = _cross(i, j)
    return i, j


def _children(t: Tree, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    below = len(t.levels[level - 1]["low"])
    if t.levels[level - 1] is t.levels[level]:  # a level that only waits for the other tree
        return i, i + 1
    step = LEAF if level == 1 else FAN
    return i * step, np.minimum(i * step + step, below)


def _cross(p: tuple[np.ndarray, np.ndarray], q: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    np_, nq = p[1] - p[0], q[1] - q[0]
    total = np_ * nq
    row = np.repeat(np.arange(len(total)), total)
    at = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
    return p[0][row] + at // nq[row], q[0][row] + at % nq[row]


def _within(rows: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may link, within each of the groups from row lo to hi."""
    i, j = _cross((lo, hi), (lo, hi))
    n, label = rows["n"], rows["label"]
    keep = (i < j) & (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j = i[keep], j[keep]
    x = _leaf(n, rows["m"], rows["m"] - rows["pos"], label, rows["bits"])
    keep = _possible(x, i, x, j, percent)
    return i[keep], j[keep]


def _tree(rows: dict[str, np.ndarray]) -> tuple[Tree, np.ndarray]:
    order = np.lexsort((rows["th"], rows["n"], rows["label"]))
    return Tree(rows["n"][order], rows["m"][order], (rows["m"] - rows["pos"])[order], rows["label"][order], rows["bits"][order]), rows["th"][order]


def _groups(percent: int):
    """Rows sorted by group: candidates of each group, as they end."""

    def solve(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        first = rows["block"] == rows["low"][0]
        same = rows["low"][0] == rows["high"][0]
        if len(rows["th"]) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        one = lambda keep: {k: v[keep] for k, v in rows.items()}
        if same:
            t, th = _tree(rows)
            i, j = traverse(t, t, True, percent)
            a, b = th[i], th[j]
        elif first.all() or not first.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            (t, th), (u, uh) = _tree(one(first)), _tree(one(~first))
            i, j = traverse(t, u, False, percent)
            a, b = th[i], uh[j]
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None

        def cut(rows: dict[str, np.ndarray], last: bool):
            edge = np.flatnonzero(np.concatenate([[True], rows["gid"][1:] != rows["gid"][:-1]]))
            ends = np.append(edge[1:], len(rows["gid"]))
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            upto = len(edge) if last else len(edge) - 1
            few = (ends[:upto] - edge[:upto] <= FEW) & (rows["low"][edge[:upto]] == rows["high"][edge[:upto]])
            i, j = _within(rows, edge[:upto][few], ends[:upto][few], percent)
            a.append(np.minimum(rows["th"][i], rows["th"][j]))
            b.append(np.maximum(rows["th"][i], rows["th"][j]))
            for lo, hi in zip(edge[:upto][~few], ends[:upto][~few], strict=True):
                x, y = solve({k: v[lo:hi] for k, v in rows.items()})
                a.append(x)
                b.append(y)
            rest = None if last else {k: v[edge[-1] :] for k, v in rows.items()}
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)  # many shingles share their members
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], schema=_PAIRS), rest

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("gid", "low", "high", "block", "th", "n", "m", "pos", "label")}
            rows["bits"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u8").reshape(batch.num_rows, BITS // 64)
            if held is not None:
                rows = {k: np.concatenate([held[k], v]) for k, v in rows.items()}
            out, held = cut(rows, False)
            yield out
        if held is not None:
            yield cut(held, True)[0]

    return run


def _mixed(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Postings (th, pos, token) with their text's label, of the tokens that texts of different classes hold."""
    classed = postings.join(labels.withColumnRenamed("node", "th"), "th", "left").select("th", "pos", "token", F.coalesce("label", "th").alias("label"))
    several = classed.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    return materialize(classed.join(several, "token", "left_semi"), "mixed")


def _elsewhere(mixed: DataFrame, turn: int) -> DataFrame:
    """For each text (a) one text of another class (b): of each token's first and last class one member, by a hash that
    differs from turn to turn; of these the one met under most tokens."""
    key = F.struct("label", F.xxhash64("th", F.lit(turn)).alias("h"), "th")
    ends = mixed.groupBy("token").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    toward = mixed.join(ends, "token").select("th", F.when(F.col("label") == F.col("first.label"), F.col("last.th")).otherwise(F.col("first.th")).alias("lead"))
    best = toward.groupBy("th", "lead").agg(F.count("*").alias("met")).groupBy("th").agg(F.max(F.struct("met", "lead")).alias("best"))
    return best.select(F.col("th").alias("a"), F.col("best.lead").alias("b"))


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between texts as links between their classes."""
    for end in ("a", "b"):
        links = links.join(labels.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return links.where("a <> b")


def _joined(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """Labels after classes were merged: (node, label) of classes, a text without links being a class of its own."""
    both = labels.join(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return both.unionAll(merged.join(labels.select("node"), "node", "left_anti"))


def text_classes(documents: DataFrame, size: int = SIZE, percent: int = PERCENT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(sets, labels): th and n of all texts; (node, label) of the texts that have links."""
    sets = materialize(shared_sets(documents, size, percent), "sets")
    able = sets.where(F.col("shared").isNotNull())
    postings = able.select("th", F.posexplode("prefix").alias("pos", "token"))
    leaders = postings.groupBy("token").agg(F.min("th").alias("lead"), F.count("*").alias("members")).where("members > 1")
    toward = postings.join(leaders, "token").groupBy("th").agg(F.min("lead").alias("lead")).where("th <> lead")
    first = materialize(verify(toward.select(F.col("th").alias("a"), F.col("lead").alias("b")), able, percent), "links")
    labels = materialize(roots(first), "labels")
    mixed = _mixed(postings, labels)
    for turn in range(rounds):
        links = _between(verify(_elsewhere(mixed, turn), able, percent), labels)
        upward = materialize(links.groupBy(F.greatest("a", "b").alias("a")).agg(F.min(F.least("a", "b")).alias("b")), "links")
        if upward.isEmpty():
            break
        labels = materialize(_joined(labels, roots(upward)), "labels")
        mixed = _mixed(mixed.drop("label"), labels)
    parts = mixed.groupBy("token").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = mixed.join(parts, "token").withColumn("block", F.pmod(F.xxhash64("th"), F.col("parts")).cast("int"))
    members = members.join(able.select("th", "n", (F.octet_length("shared") / 8).cast("int").alias("m"), "signature"), "th")
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    paired = paired.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "token", "block", "th", "n", "m", "pos", "label", "signature")
    paired = paired.withColumn("gid", F.xxhash64("token", "low", "high"))
    grouped = paired.select("gid", "low", "high", "block", "th", "n", "m", "pos", "label", "signature").repartition("gid").sortWithinPartitions("gid", "low", "high", "th")
    met = grouped.mapInArrow(_groups(percent), "a long, b long").distinct()
    return sets, _joined(labels, components(_between(verify(met, able, percent), labels)))


def classes(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sets, labels = text_classes(documents, size, percent)
    texts = sets.select("th", "n").join(labels.withColumnRenamed("node", "th"), "th", "left").select("th", "n", F.coalesce("label", "th").alias("label"))
    rows = documents.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("th"))
    joined = rows.join(texts, "th", "left")
    least = joined.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = joined.join(least, "label", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("doc_id", n.cast("long").alias("n_shingles"), F.when(n > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(documents: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each class, all columns kept: the least id (null last), then the least text hash; of rows repeated
    whole one. Documents without words are in no class and all stay."""
    sets, labels = text_classes(documents.select("doc_id", "text"), size, percent)
    texts = sets.where("n > 0").select("th").join(labels.withColumnRenamed("node", "th"), "th", "left").select("th", F.coalesce("label", "th").alias("label"))
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th")).groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    each = rows.join(texts, "th")
    first = each.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    marks = each.join(first, "label").select(F.col("doc_id").alias("__one_id"), F.col("th").alias("__one_text"), kept.alias("__one_kept"), "rows").where("NOT __one_kept OR rows > 1").drop("rows")
    marks = materialize(marks, "marks")
    plain = numbered(documents)  # no name of the input clashes with a mark
    own_id, own_text = (F.col(f"c{documents.columns.index(c)}") for c in ("doc_id", "text"))
    marked = plain.join(marks, own_id.eqNullSafe(F.col("__one_id")) & (F.xxhash64(own_text) == F.col("__one_text")), "left").where("__one_kept IS NULL OR __one_kept")
    once = marked.where("__one_kept").dropDuplicates(["__one_id", "__one_text"])  # repeated whole, or but for other columns
    return marked.where("__one_kept IS NULL").unionAll(once).drop("__one_id", "__one_text", "__one_kept").toDF(*documents.columns)
