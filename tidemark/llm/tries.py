"""A trie of conversations by their turns, and sums over its subtrees by heavy paths.

1. Turns are numbered within conversations and each prefix gets a name: sums of hashes of (place, role, text) up to the turn,
   in four columns, so that names are window sums and need no chain. Conversations with the same name at the same depth are
   members of one node; the node is known by its smallest member and its depth.
2. Heavy paths. Each node's largest child (members; ties to the smaller conv_id) goes on with its path, the others begin
   paths of their own. The chain of a node's smallest member runs through all its ancestors, so a running count and a running
   maximum along it give the light edges above a node and the top of its path.
3. Sums. A light edge at least halves the members, so there are at most log2(conversations) light edges above any node.
   Rounds go from the paths with most light edges above them to the root's: sums from the end along the path's array, and the
   total of a path is added to the parent of its top.

Running sums work in stretches of SCAN_ROWS rows, then over the stretches' totals, so a conversation or a path of any length
needs no task that holds it. The conv_ids that end at a node are hashed as a sorted stream, never as a list in memory.

Cases: null conv_id names no conversation, such rows are left out; null turn comes first; equal turns go by role, then text;
null role or text is empty; repeated rows are turns of their own; a conversation that ends up without turns is a member of the
root alone; an empty table has no node, the root neither; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

SCAN_ROWS = 1 << 12
NAME = ("k0", "k1", "k2", "k3")


def scan(df: DataFrame, key: list[str], place: str, parts: dict[str, tuple[str, str]], down: bool = True, rows: int = SCAN_ROWS) -> DataFrame:
    """Running `sum` or `max` of columns along integer places (out: (function, column)); up to a place, or from it on."""
    f = {"sum": F.sum, "max": F.max}
    way = (lambda c: F.asc(c)) if down else (lambda c: F.desc(c))
    df = df.withColumn("__stretch", F.floor(F.col(place) / rows).cast("long"))
    near = Window.partitionBy(*key, "__stretch").orderBy(way(place)).rowsBetween(Window.unboundedPreceding, 0)
    far = Window.partitionBy(*key).orderBy(way("__stretch")).rowsBetween(Window.unboundedPreceding, -1)
    total = df.groupBy(*key, "__stretch").agg(*(f[how](c).alias(f"__t_{out}") for out, (how, c) in parts.items()))
    before = total.select(*key, "__stretch", *(f[how](f"__t_{out}").over(far).alias(f"__b_{out}") for out, (how, c) in parts.items()))
    # most keys have one stretch: only what has something before it is joined
    before = before.where(" OR ".join(f"__b_{out} IS NOT NULL" for out in parts))
    local = df.withColumns({f"__l_{out}": f[how](c).over(near) for out, (how, c) in parts.items()})
    both = local.join(before, [*key, "__stretch"], "left")
    add = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}
    done = {out: add[how](F.col(f"__l_{out}"), F.col(f"__b_{out}")) for out, (how, _) in parts.items()}
    return both.withColumns(done).drop("__stretch", *(f"__{x}_{out}" for x in "lb" for out in parts))


def numbered_turns(conversations: DataFrame, rows: int = SCAN_ROWS) -> DataFrame:
    """(conv_id, i, role, text): turns numbered from 1 in order of turn (null first), role, text.

    Turns are counted by ranges of `rows` turn numbers first, so that a long conversation is numbered by many tasks; only rows
    with one and the same conversation and turn range stay together."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    t = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    t = t.withColumn("__range", F.coalesce(F.floor(F.col("turn") / rows).cast("long"), F.lit(-(1 << 62))))
    near = Window.partitionBy("conv_id", "__range").orderBy(F.asc_nulls_first("turn"), "role", "text")
    far = Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = t.groupBy("conv_id", "__range").agg(F.count("*").alias("n")).select("conv_id", "__range", F.coalesce(F.sum("n").over(far), F.lit(0)).alias("ahead"))
    own = t.withColumn("__near", F.row_number().over(near)).join(ahead, ["conv_id", "__range"])
    return own.select("conv_id", (F.col("__near") + F.col("ahead")).alias("i"), "role", "text")


def rebuild(turns: DataFrame, group: int = 5, span: int = 9) -> DataFrame:
    """(conv_id, i, role, text) of conversations rebuilt: the first h turns of conversation c - c % group, then c's own after its
    first h, h = crc32(c) % span; turnless ones are left out."""
    head = lambda c: F.crc32(c.cast("string")) % span
    c = F.col("conv_id")
    ids = turns.select("conv_id").distinct().select(c, (c - c % group).alias("base"), head(c).alias("h"))
    heads = turns.where(F.col("i") < span).select(c.alias("base"), "i", "role", "text")  # fewer than `span` rows a conversation
    first = ids.join(heads, "base").where("i <= h").select("conv_id", "i", "role", "text")
    had = turns.where(F.col("i") < span).groupBy(c.alias("base")).agg(F.max("i").alias("most"))
    moved = ids.join(had, "base", "left").select("conv_id", (F.least("h", F.coalesce("most", F.lit(0))) - F.col("h")).alias("shift"))
    own = turns.withColumn("h", head(c)).where("i > h").join(moved, "conv_id").select("conv_id", (F.col("i") + F.col("shift")).alias("i"), "role", "text")
    return first.unionAll(own)


def prefixes(ids: DataFrame, turns: DataFrame, rows: int = SCAN_ROWS) -> DataFrame:
    """(conv_id, depth, k0..k3, bytes, last): each prefix of each conversation (ids: conv_id), the empty one too. A turn's
    hashes are cut to 40 bits, so sums over millions of turns neither overflow nor wrap; four of them name a prefix."""
    h = {k: F.xxhash64(F.lit(n), "i", "role", "text").bitwiseAND(F.lit((1 << 40) - 1)) for n, k in enumerate(NAME)}
    each = turns.select("conv_id", F.col("i").alias("depth"), F.octet_length("text").cast("long").alias("bytes"), *(v.alias(f"h{k}") for k, v in h.items()))
    named = scan(each, ["conv_id"], "depth", {k: ("sum", f"h{k}") for k in NAME}, rows=rows)
    zero = F.lit(0).cast("long")
    root = ids.select("conv_id", zero.alias("depth"), zero.alias("bytes"), *(zero.alias(k) for k in NAME))
    last = turns.groupBy("conv_id").agg(F.max("i").alias("n"))
    rows = named.select(root.columns).unionAll(root).join(last, "conv_id", "left")
    return rows.select("conv_id", "depth", *NAME, "bytes", (F.col("depth") == F.coalesce("n", zero)).alias("last"))


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, depth, conv_id), sorted, to the hash of each node's conv_ids: one node is open at a time."""
    schema = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    now, sha = None, None
    for b in batches:
        out = []
        for node, depth, c in zip(*(b.column(k).to_pylist() for k in ("node", "depth", "conv_id")), strict=True):
            if (node, depth) != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (node, depth), hashlib.sha256(b"%d" % c)
            else:
                sha.update(b",%d" % c)
        if out:
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if now is not None:
        yield pa.record_batch([[now[0]], [now[1]], [sha.hexdigest()]], schema=schema)


def members(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, last, node, n_convs, bytes): the node of each prefix, known by its smallest member, and its members."""
    each = materialize(rows.groupBy("depth", *NAME).agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes")), "nodes")
    return materialize(rows.drop("bytes").join(each, ["depth", *NAME]).select("conv_id", "depth", "last", "node", "n_convs", "bytes"), "members")


def heavy_paths(of: DataFrame, rows: int = SCAN_ROWS) -> DataFrame:
    """(node, depth, parent, n_convs, bytes, n_children, top, top_depth, level): nodes with the top of their path and the light
    edges above them."""
    own = of.where("conv_id = node").select("node", "depth", "n_convs", "bytes")
    parents = of.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    tree = materialize(own.join(parents, ["node", "depth"], "left"), "tree")
    best = tree.where("depth > 0").groupBy("parent", "depth").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("node")).alias("least"))).alias("b"))
    best = materialize(best.select("parent", "depth", "n_children", (-F.col("b.least")).alias("node")), "heavy")
    light = materialize(tree.select("node", "depth").join(best.select("node", "depth"), ["node", "depth"], "left_anti"), "light").withColumn("light", F.lit(True))
    # the chain of a smallest member runs through all ancestors of its nodes
    chains = of.select("conv_id", "depth", "node").join(own.select(F.col("node").alias("conv_id")).distinct(), "conv_id", "left_semi")
    marked = chains.join(light, ["node", "depth"], "left").select("conv_id", "depth", "node", F.when(F.col("light"), F.struct("depth", "node")).alias("t"), F.when(F.col("light"), 1).otherwise(0).cast("long").alias("one"))
    seen = scan(marked, ["conv_id"], "depth", {"top": ("max", "t"), "level": ("sum", "one")}, rows=rows).where("conv_id = node")
    seen = seen.select("node", "depth", F.col("top.node").alias("top"), F.col("top.depth").alias("top_depth"), "level")
    children = best.select(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"), "n_children")
    out = tree.join(seen, ["node", "depth"]).join(children, ["node", "depth"], "left")
    return materialize(out.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "paths")


def subtree_sums(nodes: DataFrame, values: dict[str, Column], rows: int = SCAN_ROWS) -> DataFrame:
    """(node, depth, the names of `values`): sums over each node's subtree, itself included."""
    names, path = list(values), ["top", "top_depth"]
    own = nodes.select("node", "depth", "level", *path, *(v.cast("long").alias(k) for k, v in values.items()))
    # a row for each path: its own sum, and the node that its top hangs on, with that node's path
    hung = nodes.where("node = top AND depth = top_depth AND depth > 0").select(*path, F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth"))
    hung = hung.join(nodes.select("node", "depth", F.col("top").alias("up"), F.col("top_depth").alias("up_depth")), ["node", "depth"])
    paths = materialize(own.groupBy(*path, "level").agg(*(F.sum(k).alias(k) for k in names)).join(hung, path, "left"), "paths")
    attached, below = None, None
    for level in range(paths.agg(F.max("level")).first()[0] or 1, 1, -1):
        now = paths.where(F.col("level") == level)
        if below is not None:
            now = now.join(below, path, "left").select(*path, "node", "depth", "up", "up_depth", *((F.col(k) + F.coalesce(f"b_{k}", F.lit(0))).alias(k) for k in names))
        now = materialize(now.select("node", "depth", "up", "up_depth", *names), "attached")
        below = now.groupBy(F.col("up").alias("top"), F.col("up_depth").alias("top_depth")).agg(*(F.sum(k).alias(f"b_{k}") for k in names))
        attached = now if attached is None else attached.unionAll(now)
    if attached is not None:
        more = attached.groupBy("node", "depth").agg(*(F.sum(k).alias(f"b_{k}") for k in names))
        own = own.join(more, ["node", "depth"], "left").select("node", "depth", *path, *((F.col(k) + F.coalesce(f"b_{k}", F.lit(0))).alias(k) for k in names))
    return scan(own, path, "depth", {f"s_{k}": ("sum", k) for k in names}, down=False, rows=rows).select("node", "depth", *(F.col(f"s_{k}").alias(k) for k in names))


def prefix_trie(conversations: DataFrame, group: int | None = 5, rows: int = SCAN_ROWS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node; group None takes
    conversations as they are, else they are rebuilt."""
    turns = numbered_turns(conversations, rows)
    turns = materialize(turns, "turns")
    ids = materialize(turns.select("conv_id").distinct(), "conversations")
    of = members(prefixes(ids, rebuild(turns, group) if group else turns, rows))
    tree = heavy_paths(of, rows)
    sums = subtree_sums(tree, {"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}, rows)
    ended = of.where("last").select("node", "depth", "conv_id").repartition("node", "depth").sortWithinPartitions("node", "depth", "conv_id")
    ends = ended.mapInArrow(_hash_ids, "node long, depth long, ends_sha256 string")
    out = tree.join(sums, ["node", "depth"]).join(ends, ["node", "depth"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
