"""Prefix trie of conversations and its subtree totals by an Euler tour.

``rebuild`` gives every conversation the first turns of its base conversation.
``build`` merges the rebuilt conversations into a trie: a node is a distinct
sequence of first turns. A sequence is known by its depth and two 64-bit keys,
the exclusive ors of the place-dependent hashes of its turns; the keys of a
prefix, and so the parent, come from taking the last turn's hash out again.

``subtree_totals`` lays the Euler tour: every node has an arc in and an arc out,
and the arc before each one follows from the children in order of conv_id. The
tour is list-ranked by pointer jumping (``listrank``), and what a subtree holds
is the difference of the prefix sums at its two arcs. Neither a path, a node's
children nor a conversation is ever gathered in one task: rows are ordered in
ranges of equal size and a range's first and last rows are linked by small
summaries.

Defined cases: turns are ordered by turn (null first), role, text; null role or
text is empty; equal turns are all kept. Rows without conv_id belong to no
conversation and are left out. A conversation whose rebuilt form has no turns is
a member of the root alone. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, in_ranges, staged
from tessera.llm.listrank import prefix_sums

GROUP = 100
HEADS = 6


def _head_turns(c: str) -> Column:
    """Turns that a conversation takes from its base: crc32 of its id, modulo."""
    return (F.crc32(F.col(c).cast("string").cast("binary")) % HEADS).cast("int")


def _item(k: str, d: str) -> Column:
    return F.xxhash64(F.lit(k), F.col(d), "role", "text")


def rebuild(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, ends). turns: conv_id, d, key1, key2 (of its first d turns),
    own1, own2 (hashes of turn d), role, text (null in turns taken from the
    base, whose own row has them), d = 0 included; ends: conv_id, d, key1, key2
    of every conversation's last turn."""
    rows = convs.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = in_ranges(rows.withColumn("_s", F.substring("text", 1, 40)), ["c", "turn", "role", "_s"], "turns")
    here = Window.partitionBy("_b", "c").orderBy("turn", "role", "text")
    before = Window.partitionBy("c").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.groupBy("_b", "c").agg(F.count("*").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = staged(rows.withColumn("p", F.row_number().over(here)).join(part.select("_b", "c", "skip"), ["_b", "c"])
                  .withColumn("p", (F.col("p") + F.col("skip")).cast("int")).drop("skip", "_s", "turn"), "placed")
    # the first turns of the base conversations, as keys of growing prefixes: six at most
    first = rows.where(F.col("c") % GROUP == 0).where(F.col("p") < HEADS).withColumns({"i1": _item("a", "p"), "i2": _item("b", "p")})
    fold = lambda f: f"aggregate(slice(i, 1, x), 0L, (s, t) -> s ^ t.{f})"
    base = first.groupBy(F.col("c").alias("b")).agg(F.sort_array(F.collect_list(F.struct("p", "i1", "i2"))).alias("i")).select(
        "b", "i", F.expr(f"transform(sequence(1, size(i)), x -> struct({fold('i1')} as k1, {fold('i2')} as k2))").alias("k"))
    # a base conversation is itself: all its turns are its own
    conv = rows.groupBy("c").agg(F.count("*").alias("n")).withColumns({"b": F.col("c") - F.col("c") % GROUP, "h": F.when(F.col("c") % GROUP == 0, 0).otherwise(_head_turns("c"))})
    conv = staged(conv.join(base, "b", "left").select(
        "c", "h", "n", F.expr("slice(i, 1, h)").alias("i"), F.expr("slice(k, 1, h)").alias("k"),
        F.least("h", F.coalesce(F.size("k"), F.lit(0))).alias("hb")).withColumn(
        "hb", F.when(F.col("k").isNull(), 0).otherwise(F.col("hb"))), "bases")
    end = F.when(F.col("hb") > 0, F.element_at("k", F.greatest("hb", F.lit(1))))
    own = rows.join(conv.select("c", "h", "hb", F.coalesce(end["k1"], F.lit(0)).alias("b1"), F.coalesce(end["k2"], F.lit(0)).alias("b2")), "c")
    own = own.where("p > h").withColumn("d", F.col("p") - F.col("h") + F.col("hb"))
    own = own.withColumns({"i1": _item("a", "d"), "i2": _item("b", "d")})
    here = Window.partitionBy("_b", "c").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = staged(own.withColumns({"x1": F.bit_xor("i1").over(here), "x2": F.bit_xor("i2").over(here)}).select(
        "_b", "c", "d", "x1", "x2", "i1", "i2", "b1", "b2", "role", "text"), "own")
    part = own.groupBy("_b", "c").agg(F.bit_xor("i1").alias("t1"), F.bit_xor("i2").alias("t2"))
    part = part.select("_b", "c", *(F.coalesce(F.bit_xor(t).over(before), F.lit(0)).alias(s) for t, s in (("t1", "s1"), ("t2", "s2"))))
    own = own.join(part, ["_b", "c"]).select(
        F.col("c").alias("conv_id"), "d", *(F.expr(f"x{k} ^ s{k} ^ b{k}").alias(f"key{k}") for k in (1, 2)),
        F.col("i1").alias("own1"), F.col("i2").alias("own2"), "role", "text")
    none = F.lit(None).cast("string")
    root = conv.select(F.col("c").alias("conv_id"), F.lit(0).alias("d"), *(F.lit(0).cast("long").alias(x) for x in ("key1", "key2", "own1", "own2")),
                       none.alias("role"), none.alias("text"))
    taken = conv.where("hb > 0").select(F.col("c").alias("conv_id"), F.expr("inline(arrays_zip(i, k))")).select(
        "conv_id", F.col("i.p").alias("d"), F.col("k.k1").alias("key1"), F.col("k.k2").alias("key2"),
        F.col("i.i1").alias("own1"), F.col("i.i2").alias("own2"), none.alias("role"), none.alias("text"))
    turns = staged(root.unionAll(taken).unionAll(own), "rebuilt")
    discard(rows)
    # n, h and hb tell each conversation's depth: no row of it need be looked at
    depth = conv.select(F.col("c").alias("conv_id"), (F.col("hb") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("d"))
    return turns, turns.select("conv_id", "d", "key1", "key2").join(depth, ["conv_id", "d"])


def build(turns: DataFrame) -> DataFrame:
    """Nodes: nid (unique), conv_id (smallest member), d, key1, key2, up1, up2
    (the parent's keys), n_convs, role and text of the last turn."""
    nodes = turns.groupBy("d", "key1", "key2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("own1").alias("own1"), F.max("own2").alias("own2"),
        F.max("role").alias("role"), F.max("text").alias("text"))
    return staged(nodes.select(F.monotonically_increasing_id().alias("nid"), "conv_id", "d", "key1", "key2",
                               F.expr("key1 ^ own1").alias("up1"), F.expr("key2 ^ own2").alias("up2"), "n_convs", "role", "text"), "nodes")


def subtree_totals(nodes: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """Nodes (without texts) with parent_conv_id, n_children and, for every
    weight, its sum over the node's subtree. A weight may use n_children."""
    up = nodes.select(F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"), (F.col("d") + 1).alias("d"),
                      F.col("key1").alias("up1"), F.col("key2").alias("up2"))
    kids = nodes.where("d > 0").select("nid", "conv_id", "d", "up1", "up2").join(up, ["d", "up1", "up2"])
    kids = in_ranges(kids.select("nid", "conv_id", "parent", "parent_conv_id"), ["parent", "conv_id"], "kids")
    # children in order: inside a range, and from range to range by one row per (range, parent)
    here = Window.partitionBy("_b", "parent").orderBy("conv_id")
    before = Window.partitionBy("parent").orderBy("_b")
    part = kids.groupBy("_b", "parent").agg(F.max_by("nid", "conv_id").alias("last"), F.count("*").alias("n"))
    total = part.groupBy("parent").agg(F.sum("n").alias("n_children"), F.max_by("last", "_b").alias("last"))
    part = part.select("_b", "parent", F.lag("last").over(before).alias("left"))
    kids = kids.withColumn("elder", F.lag("nid").over(here)).join(part, ["_b", "parent"]).select(
        "nid", "parent", "parent_conv_id", F.coalesce("elder", "left").alias("elder"))
    flat = nodes.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).drop("role", "text")
    flat = flat.join(kids, "nid", "left").join(total.withColumnRenamed("parent", "nid"), "nid", "left")
    flat = staged(flat.withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumns(weights), "flat")
    names = list(weights)
    # arc into a node: 2 nid, after the elder sibling's arc out or the parent's arc in; arc out: 2 nid + 1
    into = flat.select((F.col("nid") * 2).alias("id"), F.coalesce(F.col("elder") * 2 + 1, F.col("parent") * 2).alias("prev"), *names)
    out = flat.select((F.col("nid") * 2 + 1).alias("id"), F.coalesce(F.col("last") * 2 + 1, F.col("nid") * 2).alias("prev"),
                      *(F.lit(0).cast("long").alias(w) for w in names))
    arcs = staged(into.unionAll(out), "arcs")
    sums = prefix_sums(arcs, names)
    span = sums.groupBy(F.expr("id div 2").alias("nid")).agg(*(
        (F.max(F.when(F.col("id") % 2 == 1, F.col(w))) - F.max(F.when(F.col("id") % 2 == 0, F.col(w)))).alias(f"_{w}") for w in names))
    return flat.join(span, "nid").select(
        "nid", "conv_id", "d", "key1", "key2", "parent_conv_id", "n_convs", "n_children",
        *((F.col(f"_{w}") + F.col(w)).alias(w) for w in names))


def ends_digest(ends: DataFrame) -> DataFrame:
    """d, key1, key2, ends_sha256: digest of the ids of the conversations that
    end in a node, ascending, comma-joined. Ids are ordered and joined in ranges;
    a node's pieces are then digested one after the other, none kept."""
    keys = ["d", "key1", "key2"]
    cut = in_ranges(ends.select(*keys, "conv_id"), [*keys, "conv_id"], "ends")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for b in batches:
            ids: dict = {}
            for *at, c, part in zip(*(b.column(x).to_pylist() for x in range(5))):
                ids.setdefault((*at, part), []).append(str(c))
            if ids:
                cols = list(zip(*((*at, k, ",".join(v)) for at, v in ids.items())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                                                 ["d", "key1", "key2", "b", "k", "ids"])
            k += 1

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for b in batches:
            done = []
            for at, ids in zip(zip(*(b.column(x).to_pylist() for x in range(3))), b.column(5)):
                if at != last:
                    if h:
                        done.append((*last, h.hexdigest()))
                    last, h = at, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.as_py().encode())
            if done:
                yield _digests(done)
        if h:
            yield _digests([(*last, h.hexdigest())])

    def _digests(rows: list) -> pa.RecordBatch:
        cols = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.string()))],
                                          [*keys, "ends_sha256"])

    # one row per range, node and Arrow batch
    joined = cut.repartition(F.col("_b")).sortWithinPartitions("_b", *keys, "conv_id").select(*keys, "conv_id", "_b").mapInArrow(
        join, "d int, key1 long, key2 long, b int, k int, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "b", "k").mapInArrow(digest, "d int, key1 long, key2 long, ends_sha256 string")


def trie(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes as ``build`` gives them plus parent_conv_id,
    n_children, n_leaves and saved_tokens of their subtrees; ends: the node
    (conv_id, d, key1, key2) where each conversation ends."""
    turns, ends = rebuild(convs)
    nodes = build(turns)
    totals = subtree_totals(nodes, {
        "n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")})
    last = nodes.select("nid", "role", "text")
    return totals.join(last, "nid"), ends
