"""Balanced label propagation of documents onto shards (DataFrame joins only).

Linked documents (equal texts) start on hashed shards, the votes of their
group. In each round every group that still moves asks for one shard: the one
that holds most of its documents among those with room for all that are left
of the group. A group too large for every shard asks for the roomiest one, cell
by cell; a cell is a hashed slice of a group larger than a fraction of a shard,
so that a huge group is neither one row nor one task. A shard takes what it
is asked for, larger groups first, as far as its quota reaches; what it refuses
asks again in the next round, against the room then left. A shard that refuses
something keeps at most two thirds of its room, so rounds are few; they end
when no group is left or no cell fits. Quotas count taken documents only, so a
table made of copies does not start full. Then shards are made even: surplus
documents, none of them taken by a quota, go to shards with room, so that
counts are at most one apart.

Running numbers (quotas, surplus, slots) use sums over hash buckets and
positions within a bucket; the number of buckets follows the number of rows.
Only per-shard totals reach the driver.

Defined cases: null text is a group of its own (size 1, CRC of nothing); equal
rows are documents of one group; fewer documents than shards leave shards
empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import staged

BUCKET_ROWS = 50_000
CELLS = 64


def running(df: DataFrame, part: list[str], bucket: Column, order: list, weight: Column, name: str) -> DataFrame:
    """``name``: the weight of all rows of ``part`` before this one, ordered by
    bucket and ``order``; no window holds more than a bucket."""
    b = df.withColumn("__b", bucket).withColumn("__w", weight)
    head = b.groupBy(*part, "__b").agg(F.sum("__w").alias("__n")).withColumn(
        "__off", F.coalesce(F.sum("__n").over(W.partitionBy(*part).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("__w").over(W.partitionBy(*part, "__b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("__w")
    return (b.withColumn("__in", inside).join(head.drop("__n"), [*part, "__b"])
            .withColumn(name, (F.col("__off") + F.col("__in")).cast("long")).drop("__b", "__w", "__in", "__off"))


def _bucket(key: str, rows: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col(key)), F.lit(max(1, -(-rows // BUCKET_ROWS))))


def _lookup(values: dict[int, int], key: str) -> Column:
    """A small per-shard table as a literal map."""
    pairs = [F.lit(x) for k, v in values.items() for x in (int(k), int(v))]
    return F.element_at(F.create_map(*pairs), F.col(key))


def _ask(free: dict[int, int], shards: int) -> Column:
    """The shard a group asks for: (fits, ..., dst) from its rows and votes."""
    room = F.array(*[F.lit(int(free[s])).cast("long") for s in range(shards)])

    def option(s: Column) -> Column:
        fits, votes = F.get(room, s) >= F.col("rows"), F.get("votes", s)
        return F.struct(fits.alias("fits"), F.when(fits, votes).otherwise(F.get(room, s)).alias("first"),
                        votes.alias("second"), F.xxhash64("g1", s).alias("tie"), s.alias("dst"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), option))


def propagate(linked: DataFrame, shards: int, room: int) -> DataFrame:
    """``linked``: g1, g2 (group), cell, shard (start) of each document.
    Returns the shard (``home``) of each cell that a quota has taken; no shard
    gets more than ``room`` documents."""
    start = linked.groupBy("g1", "g2", "cell", "shard").agg(F.count("*").alias("n"))
    start = staged(start, "votes")
    by_shard = F.map_from_entries(F.collect_list(F.struct("shard", "n")))       # an entry per shard
    votes = (start.groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")).groupBy("g1", "g2").agg(by_shard.alias("m"))
             .select("g1", "g2", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)),
                                             lambda s: F.coalesce(F.try_element_at("m", s), F.lit(0))).alias("votes")))
    cells = start.groupBy("g1", "g2", "cell").agg(F.sum("n").alias("n"))
    left = staged(cells.join(votes, ["g1", "g2"]), "cells")
    homes, free = None, dict.fromkeys(range(shards), room)
    for _ in range(64 * shards):
        groups = left.groupBy("g1", "g2").agg(F.sum("n").alias("rows"), F.first("votes").alias("votes"))
        asks = groups.select("g1", "g2", "rows", _ask(free, shards).alias("a")).select("g1", "g2", "rows", "a.fits", "a.dst")
        parts = left.join(asks.where("not fits"), ["g1", "g2"]).select("g1", "g2", "cell", "dst", "rows", "n")
        units = (asks.where("fits").select("g1", "g2", F.lit(None).cast("long").alias("cell"), "dst", "rows", F.col("rows").alias("n"))
                 .unionAll(parts.where(F.col("n") <= _lookup(free, "dst"))))
        units = staged(units.withColumn("gh", F.xxhash64("g1", "g2")), "asks")
        n_units = units.count()
        if not n_units:
            return homes if homes is not None else left.limit(0).select("g1", "g2", "cell", F.lit(0).alias("home"))
        buckets = max(1, -(-n_units // BUCKET_ROWS))
        large_first = F.lit(64) - F.floor(F.log2("rows"))
        taken = staged(running(units, ["dst"], large_first * buckets + _bucket("gh", n_units), ["gh", "g2", "cell"], F.col("n"), "before")
                       .where(F.col("before") + F.col("n") <= _lookup(free, "dst")), "taken")
        whole = taken.where("cell is null").select("g1", "g2", F.col("dst").alias("d1"))
        sliced = taken.where("cell is not null").select("g1", "g2", "cell", F.col("dst").alias("d2"))
        after = staged(left.join(whole, ["g1", "g2"], "left").join(sliced, ["g1", "g2", "cell"], "left")
                       .withColumn("home", F.coalesce("d1", "d2")).drop("d1", "d2"), "cells")
        for r in taken.groupBy("dst").agg(F.sum("n").alias("n")).collect():
            free[r["dst"]] -= r["n"]
        done = after.where("home is not null").select("g1", "g2", "cell", "home")
        homes = done if homes is None else homes.unionAll(done)
        left = after.where("home is null").drop("home")
    raise RuntimeError("propagation did not settle")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 1), crc, group (g1,
    g2), group_rows, shard, slot. Counts per shard are at most one apart."""
    text = F.col(text_col).cast("string")
    base = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.xxhash64(text, text.isNull()).alias("g1"), F.xxhash64(F.lit("second"), text, F.length(text)).alias("g2"),
    ).withColumn("h", F.xxhash64("id", "g1"))
    base = staged(base, "sizes")
    total = base.count()
    cell_rows = max(1, total // (shards * CELLS))
    groups = base.groupBy("g1", "g2").agg(F.count("*").alias("rows")).where("rows > 1")
    start = F.pmod(F.xxhash64(F.lit("start"), "h"), F.lit(shards)).cast("int")
    rows = base.join(groups, ["g1", "g2"], "left").withColumn("shard", start)
    cells = F.greatest(F.lit(1), F.ceil(F.col("rows") / cell_rows))
    linked = rows.where("rows is not null").withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "h"), cells).cast("long"))
    homes = propagate(linked.select("g1", "g2", "cell", "shard"), shards, total // shards)
    linked = (linked.join(homes, ["g1", "g2", "cell"], "left")
              .withColumn("linked", F.col("home").isNotNull()).withColumn("shard", F.coalesce("home", "shard")))
    cols = ["id", "size", "crc", "g1", "g2", "h", "shard", "linked"]
    placed = staged(rows.where("rows is null").withColumn("linked", F.lit(False)).select(*cols).unionAll(linked.select(*cols)), "placed")
    load = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    load = {s: load.get(s, 0) for s in range(shards)}
    order = sorted(load, key=lambda s: (-load[s], s))
    want = {s: total // shards + (k < total % shards) for k, s in enumerate(order)}
    surplus = {s: max(0, load[s] - want[s]) for s in load}
    first, at = {}, 0
    for s in surplus:
        first[s] = at
        at += surplus[s]
    # surplus documents in a row; the shards with room take intervals of it
    dst, at = F.lit(None).cast("int"), 0
    for s in sorted(load, reverse=True):
        need = max(0, want[s] - load[s])
        if need:
            dst = F.when((F.col("__k") >= at) & (F.col("__k") < at + need), F.lit(s)).otherwise(dst)
            at += need
    nb = max(1, -(-total // BUCKET_ROWS))
    ranked = running(placed, ["shard"], F.when(F.col("linked"), F.lit(nb)).otherwise(F.lit(0)) + _bucket("h", total),
                     ["h", "id", "crc"], F.lit(1), "rank")
    even = (ranked.withColumn("__k", F.when(F.col("rank") < _lookup(surplus, "shard"), F.col("rank") + _lookup(first, "shard")))
            .withColumn("shard", F.coalesce(dst, F.col("shard"))).drop("rank", "__k"))
    return running(staged(even, "even"), ["shard"], _bucket("h", total), ["h", "id", "crc"], F.lit(1), "slot")
