"""Linked lists in DataFrames: prefix sums along a list, chains and their heads.

A list is a table of items with a long ``id`` and the id of the item before
(``prev``, null at the head). Both functions jump pointers: a round joins the
items that have not arrived yet with the items they point at, so that every
pointer goes twice as far. Each item is pointed at by one item at most, so no
join has a hot key. Rounds are staged, and the table before is removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, staged

RULER = 32
LOCAL = 100_000


def _is_ruler(col: str, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.col(col)), F.lit(RULER)) == 0


def _one_task(items: DataFrame, weights: list[str]) -> DataFrame:
    """Prefix sums of a list of at most ``LOCAL`` items."""
    schema = "id long, " + ", ".join(f"{w} long" for w in weights)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(parts)
        if not parts:
            return
        t = pd.concat(parts, ignore_index=True)
        at = pd.Index(t["id"]).get_indexer(t["prev"].fillna(-1).astype("int64"))
        total = t[weights].to_numpy(np.int64)
        while (at >= 0).any():
            live = np.flatnonzero(at >= 0)
            add, to = total[at[live]], at[at[live]]
            total[live] += add
            at[live] = to
        yield pd.DataFrame({"id": t["id"], **{w: total[:, k] for k, w in enumerate(weights)}})

    return items.select("id", "prev", *weights).repartition(1).mapInPandas(run, schema)


def prefix_sums(items: DataFrame, weights: list[str], level: int = 0) -> DataFrame:
    """``id`` and the sums of ``weights`` (long) from the head of its list up to
    and with the item. ``items``: id (long, unique, not negative), prev, weights.

    About one item in ``RULER`` is a ruler. Pointers jump until they arrive at a
    ruler or at the head, the rulers alone are a list ``RULER`` times shorter,
    which is summed in the same way, down to a list of at most ``LOCAL`` items.
    """
    items = items.select("id", "prev", *weights)
    if items.count() <= LOCAL:
        return _one_task(items, weights)
    open_ = F.col("prev").isNotNull() & ~_is_ruler("prev", level)
    cur = staged(items.withColumn("open", open_), "list")
    while not cur.where("open").isEmpty():
        to = cur.select(F.col("id").alias("at"), F.col("prev").alias("_prev"), F.col("open").alias("_open"),
                        *(F.col(w).alias(f"_{w}") for w in weights))
        moved = cur.where("open").join(to, F.col("prev") == F.col("at")).select(
            "id", F.col("_prev").alias("prev"), *((F.col(w) + F.col(f"_{w}")).alias(w) for w in weights),
            F.col("_open").alias("open"))
        nxt = staged(cur.where("not open").unionAll(moved.select(cur.columns)), "list")
        discard(cur)
        cur = nxt
    ruler = staged(prefix_sums(cur.where(_is_ruler("id", level)), weights, level + 1), "rulers")
    before = ruler.select(F.col("id").alias("at"), *(F.col(w).alias(f"_{w}") for w in weights))
    rest = cur.where(~_is_ruler("id", level)).join(before, F.col("prev") == F.col("at"), "left").select(
        "id", *((F.col(w) + F.coalesce(f"_{w}", F.lit(0))).alias(w) for w in weights))
    return ruler.unionAll(rest)


def chains(items: DataFrame) -> DataFrame:
    """``id``, ``head`` (the first item of its chain) and ``rank`` (items before
    it). A ring is opened before its smallest id."""
    cur = staged(items.select("id", F.col("prev").alias("to"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("rank"),
                              F.coalesce("prev", "id").alias("far"), F.coalesce(F.least("id", "prev"), "id").alias("low")), "chains")
    # to: where to look next (null: far is the head); low: least id on the way
    left, lows = None, None
    while True:
        live = cur.where("to is not null")
        now, sums = live.agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if not now or (now, sums) == (left, lows):
            break
        left, lows = now, sums
        nxt = cur.select(F.col("id").alias("at"), F.col("to").alias("_to"), F.col("rank").alias("_rank"),
                         F.col("far").alias("_far"), F.col("low").alias("_low"))
        moved = live.join(nxt, F.col("to") == F.col("at")).select(
            "id", F.col("_to").alias("to"), (F.col("rank") + F.col("_rank")).alias("rank"), F.col("_far").alias("far"),
            F.least("low", "_low").alias("low"))
        new = staged(cur.where("to is null").unionAll(moved), "chains")
        discard(cur)
        cur = new
    done = cur.where("to is null").select("id", F.col("far").alias("head"), "rank")
    if not now:
        return done
    # what is left lies on rings: as soon as no least id changes, low is the ring's
    rings = staged(cur.where("to is not null").select("id", "low").join(items.select("id", "prev"), "id"), "rings")
    return done.unionAll(chains(rings.select("id", F.when(F.col("id") == F.col("low"), F.lit(None)).otherwise(F.col("prev")).alias("prev"))))
