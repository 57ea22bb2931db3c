"""Distributed-order helpers and the split-basket pair join against brute force."""

import itertools
import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import scale as S


def test_ordered_positions_match_row_number(spark):
    rnd = random.Random(1)
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(seconds=rnd.randint(0, 5000)), rnd.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, k long")
    got = {r["id"]: r["position"] for r in S.ordered_positions(df, "ts", "id", "minute").collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want
    got_k = {r["id"]: r["position"] for r in S.ordered_positions(df, "ts", "id", "minute", key="k").collect()}
    for k in range(4):
        sub = sorted([r for r in rows if r[2] == k], key=lambda r: (r[1], r[0]))
        assert all(got_k[r[0]] == i for i, r in enumerate(sub))


def test_sessionize_matches_brute_force(spark):
    rnd = random.Random(2)
    t0 = datetime(2024, 1, 1)
    rows = []
    for u in range(3):
        t = t0
        for i in range(80):
            t += timedelta(minutes=rnd.choice([1, 5, 29, 30, 31, 90, 600]))
            rows.append((u * 1000 + i, u, t))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    got = {r["event_id"]: r["session_id"] for r in S.sessionize(df, "user_id", "ts", 1800, "event_id").collect()}
    for u in range(3):
        ev = sorted([r for r in rows if r[1] == u], key=lambda r: (r[2], r[0]))
        sid, prev = 0, None
        for e in ev:
            if prev is None or (e[2] - prev).total_seconds() >= 1800:
                sid += 1
            prev = e[2]
            assert got[e[0]] == sid


def test_dense_ids(spark):
    vals = [5, 900, 17, 17, 123456, 42]
    df = spark.createDataFrame([(v,) for v in vals], "u long")
    got = {r["u"]: r["u_idx"] for r in S.dense_ids(df, "u").collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(vals)))}


def test_basket_pairs_hot_basket(spark):
    # one basket holds a large share of all rows: it must take the split path
    rnd = random.Random(3)
    rows = [(0, i) for i in range(60)]                       # hot basket, 60 items
    rows += [(b, rnd.randint(0, 80)) for b in range(1, 200) for _ in range(rnd.randint(1, 4))]
    df = spark.createDataFrame(rows, "b long, it long")
    got = {(r["item_a"], r["item_b"]): r["support"] for r in G.basket_pairs(df, "b", "it", 1, block=8).collect()}
    baskets = {}
    for b, it in rows:
        baskets.setdefault(b, set()).add(it)
    want = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2))
    assert got == dict(want)
    got2 = {(r["item_a"], r["item_b"]): r["support"] for r in G.basket_pairs(df, "b", "it", 2, block=8).collect()}
    assert got2 == {k: v for k, v in want.items() if v >= 2}


def test_co_purchase_measures(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "c")]
    df = spark.createDataFrame(rows, "o long, it string")
    r = G.co_purchase(df, "o", "it", 2).first()
    assert (r["item_a"], r["item_b"], r["support"]) == ("a", "b", 2)
    assert abs(r["confidence_ab"] - 2 / 3) < 1e-12 and r["confidence_ba"] == 1.0
    assert abs(r["lift"] - 2 * 4 / (3 * 2)) < 1e-12


def test_edge_search_fallback(spark):
    prods = spark.createDataFrame([(1, "red bolt", "A", 1.0, "x"), (2, "blue gear", "B", 2.0, "y"),
                                   (3, "old plate", "A", 3.0, "x")],
                                  "product_id long, name string, category string, price double, aisle string")
    co = spark.createDataFrame([(1, 2, 0.5, 0.7), (2, 3, 0.2, 0.1)],
                               "item_a long, item_b long, confidence_ab double, confidence_ba double")
    nodes, edges = G.product_graph(prods, co)
    hit = G.edge_search(nodes, edges, "show me red things").collect()
    assert {(r["product"], r["related_to"]) for r in hit} == {("red bolt", "blue gear"), ("blue gear", "red bolt")}
    none = G.edge_search(nodes, edges, "zebra").collect()
    assert len(none) == 4                                       # first 5 edges → all 4 product edges


def test_pairs_are_counted_in_tasks_of_bounded_size(spark, monkeypatch):
    """More rows and pairs make more tasks than the shuffle partitions of the session."""
    monkeypatch.setattr(G, "ROWS_EACH", 20)
    monkeypatch.setattr(G, "PAIRS_EACH", 30)
    rows = [(b, (b * 7 + i * i) % 23) for b in range(60) for i in range(4)] + [(None, 1), (1, None)] + [(99, i) for i in range(30)]
    df = spark.createDataFrame(rows, "b long, it long")
    out = G.basket_pairs(df, "b", "it", 1, block=8)
    baskets = {}
    for b, it in rows[:240] + rows[242:]:
        baskets.setdefault(b, set()).add(it)
    want = Counter(p for items in baskets.values() for p in itertools.combinations(sorted(items), 2))
    assert {(r["item_a"], r["item_b"]): r["support"] for r in out.collect()} == dict(want)
    assert out.rdd.getNumPartitions() > 4
