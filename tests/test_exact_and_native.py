"""Medians by radix selection, sketches, encoding and vectors without Python
rows, pairs from basket arrays, feature pairing and model gates."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.operators import drift as D
from tessera.operators import evaluation as EV
from tessera.operators import graph as G
from tessera.operators import quality as Q
from tessera.operators import text_ops as TO
from tessera.operators import vectors as VX

SF = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_medians_of_all_columns(spark):
    rng = np.random.default_rng(4)
    cols = {"a": [*rng.normal(size=400), -0.0, 0.0, 1e300, -1e300, 5e-324], "b": [7.0] * 301 + [8.0] * 104, "c": [None] * 405,
            "d": [float(v) if i % 3 else None for i, v in enumerate(rng.integers(-5, 5, 405))], "e": [3.0] + [None] * 404}
    rows = [tuple(None if v is None else float(v) for v in r) for r in zip(*cols.values())]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    want = [float(np.median([v for v in x if v is not None])) if any(v is not None for v in x) else None for x in cols.values()]
    assert EV.exact_medians(df, list(cols)) == want
    assert EV.exact_medians(df.where("a > 1e301"), ["a", "b"]) == [None, None]


def test_passes_do_not_grow_with_columns(spark):
    df = spark.range(50).select(*[(F.col("id") * k).cast("double").alias(f"c{k}") for k in range(1, 7)])
    tracker = spark.sparkContext.statusTracker()

    def jobs(cols):
        spark.sparkContext.setJobGroup(f"medians-{len(cols)}", "")
        EV.exact_medians(df, cols)
        return len(tracker.getJobIdsForGroup(f"medians-{len(cols)}"))

    one, six = jobs(["c1"]), jobs([f"c{k}" for k in range(1, 7)])
    spark.sparkContext.setJobGroup("", "")
    assert abs(six - one) <= 2


def test_sketches_merge_within_two_per_cent(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("d"), (F.col("id") % 23_456).alias("u"))
    daily = Q.daily_sketches(df, F.col("d"), "u")
    assert daily.count() == 7
    assert abs(Q.merged_distinct(daily).first()[0] - 23_456) <= 0.02 * 23_456
    some = Q.merged_distinct(daily.where("day < 2")).first()[0]
    exact = df.where("d < 2").select("u").distinct().count()
    assert abs(some - exact) <= 0.02 * exact


def test_encoding_and_centroids_stay_in_the_jvm(spark):
    d = spark.createDataFrame([(1, "b a zz a"), (2, ""), (3, None)], "doc_id long, text string")
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "token string, idx long")
    got = TO.encode(d, "doc_id", "text", vocab)
    assert {r["doc_id"]: r["ids"] for r in got.where("doc_id < 3").collect()} == {1: [2, 1, 0, 1], 2: []}
    for x in ("Python", "Pandas", "Arrow", "Generate"):
        assert x not in plan(got)
    v = spark.createDataFrame([("x", [1.0, 2.0]), ("x", [3.0, 6.0]), ("y", [0.0, 1.0])], "label string, vec array<double>")
    c = EV.centroids(v, "vec", "label")
    assert {r["label"]: r["centroid"] for r in c.collect()} == {"x": [2.0, 4.0], "y": [0.0, 1.0]} and "Generate" not in plan(c)


def test_embeddings_are_sparse(spark):
    d = spark.createDataFrame([(1, "one two two"), (2, "three"), (3, "")], "doc_id long, text string")
    e = VX.embed_text(d, "text", 1 << 10)
    rows = {r["doc_id"]: r["embedding"] for r in e.collect()}
    assert len(rows[1]["indices"]) == 2 and rows[1]["size"] == 1024 and rows[3]["indices"] == []
    assert {r[0]: round(r[1], 9) for r in e.select("doc_id", VX.sparse_norm("embedding")).collect()} == {1: 1.0, 2: 1.0, 3: 0.0}


@pytest.mark.parametrize("block", [4, 64])
def test_pairs_from_arrays(spark, block):
    rng = random.Random(block)
    rows = [(0, f"i{k}") for k in range(50)] + [(b, f"i{rng.randint(0, 30)}") for b in range(1, 80) for _ in range(rng.randint(0, 6))]
    rows += [(None, "i1"), (3, None), (0, "i1")]
    df = spark.createDataFrame(rows, "b long, it string")
    sets = {}
    for b, it in rows:
        if b is not None and it is not None:
            sets.setdefault(b, set()).add(it)
    want = Counter(p for s in sets.values() for p in itertools.combinations(sorted(s), 2))
    assert {(r[0], r[1]): r[2] for r in G.basket_pairs(df, "b", "it", block=block).collect()} == dict(want)
    co = {(r["item_a"], r["item_b"]): r for r in G.co_purchase(df, "b", "it", 2, block=block).collect()}
    assert set(co) == {p for p, n in want.items() if n >= 2}
    a, b = next(iter(co))
    own = sum(a in s for s in sets.values()), sum(b in s for s in sets.values())
    assert co[a, b]["lift"] == pytest.approx(want[a, b] * len(sets) / (own[0] * own[1]))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0         # nothing left cached


def test_features_pair_by_name_and_kind(spark):
    b = spark.createDataFrame([(1, 1.0, "x", 5)], "id long, v double, kind string, old int")
    c = spark.createDataFrame([(1, 2.0, 3.0, 5)], "id long, v float, kind double, new int")
    assert D.pair_features(b, c, ["id"]) == [("v", True, True), ("old", True, False), ("kind", False, True), ("new", False, True)]
    got = {r["feature"]: r["psi"] for r in D.paired_psi(b, c, ["id"]).collect()}
    assert got["v"] is not None and [got[f] for f in ("old", "kind", "new")] == [None] * 3
    none = D.paired_psi(b.select("old"), c.select("new")).collect()
    assert [(r["feature"], r["psi"]) for r in none] == [("old", None), ("new", None)]


def test_status_per_model(spark):
    m = spark.createDataFrame([("churn_auc_roc", 0.9), ("churn_f1", 0.5), ("demand_mape", 12.0)], "metric string, value double")
    got = {r["model"]: (r["status"], r["failed_gates"], r["recommendation"]) for r in EV.model_status(EV.quality_report(m)).collect()}
    assert got == {"churn_propensity": ("FAIL", ["churn_f1"], "HOLD"), "demand_forecasting": ("PASS", [], "HOLD"),
                   "customer_segmentation": ("FAIL", ["segmentation_silhouette"], "HOLD")}


def test_every_query_plans_without_cross_joins(spark):
    for name in ("v3_customer_topk", "j10_paired_features", "p8_balance_tier_counts", "p5_filled_features", "f3_batch_scores",
                 "g2_co_purchase_names", "t9_encode", "s5_replayed_loads"):
        text = plan(E.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
