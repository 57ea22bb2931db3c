"""Vector scoring, ranking metrics, AUC, median, splits, gates, personas."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import c360 as C
from tessera.operators import evaluation as EV
from tessera.operators import models as MD
from tessera.operators import vectors as VX


def _vecs(spark, n, d, seed):
    rnd = np.random.default_rng(seed)
    X = rnd.normal(size=(n, d))
    return X, spark.createDataFrame([(i, [float(x) for x in X[i]]) for i in range(n)], "id long, vec array<double>")


def test_cosine_topk_blocks_match_numpy(spark):
    X, items = _vecs(spark, 120, 8, 1)
    Q, qs = _vecs(spark, 7, 8, 2)
    items = items.withColumnRenamed("id", "item_id")
    qs = qs.withColumnRenamed("id", "query_id")
    got = VX.cosine_topk(items, qs, 5, max_block=3).collect()   # 3 query blocks
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    Qn = Q / np.linalg.norm(Q, axis=1, keepdims=True)
    S = np.round(Xn @ Qn.T, 6)
    for q in range(7):
        want = sorted(range(120), key=lambda i: (-S[i, q], i))[:5]
        assert [r["item_id"] for r in sorted([r for r in got if r["query_id"] == q], key=lambda r: r["rank"])] == want


def test_score_all_excludes_seen(spark):
    X, items = _vecs(spark, 30, 4, 3)
    U, users = _vecs(spark, 5, 4, 4)
    items = items.withColumnRenamed("id", "item_id").withColumnRenamed("vec", "features")
    users = users.withColumnRenamed("id", "user_id").withColumnRenamed("vec", "features")
    S = np.round(U @ X.T, 6)
    seen = [(u, int(np.argmax(S[u]))) for u in range(5)]
    seen_df = spark.createDataFrame(seen, "user_id long, item_id long")
    got = VX.score_all(users, items, 3, seen=seen_df, max_block=7).collect()
    for u in range(5):
        mine = [r["item_id"] for r in sorted([r for r in got if r["user_id"] == u], key=lambda r: r["rank"])]
        want = [i for i in sorted(range(30), key=lambda i: (-S[u, i], i)) if (u, i) not in seen][:3]
        assert mine == want and seen[u][1] not in mine


def test_target_rank_and_metrics(spark):
    X, items = _vecs(spark, 40, 4, 5)
    U, users = _vecs(spark, 6, 4, 6)
    items = items.withColumnRenamed("id", "item_id").withColumnRenamed("vec", "features")
    users = users.withColumnRenamed("id", "user_id").withColumnRenamed("vec", "features")
    rows = spark.createDataFrame([(u, u, (u * 7) % 40) for u in range(6)] + [(99, 0, 999)],
                                 "row_id long, user_id long, item_id long")
    got = {r["row_id"]: r["rank"] for r in VX.target_rank(rows, users, items, max_block=9).collect()}
    S = np.round(U @ X.T, 6)
    for u in range(6):
        t = (u * 7) % 40
        assert got[u] == 1 + sum(1 for i in range(40) if S[u, i] > S[u, t] or (S[u, i] == S[u, t] and i < t))
    assert got[99] is None
    m = VX.rank_metrics(VX.target_rank(rows, users, items)).first()
    ranks = [got[u] for u in range(6)]
    assert abs(m["mrr"] - sum(1 / r for r in ranks) / 7) < 1e-12
    assert abs(m["hit_rate_at_10"] - sum(r <= 10 for r in ranks) / 7) < 1e-12


def test_auc_with_ties(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.8, 1), (0.2, 1), (0.2, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(EV.auc(df, "s", "y").first()["auc"] - want) < 1e-9


def test_exact_median(spark):
    vals = [random.Random(9).random() for _ in range(1001)] + [None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    assert EV.exact_median(df, "x") == float(np.median([v for v in vals if v is not None]))
    df2 = spark.createDataFrame([(1.0,), (3.0,), (2.0,), (10.0,)], "x double")
    assert EV.exact_median(df2, "x") == 2.5


def test_stratified_split_exact_counts(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1000)], "id long, y int")
    got = MD.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()
    c = {(r["y"], r["split"]): r["count"] for r in got}
    assert c[(1, "test")] == round(334 * 0.2) and c[(0, "test")] == round(666 * 0.2 + 1e-9)


def test_quality_report(spark):
    m = spark.createDataFrame([("churn_auc_roc", 0.8), ("churn_f1", 0.6), ("segmentation_silhouette", 0.31)],
                              "metric string, value double")
    got = {r["gate"]: r for r in EV.quality_report(m).collect()}
    assert got["churn_auc_roc"]["status"] == "PASS" and got["demand_mape"]["status"] == "FAIL"
    assert got["churn_f1"]["recommendation"] == "HOLD"


def test_churn_risk_branches(spark):
    df = spark.createDataFrame([(1, True, True, 0), (2, True, False, 5), (3, False, False, 3), (4, False, True, 0)],
                               "customer_id long, has_complaints boolean, has_returns boolean, purchase_count long")
    got = {r["customer_id"]: (r["churn_risk"], r["sentiment_trend"]) for r in C.risk_and_trend(df).collect()}
    assert got == {1: ("HIGH", "DECLINING"), 2: ("MEDIUM", "DECLINING"), 3: ("LOW", "IMPROVING"), 4: ("LOW", "STABLE")}


def test_decode_labels(spark):
    df = spark.createDataFrame([({"sentiment:positive": 0.2, "sentiment:negative": 0.8, "aspect:packaging": 0.5},),
                                ({"sentiment:positive": 0.3},)], "p map<string,double>")
    got = df.select(MD.decode_labels(F.col("p")).alias("d")).collect()
    a, b = got[0]["d"], got[1]["d"]
    assert (a["sentiment"], a["urgency"], a["aspects"][0]["aspect"]) == ("NEGATIVE", "CRITICAL", "packaging")
    assert (b["sentiment"], round(b["confidence"], 3), b["aspects"][0]["aspect"]) == ("NEUTRAL", 0.7, "overall experience")


def test_score_batches_runs_per_arrow_batch(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    got = MD.score_batches(df, lambda pdf: pdf.assign(p=pdf["k"] * 0.5), "k long, p double").collect()
    assert sorted((r.k, r.p) for r in got) == [(i, i * 0.5) for i in range(10)]


def test_text_model_probabilities_match_the_formula(spark):
    rows = [(1, "red red box", ["a"]), (2, "blue box", []), (3, "red lid", ["a"]), (4, "blue lid", [])]
    df = spark.createDataFrame(rows, "k long, t string, labels array<string>")
    cv, models = MD.fit_multilabel(df, "t", ["a"], vocab=10)
    m = models["a"]
    for r in MD.predict_multilabel(cv, models, df, "t", "k").collect():
        toks = dict((k, t) for k, t, _ in rows)[r.k].split()
        z = m.intercept + sum(m.coefficients[cv.vocabulary.index(w)] for w in toks)
        assert abs(r.probs["a"] - 1 / (1 + np.exp(-z))) < 1e-9
    assert r.probs.keys() == {"a"}


def _clustered(n, dims=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims)) * 3
    x = centres[rng.integers(0, 12, n)] + rng.standard_normal((n, dims))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


def test_index_prunes_cells_and_splits_the_crowded_ones(spark, tmp_path, monkeypatch):
    from tessera.operators import ann_index as A
    monkeypatch.setattr(A, "CELL_ROWS", 40)
    rows = _clustered(1500) + [(5000 + i, [1.0] * 16) for i in range(300)] + [(9000, None), (9001, [0.0] * 16)]
    items = spark.createDataFrame(rows, "item_id long, vec array<double>")
    index = A.build_index(items, str(tmp_path / "index"))
    stored = index.items(spark)
    assert stored.count() == 1800
    assert max(r["count"] for r in stored.groupBy("cell", "block").count().collect()) <= 120       # 300 equal vectors in one cell
    queries = spark.createDataFrame([(i, v) for i, v in rows[:30]] + [(-1, None)], "query_id long, vec array<double>")
    got = A.search(index, queries, 10).collect()
    exact = VX.cosine_topk(items.where("vec is not null and item_id <> 9001"), queries, 10).collect()
    found = {(r["query_id"], r["item_id"]) for r in got}
    assert len(found & {(r["query_id"], r["item_id"]) for r in exact}) >= 0.9 * len(exact)
    assert {r["similarity"] for r in got if (r["query_id"], r["item_id"]) == (3, 3)} == {1.0}
    assert max(r["n_coded"] for r in got) < 0.5 * 1800 and max(r["n_compared"] for r in got) <= 50


def test_index_of_nothing(spark, tmp_path):
    from tessera.operators import ann_index as A
    empty = spark.createDataFrame([], "item_id long, vec array<double>")
    index = A.build_index(empty, str(tmp_path / "index"))
    assert A.search(index, spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vec array<double>"), 3).count() == 0


def test_keyed_topk(spark):
    rng = np.random.default_rng(3)
    items = [(int(i), int(i % 7 if i < 300 else 99), int(rng.integers(0, 50)), [float(x) for x in rng.standard_normal(6)]) for i in range(900)]
    items += [(2000, 5, 60, None), (2001, 5, 61, [0.0] * 6), (2002, 42, 3, None), (2003, None, 3, [1.0] * 6)]
    qs = [(k, k, [float(x) for x in rng.standard_normal(6)]) for k in (0, 1, 2, 3, 5, 99)] + [(6, 6, None), (42, 42, [1.0] * 6), (43, 43, [1.0] * 6), (8, None, [1.0] * 6)]
    it = spark.createDataFrame(items, "item_id long, cust long, day long, vec array<double>")
    qd = spark.createDataFrame(qs, "query_id long, cust long, vec array<double>")
    got = {}
    for r in VX.keyed_topk(it, qd, 4, "cust", "day", block_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["matched"]))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want = {}
    for q, key, v in qs:
        own = [x for x in items if x[1] == key and key is not None]
        near = sorted(((-round(float(unit(x[3]) @ unit(v)), 6), x[0], x[2]) for x in own if v and x[3] and any(x[3])))[:4]
        if near:
            want[q] = [(i, True) for _, (_, i) in sorted((-d, (s, i)) for s, i, d in near)]
        elif own:
            want[q] = [(x[0], False) for x in sorted(own, key=lambda x: (-x[2], x[0]))[:10]]
    assert got == want
