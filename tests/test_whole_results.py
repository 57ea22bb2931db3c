"""Results that must be whole: every negative due, late and repeated stream
rows, order helpers on extreme values, approximate neighbours by recall."""

import random
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as E
from tessera.operators import drift as D
from tessera.operators import evaluation as EV
from tessera.operators import models as MD
from tessera.operators import recsys as R
from tessera.operators import scale as S
from tessera.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_negative_samples_are_exactly_n_unseen(spark):
    rng = random.Random(3)
    pos = {(u, rng.randrange(30) * 7) for u in range(20) for _ in range(u + 1)}
    pos |= {(99, i * 7) for i in range(28)} | {(100, i * 7) for i in range(30)}   # two and no unseen items
    df = spark.createDataFrame(sorted(pos), "user_id long, item_id long")
    items = spark.createDataFrame([(i * 7,) for i in range(30)], "item_id long")
    got = [tuple(r) for r in R.negative_samples(df, items, n=4).collect()]
    seen = Counter(u for u, _ in pos)
    due = Counter({(u, i): min(4, 30 - seen[u]) for u, i in pos})
    assert Counter((u, i) for u, i, _ in got) == +due
    assert len(set(got)) == len(got) and not any((u, n) in pos for u, _, n in got)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_approximate_neighbours_reach_the_recall(spark, sf):
    r = E.queries()["v4_ann_recall"](spark, f"/root/testdata/{sf}").collect()
    assert sum(x["recall"] for x in r) / len(r) >= 0.9
    assert sum(x["n_compared"] for x in r) <= 0.1 * sum(x["n_items"] for x in r)


def test_dedup_stream_over_several_files(spark, tmp_path):
    rows = [(f"k{i % 50}", 40 - i % 37) for i in range(400)]           # event days run backwards and forwards
    for n in range(4):
        part = spark.createDataFrame(rows[n::4], "key string, day int").selectExpr("key", "date_add(date'2024-01-01', day) AS day")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, day date").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = jobs.run_available(jobs.dedup_stream(stream, "key"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = [r["key"] for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted({k for k, _ in rows})


def test_order_helpers_with_one_extreme_value(spark):
    rng = random.Random(1)
    b = [rng.random() for _ in range(500)] + [1e300, -1e300]
    c = [rng.random() + 0.1 for _ in range(400)]
    bd, cd = (spark.createDataFrame([(x,) for x in v], "x double") for v in (b, c))
    at = np.array(b + c)
    want = np.abs(np.searchsorted(np.sort(b), at, "right") / len(b) - np.searchsorted(np.sort(c), at, "right") / len(c)).max()
    assert abs(D.ks_two_sample(bd, cd, "x").first()["ks"] - want) < 1e-8
    assert EV.exact_median(bd, "x") == float(np.median(b))
    ids = {r["x"]: r["x_idx"] for r in S.dense_ids(bd, "x").collect()}
    assert ids == {v: i for i, v in enumerate(sorted(set(b)))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")   # small data would share one range
    try:
        ranged = S.in_ranges(bd.repartition(4), ["x"]).groupBy("_b").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in ranged) < 300


def test_split_takes_ids_beyond_32_bits(spark):
    df = spark.createDataFrame([(2**33 + i * 4_000_000_007, i % 2) for i in range(100)], "id long, y int")
    got = MD.stratified_split(df, "id", "y").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"test": 20, "train": 80}


def test_silhouette_uses_all_rows_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(4, 1, (50, 3)), [[9, 9, 9]]])
    y = ["a"] * 60 + ["b"] * 50 + ["c"]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = [j for j in range(len(x)) if y[j] == y[i] and j != i]
        if not own:
            s.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, [j for j in range(len(x)) if y[j] == o]].mean() for o in set(y) - {y[i]})
        s.append((b - a) / max(a, b))
    df = spark.createDataFrame([(i, v.tolist(), l) for i, (v, l) in enumerate(zip(x, y))], "k long, v array<double>, l string")
    assert EV.silhouette(df, "k", "v", "l", block_rows=20).first()["silhouette"] == pytest.approx(np.mean(s), abs=1e-6)


@pytest.mark.parametrize("name", ["m8_auc", "r4_drift_report", "r2_ks_two_sample", "m5_impute_scale", "v10_negative_samples"])
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_silhouette_copies_no_rows_per_block_pair(spark):
    """The same figure for any number of blocks, null labels and repeated keys
    included, with no rows shuffled to pairs of blocks."""
    rng = np.random.default_rng(3)
    rows = [(int(i % 70), v.tolist(), None if i % 9 == 0 else "ab"[i % 2]) for i, v in enumerate(rng.normal(0, 1, (90, 4)))]
    df = spark.createDataFrame(rows, "k long, v array<double>, l string")
    got = [EV.silhouette(df, "k", "v", "l", block_rows=b) for b in (7, 1000)]
    assert got[0].first()[0] == pytest.approx(got[1].first()[0], abs=1e-6)
    plan = got[0]._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and plan.count("CartesianProduct") > 0


def _clusters(spark, repeat=1):
    """Seven clusters of uneven size and width, and their distances one by one."""
    rng = np.random.default_rng(5)
    n, wide = (90, 70, 60, 50, 40, 20, 1), (1, .4, 2, 1, .2, 1, 1)
    x = np.concatenate([rng.normal(0, 6, 3) + rng.normal(0, w, (m, 3)) for m, w in zip(n, wide)])
    y = np.repeat(np.arange(len(n)), n)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    mean = np.stack([d[:, y == c].sum(1) for c in range(len(n))], 1) / np.array(n)
    rows = [(i // repeat, v.tolist(), f"c{c}") for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, v array<double>, l string"), y, np.array(n), mean


def test_silhouette_leaves_out_only_what_cannot_be_nearest(spark):
    """A row's own and its nearest other cluster are always asked for, most
    others are not, and two blocks meet once: far fewer distances than pairs,
    and the figure of all of them."""
    df, y, n, mean = _clusters(spark)
    packed, rows, _ = EV._blocks(df, "k", "v", "l", 20)
    at = np.arange(len(y))
    other = mean.copy()
    other[at, y] = np.inf
    seen = 0
    for r in packed.collect():
        for k in map(int, r["k"]):
            assert {y[k], other[k].argmin()} <= set(r["need"])
            seen += 1
    assert seen == rows == len(y)
    pairs = EV._pairs(packed, 3).select("b", "b2", "rows", "rows2").collect()
    assert len({frozenset((r["b"], r["b2"])) for r in pairs}) == len(pairs)
    assert sum(r["rows"] * r["rows2"] for r in pairs) < .4 * rows ** 2
    a = np.where(n[y] > 1, mean[at, y] * n[y] / np.maximum(n[y] - 1, 1), 0)
    b = other.min(1)
    want = np.where(n[y] > 1, (b - a) / np.maximum(a, b), 0).mean()
    assert EV.silhouette(df, "k", "v", "l", block_rows=20).first()[0] == pytest.approx(want, abs=1e-6)


def test_silhouette_of_repeated_keys_asks_for_all_clusters(spark):
    """Rows of one key and label count as one, so none of them leaves a cluster out."""
    df, y, n, mean = _clusters(spark, repeat=2)
    ids = sorted({(i // 2, c) for i, c in enumerate(y)})
    s = []
    for k, c in ids:
        of = [i for i in (2 * k, 2 * k + 1) if i < len(y) and y[i] == c]
        sums, counts = (mean[of] * n).sum(0), len(of) * n
        b = min(sums[o] / counts[o] for o in range(len(n)) if o != c)
        s.append(0.0 if counts[c] <= 1 else (b - sums[c] / (counts[c] - 1)) / max(b, sums[c] / (counts[c] - 1)))
    assert EV.silhouette(df, "k", "v", "l", block_rows=20).first()[0] == pytest.approx(np.mean(s), abs=1e-6)


def test_events_are_split_once(spark):
    """The factor model, its held-out rows and both rankings read one stored split."""
    from tessera.plans import q_recsys
    a, b = (q_recsys._split_weights(spark, SF) for _ in range(2))
    assert a is b and "Window" not in a[1]._jdf.queryExecution().executedPlan().toString()
