"""Loads that are repeated or fail, the baseline summary, append-mode sessions."""

import datetime as dt
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import baseline as B
from tessera.operators import drift as D
from tessera.sources import files as FS
from tessera.sources import loads as LD
from tessera.streaming import jobs as S


def rows_of(spark, path):
    return sorted(tuple(r) for r in LD.read_loads(spark, path).select("id", "v").collect())


def test_a_load_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(1, "x"), (3, None)], "id long, v string")
    assert LD.write_load(a, path, "day-1") and LD.write_load(b, path, "day-2")
    assert not LD.write_load(a, path, "day-1") and not LD.write_load(b, path, "day-2")
    assert LD.read_loads(spark, path).count() == 4
    got = {(r["id"], r["load"]) for r in LD.read_loads(spark, path, "load").collect()}
    assert got == {(1, "day-1"), (2, "day-1"), (1, "day-2"), (3, "day-2")}


def test_a_failed_load_is_not_seen_and_can_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([(1, "x")], "id long, v string")
    LD.write_load(good, path, "a")
    bad = good.select("id", F.raise_error(F.lit("broken row")).cast("string").alias("v"))
    with pytest.raises(Exception, match="broken row"):
        LD.write_load(bad, path, "b")
    good.write.parquet(f"{path}/data/c-{'1' * 32}")                       # written, never published
    assert rows_of(spark, path) == [(1, "x")]
    assert LD.write_load(good, path, "b") and rows_of(spark, path) == [(1, "x")] * 2
    assert len(LD.sweep(spark, path)) >= 1 and rows_of(spark, path) == [(1, "x")] * 2
    with pytest.raises(ValueError):
        LD.write_load(good, path, "../b")


def test_loads_of_other_columns_formats_and_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    LD.write_load(spark.createDataFrame([(1, "x")], "id long, v string"), path, "a", partition_by=["v"])
    LD.write_load(spark.createDataFrame([(2, 0.5)], "id long, w double"), path, "b")
    LD.write_load(spark.createDataFrame([(3, "z")], "id long, v string"), path, "c", fmt="json")
    LD.write_load(spark.createDataFrame([], "id long, v string"), path, "d")
    got = sorted(tuple(r) for r in LD.read_loads(spark, path).select("id", "v", "w").collect())
    assert got == [(1, "x", None), (2, None, 0.5), (3, "z", None)]


def test_audit_with_a_load_id(spark, tmp_path):
    rep = spark.createDataFrame([(0.1, True)], "psi double, needs_retraining boolean")
    for k in (1, 1, 2):
        FS.write_audit(rep, str(tmp_path / "audit"), load_id=f"run-{k}")
    assert LD.read_loads(spark, str(tmp_path / "audit")).count() == 2


def test_summary_is_exact_for_few_values_and_bounded_for_many(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=6000), np.full(2000, 0.25), [-1e300, 1e300]])
    df = spark.createDataFrame([(float(v), float(i % 5)) for i, v in enumerate(x)], "a double, b double")
    B.build(df, ["a", "b"], str(tmp_path / "s"), size=100)
    a, b = B.load(spark, str(tmp_path / "s"), 2)
    assert len(a.values) <= 102 and a.n == b.n == len(x)
    at = np.concatenate([rng.normal(size=300), [0.25, -2e300, 2e300]])
    true = np.searchsorted(np.sort(x), at, "right")
    assert (np.abs(a.rank(at) - true) <= len(x) / 100).all()
    assert [int(v) for v in np.diff([0, *b.upto])] == [int((np.arange(len(x)) % 5 == k).sum()) for k in range(5)]
    y = rng.normal(loc=1, size=5000)
    other = B.Summary(np.sort(y), np.arange(1, 5001)).thin(100)
    both = B.merge(a, other, 100)
    true = np.searchsorted(np.sort(np.concatenate([x, y])), at, "right")
    assert both.n == len(x) + 5000 and (np.abs(both.rank(at) - true) <= 3 * both.n / 100).all()


def test_drift_against_the_summary(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = spark.createDataFrame([(float(v), float(v * 2)) for v in rng.normal(size=3000)], "a double, b double")
    cur = spark.createDataFrame([(float(v), None if v > 1 else float(v)) for v in rng.normal(loc=0.4, size=700)], "a double, b double")
    B.build(base, ["a", "b"], str(tmp_path / "exact"))
    B.build(base, ["a", "b"], str(tmp_path / "thin"), size=200)
    exact, thin = (B.load(spark, str(tmp_path / p), 2) for p in ("exact", "thin"))
    want = [r["psi"] for r in D.psi(base, cur, ["a", "b"]).orderBy("fi").collect()]
    assert [r["psi"] for r in B.psi(exact, cur, ["a", "b"]).orderBy("fi").collect()] == pytest.approx(want, abs=1e-9)
    assert [r["psi"] for r in B.psi(thin, cur, ["a", "b"]).orderBy("fi").collect()] == pytest.approx(want, abs=0.2)
    ks = D.ks_two_sample(base, cur, "a").first()["ks"]
    assert B.ks(exact[0], cur, "a").first()["ks"] == pytest.approx(ks, abs=1e-9)
    assert B.ks(thin[0], cur, "a").first()["ks"] == pytest.approx(ks, abs=1 / 200)


def in_files(spark, path, parts, schema):
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)                                                 # files are taken in order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_the_baseline_is_read_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    parts = [[(float(v),) for v in rng.normal(size=50)] for _ in range(4)]
    stream = in_files(spark, str(tmp_path / "in"), parts, "a double")
    reads = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            reads.add(len(r))
            yield r

    base = spark.createDataFrame([(float(v),) for v in rng.normal(size=400)], "a double").mapInPandas(counted, "a double")
    S.drift_stream(spark, stream, base, ["a"], str(tmp_path / "audit"), str(tmp_path / "ck"))
    first = reads.value
    rep = spark.read.json(str(tmp_path / "audit")).select("batch_id", "psi", "ks").orderBy("batch_id").collect()
    assert len(rep) == 4 and 400 <= first <= 800                       # the range sampling reads it again
    in_files(spark, str(tmp_path / "in"), [[(9.0,)] * 20], "a double")
    S.drift_stream(spark, stream, base, ["a"], str(tmp_path / "audit"), str(tmp_path / "ck"))
    assert reads.value == first and spark.read.json(str(tmp_path / "audit")).count() == 5


def test_append_sessions_keep_every_row(spark, tmp_path):
    rng, t0 = random.Random(5), dt.datetime(2024, 1, 1)
    parts = []
    for k in range(6):
        parts.append([(rng.choice("abc"), t0 + dt.timedelta(minutes=k * 300 + rng.choice([0, 0, 0, -1500]) + rng.randrange(300))) for _ in range(40)])
    parts[2].append(("a", None))
    stream = in_files(spark, str(tmp_path / "in"), parts, "user string, ts timestamp_ntz")
    out = str(tmp_path / "out")
    S.session_append(stream, "user", "ts", out, str(tmp_path / "ck"))
    late = sorted(((r["user"], r["ts"]) for r in spark.read.parquet(f"{out}/late").collect()), key=str)
    kept, newest, want_late = [], None, []
    for p in parts:
        for u, t in p:
            behind = t is None or newest is not None and t < newest - dt.timedelta(hours=1)
            (want_late if behind else kept).append((u, t))
        newest = max(t for _, t in [*p, ("", newest)] if t is not None)
    assert late == sorted(want_late, key=str) and len(late) > 20
    want = []
    for u in "abc":
        times = sorted(t for x, t in kept if x == u)
        start = 0
        for i in range(1, len(times) + 1):
            if i == len(times) or times[i] - times[i - 1] >= dt.timedelta(minutes=30):
                want.append((u, times[start], times[i - 1], i - start))
                start = i
    closed, still = spark.read.parquet(f"{out}/closed").drop("batch_id"), S.open_sessions(spark, out)
    got = sorted((r[0], r[1], r[2], r[3]) for r in closed.unionByName(still).collect())
    assert got == sorted(want)
    floor = newest - dt.timedelta(hours=1, minutes=30)
    assert all(r["session_end"] > floor for r in still.collect())      # nothing older is held
    S.session_append(stream, "user", "ts", out, str(tmp_path / "ck"))  # nothing new arrived
    assert spark.read.parquet(f"{out}/closed").count() == closed.count()
