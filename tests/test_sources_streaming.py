"""File sources / sinks and streaming twins of batch operators."""

import json
import os
import tempfile

from pyspark.sql import functions as F, types as T

from tessera.sources import files as FS
from tessera.streaming import jobs as S

SF = "/root/testdata/sf0.001"


def test_json_arrays_and_csv_union(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    os.makedirs(f"{d}/j")
    with open(f"{d}/j/a.json", "w") as f:
        json.dump([{"id": 1, "v": "x"}, {"id": 2, "v": "y"}], f)
    with open(f"{d}/j/b.json", "w") as f:
        json.dump([{"id": 3}], f)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    got = sorted((r.id, r.v) for r in FS.read_json_arrays(spark, f"{d}/j", schema).collect())
    assert got == [(1, "x"), (2, "y"), (3, None)]
    os.makedirs(f"{d}/c1")
    os.makedirs(f"{d}/c2")
    open(f"{d}/c1/a.csv", "w").write("id,v\n1,x\n")
    open(f"{d}/c2/b.csv", "w").write("w,id\n9,2\n")
    schema2 = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType()),
                            T.StructField("w", T.LongType())])
    got = sorted((r.id, r.v, r.w) for r in FS.read_csvs(spark, [f"{d}/c1", f"{d}/c2"], schema2).collect())
    assert got == [(1, "x", None), (2, None, 9)]


def test_jsonl_missing_lists_and_audit(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    open(f"{d}/x.jsonl", "w").write('{"id": 1, "f": [1.5]}\n{"id": 2}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("f", T.ArrayType(T.DoubleType()))])
    got = sorted((r.id, r.f) for r in FS.read_jsonl(spark, f"{d}/x.jsonl", schema, ["f"]).collect())
    assert got == [(1, [1.5]), (2, [])]
    rep = spark.createDataFrame([(0.1, True)], "psi double, needs_retraining boolean")
    FS.write_audit(rep, f"{d}/audit")
    FS.write_audit(rep, f"{d}/audit")
    assert spark.read.json(f"{d}/audit").count() == 2


def test_text_intake_picks_column(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, review_body string")
    assert FS.pick_text_column(df) == "review_body"
    assert FS.text_intake(df).count() == 1


def test_stream_counter_equals_batch(spark):
    ev = S.table_stream(spark, SF, "events", S.EVENT_SCHEMA)
    out, ck = S.scratch(spark, "t-x7"), S.scratch(spark, "t-x7-ck")
    got = spark.read.parquet(S.run_available(S.counter_stream(ev, "user_id"), out, ck, "complete"))
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy("user_id").count()
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted((r[0], r[1]) for r in batch.collect())


def test_stream_ingest_is_exactly_once(spark):
    out, ck = S.scratch(spark, "t-x1"), S.scratch(spark, "t-x1-ck")
    S.ingest_stream(spark, SF, "events", S.EVENT_SCHEMA, out, ck)
    again = S.ingest_stream(spark, SF, "events", S.EVENT_SCHEMA, out, ck)   # restart: nothing new
    assert again.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_stream_dedup(spark):
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:05:00")]
    spark.createDataFrame(rows, "k string, ts string").withColumn("ts", F.to_timestamp_ntz("ts")) \
        .write.parquet(f"{d}/t.parquet")
    st = spark.readStream.schema("k string, ts timestamp_ntz").parquet(f"{d}/t.parquet")
    out = spark.read.parquet(S.run_available(S.dedup_stream(st, "k", "1 hour"),
                                             f"{d}/out", f"{d}/ck", "append"))
    assert sorted(r.k for r in out.collect()) == ["a", "b"]


def _in_files(spark, rows, schema, n):
    """``rows`` in n files, in order; the stream takes one file per trigger."""
    import time
    d = tempfile.mkdtemp(prefix="tessera-test-", dir="/tmp")
    step = -(-len(rows) // n)
    for k in range(n):
        spark.createDataFrame(rows[k * step:(k + 1) * step], schema).coalesce(1).write.mode("append").parquet(d)
        time.sleep(0.02)   # files are taken in order of their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)


def test_streams_over_several_batches(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    stream = _in_files(spark, ev.collect(), ev.schema, 4)
    path = S.run_available(S.counter_stream(stream, "user_id"), S.scratch(spark, "t-c"), S.scratch(spark, "t-c-ck"), "update")
    assert spark.read.parquet(path).select("batch_id").distinct().count() >= 4
    want = sorted((r[0], r[1]) for r in ev.groupBy("user_id").count().collect())
    assert sorted((r[0], r[1]) for r in S.latest_updates(spark, path, ["user_id"]).collect()) == want

    scored = stream.select("ts", F.lit("POSITIVE").alias("label"), F.lit(1.0).alias("score"))
    path = S.run_available(S.trend_stream(scored, "label", "score"), S.scratch(spark, "t-t"), S.scratch(spark, "t-t-ck"), "update")
    got = S.latest_updates(spark, path, ["window"]).select(F.to_date("window.start").alias("d"), "n").collect()
    assert sorted((r.d, r.n) for r in got) == sorted((r[0], r[1]) for r in ev.groupBy(F.to_date("ts")).count().collect())


def test_late_rows_inside_the_bound_stay_and_later_ones_go(spark):
    import datetime as dt
    day = lambda d, h=0: (dt.datetime(2024, 1, d, h), "POSITIVE", 1.0)
    # one row per file: a day, two days on, a row 20 hours late, on twice (Spark judges
    # late rows by the bound before the last batch), a row five days late
    rows = [day(1, 12), day(3, 1), day(2, 5), day(9), day(9, 1), day(3, 2)]
    stream = _in_files(spark, rows, "ts timestamp_ntz, label string, score double", 6)
    path = S.run_available(S.trend_stream(stream, "label", "score", "1 day"), S.scratch(spark, "t-l"), S.scratch(spark, "t-l-ck"), "update")
    got = {r.d.day: r.n for r in S.latest_updates(spark, path, ["window"]).select(F.to_date("window.start").alias("d"), "n").collect()}
    assert got == {1: 1, 3: 1, 2: 1, 9: 2}
