"""Streaming queries: each runs its stream to completion over the driver
files (Trigger.AvailableNow) and returns what the sink holds; outputs that
are deterministic in complete mode carry a SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tessera.functions import text as TX
from tessera.plans.catalog import query
from tessera.plans.q_text import EVENT_NEG, EVENT_POS
from tessera.sources.views import DRIFT_SPLIT
from tessera.streaming import jobs as S

LINE_SCHEMA = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()),
    T.StructField("l_suppkey", T.LongType()), T.StructField("l_linenumber", T.IntegerType()),
    T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_linestatus", T.StringType()),
    T.StructField("l_shipdate", T.TimestampNTZType()),
])


def _events(spark, sf):
    return S.table_stream(spark, sf, "events", S.EVENT_SCHEMA)


def _run(spark, stream, name, mode, keys=None):
    out, ckpt = S.scratch(spark, name), S.scratch(spark, name + "-ckpt")
    path = S.run_available(stream, out, ckpt, mode)
    return S.latest_updates(spark, path, keys) if mode == "update" else spark.read.parquet(path)


@query("x1_ingest_stream", sql="SELECT event_type, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1")
def q_x1(spark, sf):
    out, ckpt = S.scratch(spark, "x1"), S.scratch(spark, "x1-ckpt")
    got = S.ingest_stream(spark, sf, "events", S.EVENT_SCHEMA, out, ckpt)
    return got.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query("x2_trend_stream", sql=f"""
    SELECT CAST(date_trunc('day', ts) AS DATE) AS day,
           COUNT(*) FILTER (WHERE l = 'POSITIVE') AS positive, COUNT(*) FILTER (WHERE l = 'NEGATIVE') AS negative,
           COUNT(*) FILTER (WHERE l = 'NEUTRAL') AS neutral, COUNT(*) FILTER (WHERE l = 'MIXED') AS mixed,
           COUNT(*) AS n
    FROM (SELECT ts, CASE WHEN event_type IN {EVENT_POS} THEN 'POSITIVE'
                          WHEN event_type IN ('{EVENT_NEG[0]}') THEN 'NEGATIVE' ELSE 'NEUTRAL' END AS l FROM events)
    GROUP BY 1""")
def q_x2(spark, sf):
    ev = _events(spark, sf)
    summary = F.format_string("[%s] value=%.2f", F.col("event_type"), F.col("value"))
    s = TX.sentiment_label(summary, EVENT_POS, EVENT_NEG)
    scored = ev.select("ts", s["label"].alias("label"),
                       TX.lexicon_score(summary, EVENT_POS, EVENT_NEG).alias("score"))
    res = _run(spark, S.trend_stream(scored, "label", "score"), "x2", "update", ["window"])
    return res.select(F.to_date(F.col("window.start")).alias("day"), "positive", "negative", "neutral",
                      "mixed", "n")


@query("x3_sliding_demand", sql="""
    SELECT p_type AS product_type, CAST(d - (k * INTERVAL 1 DAY) AS DATE) AS window_start, COUNT(*) AS units
    FROM (SELECT p.p_type, CAST(date_trunc('day', o.o_orderdate) AS DATE) AS d
          FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey),
         range(0, 7) r(k)
    GROUP BY 1, 2""")
def q_x3(spark, sf):
    from tessera.sources import Tables
    t = Tables(spark, sf)
    lines = S.table_stream(spark, sf, "lineitem", LINE_SCHEMA)
    # stream–static joins: the fact streams, the dimensions are read as tables
    j = (lines.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
              .join(t.part.select("p_partkey", F.col("p_type").alias("product_type")),
                    F.col("l_partkey") == F.col("p_partkey")))
    # lines arrive in key order, not by date: the bound covers all order dates
    res = _run(spark, S.sliding_demand(j, "product_type", "o_orderdate", "3650 days"), "x3", "update", ["product_type", "window"])
    return res.select("product_type", F.to_date(F.col("window.start")).alias("window_start"), "units")


@query("x4_dedup_stream", sql="""
    SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q_x4(spark, sf):
    from tessera.sources import Tables
    t = Tables(spark, sf)
    lines = S.table_stream(spark, sf, "lineitem", LINE_SCHEMA)
    j = lines.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.withColumn("transaction_id", F.concat_ws("-", F.col("l_orderkey").cast("string"),
                                                   F.col("l_linenumber").cast("string")))
    res = _run(spark, S.dedup_stream(j.select("transaction_id"), "transaction_id"), "x4", "append")
    return res.select("transaction_id")


def _x5_sql() -> str:
    from tessera.plans.q_drift import ks_sql, psi_sql
    from tessera.sources.views import with_views
    return with_views(f"""
    SELECT CAST(p.fi AS BIGINT) AS fi, p.feature, p.psi, k.ks, CAST(0 AS BIGINT) AS batch_id,
           (SELECT COUNT(*) FROM drift_cur) AS n_rows
    FROM ({psi_sql("drift_base", "drift_cur")}) p, ({ks_sql("drift_base", "drift_cur")}) k""",
                      "drift_base", "drift_cur")


@query("x5_drift_stream", sql=_x5_sql())
def q_x5(spark, sf):
    """Per-micro-batch drift of the current window against the baseline."""
    from tessera.sources import Tables
    from tessera.sources import views as V
    base, _ = V.drift_pair(Tables(spark, sf))
    cur = _events(spark, sf).where(F.col("ts") >= F.lit(DRIFT_SPLIT).cast("timestamp_ntz")) \
        .select("event_id", "ts", "value", F.hour("ts").cast("double").alias("hour"))
    audit, ckpt = S.scratch(spark, "x5-audit"), S.scratch(spark, "x5-ckpt")
    S.drift_stream(spark, cur, base, ["value", "hour"], audit, ckpt)
    return spark.read.json(audit).withColumn("batch_id", F.col("batch_id").cast("long"))


@query("x6_session_stream", sql="""
    SELECT user_id, COUNT(*) AS sessions, SUM(n) AS events FROM (
      SELECT user_id, SUM(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid, 1 AS n
      FROM (SELECT user_id, ts, event_id,
                   CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                          OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE
                        THEN 1 ELSE 0 END AS new_s FROM events))
    GROUP BY user_id, sid""".replace("SELECT user_id, COUNT(*) AS sessions, SUM(n) AS events FROM (",
                                     "SELECT user_id, COUNT(*) AS sessions, CAST(SUM(events) AS BIGINT) AS events FROM (SELECT user_id, sid, SUM(n) AS events FROM (", 1)
    + ") GROUP BY user_id")
def q_x6(spark, sf):
    ev = _events(spark, sf).select("user_id", "ts")
    res = _run(spark, S.session_stream(ev, "user_id", "ts", "30 minutes", "1 hour"), "x6", "complete")
    return res.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n_events").alias("events"))


@query("x7_counter_stream", sql=f"""
    SELECT user_id, COUNT(*) AS new_interactions FROM events WHERE ts >= TIMESTAMP '{DRIFT_SPLIT}' GROUP BY 1""")
def q_x7(spark, sf):
    ev = _events(spark, sf).where(F.col("ts") >= F.lit(DRIFT_SPLIT).cast("timestamp_ntz"))
    return _run(spark, S.counter_stream(ev, "user_id"), "x7", "update", ["user_id"])


X6_SQL = """
    WITH e AS (SELECT user_id, event_id, ts,
                      CAST(floor(epoch(ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END) / 604800) AS BIGINT) AS file FROM events),
    f AS (SELECT file, max(ts) AS newest FROM e GROUP BY file),
    m AS (SELECT file, max(newest) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM f),
    j AS (SELECT e.*, coalesce(ts < mark, false) AS late FROM e JOIN m USING (file)),
    s AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s
          FROM j WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, CAST(coalesce(sum(new_s), 0) AS BIGINT) AS sessions, count(new_s) AS events, any_value(n_late) AS late
    FROM (SELECT user_id, count(*) FILTER (WHERE late) AS n_late FROM j GROUP BY user_id) u LEFT JOIN s USING (user_id) GROUP BY user_id"""


@query("x6_session_append", sql=X6_SQL)
def q_x6_append(spark, sf):
    """Append-mode sessions over one file per week of arrival; every fiftieth
    event arrives three days late. Closed and open sessions and late rows."""
    from tessera.sources import Tables
    days = F.when(F.col("event_id") % 50 == 0, 3).otherwise(0)
    ev = Tables(spark, sf).events.select("event_id", "user_id", "ts")
    week = F.floor((F.unix_seconds(F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")) + days * 86400) / 604800)
    ev = ev.withColumn("file", week)
    files, out = S.scratch(spark, "x6-in"), S.scratch(spark, "x6-append")
    for r in ev.select("file").distinct().orderBy("file").collect():       # a row per week
        ev.where(F.col("file") == r["file"]).drop("file").coalesce(1).write.mode("append").parquet(files)
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(files)
    S.session_append(stream, "user_id", "ts", out, S.scratch(spark, "x6-append-ckpt"))
    closed = spark.read.parquet(f"{out}/closed").drop("batch_id").unionByName(S.open_sessions(spark, out))
    done = closed.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n_events").alias("events"))
    late = spark.read.parquet(f"{out}/late").groupBy("user_id").agg(F.count(F.lit(1)).alias("late"))
    zero = F.lit(0).cast("long")
    return done.join(late, "user_id", "full").select("user_id", *(F.coalesce(c, zero).alias(c) for c in ("sessions", "events", "late")))
