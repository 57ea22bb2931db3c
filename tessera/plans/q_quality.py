"""Load / quality layer: data tests, metrics, dedup, unions, file round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F, types as T

from tessera.functions import lexicons as L
from tessera.operators import marts as M
from tessera.operators import quality as Q
from tessera.plans.catalog import query
from tessera.session import checkpoint_dir
from tessera.sources import Tables
from tessera.sources import files as FS
from tessera.sources import loads as LD
from tessera.sources import views as V
from tessera.sources.views import with_views

ALLOWED_EVENT_TYPES = ("click", "view", "purchase", "signup")


def _scratch(spark, name: str) -> str:
    """Fresh folder under the shared checkpoint location (never machine-local
    on a cluster: ``spark.checkpoint.dir`` names the shared folder)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


# ---- data tests -----------------------------------------------------------

_SCORE_SQL = f"""
    SELECT article_id, CAST(SUM(CAST(CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 3) ELSE 0 END
                                     AS DECIMAL(6,3))) AS DOUBLE) / COUNT(*) AS s
    FROM (SELECT article_id,
                 len(list_intersect(list_distinct(w), {list(L.DRIVER_POSITIVE)})) AS p,
                 len(list_intersect(list_distinct(w), {list(L.DRIVER_NEGATIVE)})) AS n
          FROM (SELECT article_id, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+') AS w FROM reviews))
    GROUP BY article_id"""


@query("q1q3_data_tests", sql=with_views("""
    SELECT test, failures, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT 'not_null:transactions.customer_id' AS test,
             CAST(COUNT(*) FILTER (WHERE customer_id IS NULL) AS BIGINT) AS failures FROM transactions
      UNION ALL
      SELECT 'unique:transactions.transaction_id', CAST(COUNT(*) AS BIGINT)
      FROM (SELECT transaction_id FROM transactions GROUP BY 1 HAVING COUNT(*) > 1)
      UNION ALL
      SELECT 'range:article_sentiment.avg_sentiment',
             CAST(COUNT(*) FILTER (WHERE NOT (s BETWEEN -1 AND 1)) AS BIGINT) FROM mart_scores)""",
    "transactions", "reviews", "mart_scores", extra={"mart_scores": _SCORE_SQL}))
def q_data_tests(spark, sf):
    t = Tables(spark, sf)
    tx = V.transactions(t)
    mart = M.article_sentiment_mart(V.reviews(t), V.articles(t), L.DRIVER_POSITIVE, L.DRIVER_NEGATIVE)
    dup = Q.check_unique(tx, ["transaction_id"]).agg(F.count(F.lit(1)).alias("failures"))
    return Q.data_tests({
        "not_null:transactions.customer_id": Q.check_not_null(tx, "customer_id"),
        "unique:transactions.transaction_id": dup,
        "range:article_sentiment.avg_sentiment": Q.check_range(mart, "avg_sentiment", -1, 1),
    })


@query("q2_duplicate_keys", sql=with_views(
    "SELECT transaction_id, COUNT(*) AS n FROM transactions GROUP BY 1 HAVING COUNT(*) > 1",
    "transactions"))
def q_dups(spark, sf):
    return Q.check_unique(V.transactions(Tables(spark, sf)), ["transaction_id"])


@query("q4_ingest_checks", sql="""
    SELECT *, n_rows >= 1000 AND ts_out_of_range = 0 AND duplicate_rows = 0 AND schema_ok AS passed
    FROM (SELECT COUNT(*) AS n_rows, MIN(ts) AS min_ts, MAX(ts) AS max_ts,
                 COUNT(*) FILTER (WHERE ts < TIMESTAMP '2024-01-01' OR ts > TIMESTAMP '2024-01-31') AS ts_out_of_range,
                 COUNT(*) - COUNT(DISTINCT event_id) AS duplicate_rows, true AS schema_ok
          FROM events)""")
def q_ingest(spark, sf):
    ev = Tables(spark, sf).events
    return Q.ingest_checks(ev, "ts", ["event_id"], 1000, "2024-01-01", "2024-01-31",
                           ["event_id", "ts", "user_id", "event_type"])


@query("q5_allowed_values", sql=f"""
    SELECT event_type, COUNT(*) AS n FROM events
    WHERE event_type NOT IN {tuple(ALLOWED_EVENT_TYPES)} OR event_type IS NULL GROUP BY 1""")
def q_allowed(spark, sf):
    return Q.check_allowed(Tables(spark, sf).events, "event_type", ALLOWED_EVENT_TYPES)


URL_SEG = r"^https?://[^/]+/[^/]+/([^?#]*)"


@query("p2_cast_or_quarantine", sql=f"""
    SELECT page_id, seg AS raw_seg, TRY_CAST(seg AS BIGINT) AS seg_id,
           CASE WHEN seg IS NOT NULL AND TRY_CAST(seg AS BIGINT) IS NULL THEN 'quarantined' ELSE 'ok' END AS status
    FROM (SELECT page_id, NULLIF(regexp_extract(url, '{URL_SEG}', 1), '') AS seg FROM pages)""")
def q_quarantine(spark, sf):
    p = Tables(spark, sf).pages.select(
        "page_id", F.nullif(F.regexp_extract("url", URL_SEG, 1), F.lit("")).alias("seg"))
    ok, bad = Q.cast_or_quarantine(p.withColumn("raw_seg", F.col("seg")), {"seg": "bigint"})
    ok = ok.select("page_id", "raw_seg", F.col("seg").alias("seg_id"), F.lit("ok").alias("status"))
    bad = bad.select("page_id", "raw_seg", F.lit(None).cast("bigint").alias("seg_id"),
                     F.lit("quarantined").alias("status"))
    return ok.unionByName(bad)


@query("p11_valid_rows", sql="""
    SELECT doc_id, COALESCE(length(text) BETWEEN 5 AND 5000, false) AS is_valid FROM documents""")
def q_valid(spark, sf):
    return Q.valid_rows(Tables(spark, sf).documents, "text", 5, 5000).select("doc_id", "is_valid")


# ---- metrics --------------------------------------------------------------

@query("a5_load_metrics", sql=with_views("""
    SELECT COUNT(*) AS n_rows, CAST(SUM(price) AS DOUBLE) AS sum_price,
           MIN(t_dat) AS min_t_dat, MAX(t_dat) AS max_t_dat,
           COUNT(DISTINCT customer_id) AS distinct_customer_id,
           COUNT(DISTINCT article_id) AS distinct_article_id
    FROM transactions""", "transactions"))
def q_load_metrics(spark, sf):
    return Q.load_metrics(V.transactions(Tables(spark, sf)), "price", "t_dat",
                          ["customer_id", "article_id"])


@query("a6_distinct_count", sql="SELECT COUNT(DISTINCT event_type) AS distinct_event_type FROM events")
def q_distinct(spark, sf):
    return Q.distinct_count(Tables(spark, sf).events, "event_type")


@query("a6_approx_distinct")
def q_approx(spark, sf):
    """HyperLogLog++ distinct users (rows-only: approximate by design)."""
    return Q.distinct_count(Tables(spark, sf).events, "user_id", approx=True)


@query("a6_merged_sketches", sql="""
    SELECT COUNT(DISTINCT CAST(ts AS DATE)) AS days, COUNT(DISTINCT event_id) AS exact, true AS within_2_percent FROM events""")
def q_sketches(spark, sf):
    """Distinct events from stored daily sketches, against the exact count."""
    ev, path = Tables(spark, sf).events, _scratch(spark, "sketches")
    Q.daily_sketches(ev, F.to_date("ts"), "event_id").write.parquet(path)
    daily = spark.read.parquet(path)
    got = Q.merged_distinct(daily).select("distinct_estimate").scalar()
    exact = ev.agg(F.count_distinct("event_id")).scalar()
    return daily.agg(F.count(F.lit(1)).alias("days")).select("days", exact.alias("exact"), (F.abs(got - exact) <= 0.02 * exact).alias("within_2_percent"))


@query("a8_value_counts", sql=with_views(
    "SELECT sales_channel, COUNT(*) AS n FROM transactions GROUP BY 1", "transactions"))
def q_value_counts(spark, sf):
    return Q.value_counts(V.transactions(Tables(spark, sf)), "sales_channel")


# ---- union / dedup --------------------------------------------------------

@query("u1_union_by_name", sql="""
    SELECT doc_id AS id, text, lang, CAST(NULL AS VARCHAR) AS role FROM documents
    UNION ALL SELECT conv_id * 1000 + turn, text, NULL, role FROM conversations""")
def q_union(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.select(F.col("doc_id").alias("id"), "text", "lang")
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")
    return Q.union_frames(d, c)


@query("u3_first_per_id", sql="""
    SELECT user_id, event_id, ts, event_type FROM (
      SELECT user_id, event_id, ts, event_type,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def q_first(spark, sf):
    ev = Tables(spark, sf).events.select("user_id", "event_id", "ts", "event_type")
    return Q.first_per_id(ev, ["user_id"], ["ts", "event_id"])


@query("u4_dedup_latest", sql=with_views("""
    SELECT transaction_id, customer_id, article_id, CAST(price AS DOUBLE) AS price, t_dat FROM (
      SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY t_dat DESC, article_id DESC, customer_id DESC, price DESC) AS rn
      FROM transactions) WHERE rn = 1""", "transactions"))
def q_dedup(spark, sf):
    tx = V.transactions(Tables(spark, sf)).select(
        "transaction_id", "customer_id", "article_id", F.col("price").cast("double").alias("price"), "t_dat")
    return Q.dedup_latest(tx, ["transaction_id"], ["t_dat", "article_id", "customer_id", "price"])


# ---- file sources / sinks (round trips of data Spark derives from the tables)

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
])


ARRAY_ROWS = 10_000    # events in one JSON array, about


@query("s1_json_array_files", sql="SELECT event_id, ts, user_id, event_type, value FROM events")
def q_json_arrays(spark, sf):
    """Events written as JSON arrays, then read back (S1). An hour has one array
    per salt of its event ids, so that no array grows with a busy hour alone."""
    path = _scratch(spark, "json-arrays")
    ev = Tables(spark, sf).events.select(*EVENT_SCHEMA.fieldNames())
    hourly = ev.withColumn("hour", F.date_format("ts", "yyyyMMddHH"))
    size = hourly.groupBy("hour").agg(F.ceil(F.count(F.lit(1)) / ARRAY_ROWS).alias("arrays"))       # a row per hour
    hourly = (hourly.join(size, "hour").withColumn("salt", F.pmod(F.xxhash64("event_id"), "arrays"))
              .groupBy("hour", "salt").agg(F.to_json(F.collect_list(F.struct(*EVENT_SCHEMA.fieldNames())),
                                            {"timestampNTZFormat": FS.TS_FORMAT}).alias("doc")))
    # one array per file: a file is what the reader parses as a whole
    hourly.repartition("hour", "salt").select("hour", "doc").write.option("maxRecordsPerFile", 1).partitionBy("hour").text(path)
    return FS.read_json_arrays(spark, path, EVENT_SCHEMA).select(*EVENT_SCHEMA.fieldNames())


@query("s2_csv_union_by_name", sql="""
    SELECT event_id, ts, user_id,
           CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type,
           CASE WHEN event_id % 2 = 1 THEN value END AS value
    FROM events""")
def q_csvs(spark, sf):
    """Two CSV groups with different headers, read back and unioned by name."""
    base = _scratch(spark, "csv")
    ev = Tables(spark, sf).events
    (ev.where(F.col("event_id") % 2 == 0).select("event_id", "ts", "user_id", "event_type")
       .write.option("header", True).option("timestampNTZFormat", FS.TS_FORMAT).csv(f"{base}/a"))
    (ev.where(F.col("event_id") % 2 == 1).select("value", "user_id", "ts", "event_id")
       .write.option("header", True).option("timestampNTZFormat", FS.TS_FORMAT).csv(f"{base}/b"))
    return FS.read_csvs(spark, [f"{base}/a", f"{base}/b"], EVENT_SCHEMA)


@query("s3_jsonl_lists", sql="""
    SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN [value] ELSE [] END AS features
    FROM events""")
def q_jsonl(spark, sf):
    """JSON lines whose list field is sometimes absent → [] on read (S3)."""
    path = _scratch(spark, "jsonl")
    ev = Tables(spark, sf).events
    FS.write_jsonl(ev.select("event_id", "user_id",
                             F.when(F.col("event_type") == "purchase", F.array("value")).alias("features")), path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("features", T.ArrayType(T.DoubleType()))])
    return FS.read_jsonl(spark, path, schema, ["features"])


@query("s5_append_idempotent_reload", sql="SELECT event_type, COUNT(*) AS n FROM events GROUP BY 1")
def q_append(spark, sf):
    """Append twice (duplicates), then reload with dynamic partition overwrite
    (S5 idempotent path) and count per partition."""
    path = _scratch(spark, "raw-events")
    ev = Tables(spark, sf).events
    FS.append_raw(ev, path, ["event_type"], ["event_id", "ts"])
    FS.append_raw(ev, path, ["event_type"], ["event_id", "ts"])
    FS.overwrite_partitions(ev, path, ["event_type"])
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s5_replayed_loads", sql="""
    SELECT 'events-' || CAST(event_id % 3 AS VARCHAR) AS load_id, event_type, COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS id_sum
    FROM events GROUP BY 1, 2""")
def q_replayed_loads(spark, sf):
    """Three loads, all run twice, and one that fails before it is published."""
    path = _scratch(spark, "loads")
    ev = Tables(spark, sf).events
    for k in (0, 1, 2, 0, 1, 2):
        LD.write_load(ev.where(F.col("event_id") % 3 == k), path, f"events-{k}", required=["event_id", "ts"])
    ev.write.parquet(f"{path}/data/failed-{'0' * 32}")
    return LD.read_loads(spark, path, "load_id").groupBy("load_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum"))


@query("s6_overwrite_table", sql=with_views(
    "SELECT article_id, COUNT(*) AS days FROM (SELECT DISTINCT article_id, t_dat FROM transactions) GROUP BY 1",
    "transactions"))
def q_overwrite(spark, sf):
    path = _scratch(spark, "demand-mart")
    t = Tables(spark, sf)
    mart = M.demand_mart(V.transactions(t), V.articles(t))
    FS.overwrite_table(mart, path)
    FS.overwrite_table(mart, path)
    return spark.read.parquet(path).groupBy("article_id").agg(F.count(F.lit(1)).alias("days"))


@query("s4_text_intake", sql="SELECT text FROM documents WHERE text IS NOT NULL")
def q_intake(spark, sf):
    return FS.text_intake(Tables(spark, sf).documents.select("doc_id", "text", "lang"))
