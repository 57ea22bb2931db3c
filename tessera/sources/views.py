"""Logical retail views over the driver tables.

Each view exists twice: as a DataFrame builder (what jobs use) and as a plain
SQL definition (what the independent DuckDB oracle uses). Both must define the
same rows; the oracle check compares them end to end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.sources.tables import Tables

# Event types that count as user-item interactions for recommendation.
RECSYS_EVENT_TYPES = ("click", "view", "purchase")
# Date splitting the events into a baseline and a current window (drift).
DRIFT_SPLIT = "2024-01-16"


def transactions(t: Tables) -> DataFrame:
    """One row per order line: lineitem ⋈ orders on the order key.

    Both sides are fact-sized, so no broadcast hint: Catalyst / AQE choose a
    sort-merge join on ``o_orderkey`` (or broadcast if runtime size allows).
    """
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                           "l_extendedprice", "l_discount", "l_returnflag")
    od = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_number"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.to_date("o_orderdate").alias("t_dat"),
        F.col("o_orderpriority").alias("sales_channel"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("return_flag"),
    )


def articles(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("article_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_type"),
        F.col("p_brand").alias("department"),
        F.col("p_retailprice").alias("price"),
    )


def reviews(t: Tables) -> DataFrame:
    """Documents re-keyed as product reviews (deterministic derived keys).

    The key moduli are scalar subqueries (one row each), evaluated once and
    broadcast by Spark — no join, no driver round trip.
    """
    n_cust = t.customer.agg(F.count(F.lit(1))).scalar()
    n_part = t.part.agg(F.count(F.lit(1))).scalar()
    d = t.documents
    return d.select(
        F.col("doc_id").alias("review_id"),
        (F.col("doc_id") % n_cust).alias("customer_id"),
        (F.col("doc_id") % n_part).alias("article_id"),
        (F.lit(1) + F.col("n_chars") % 5).cast("int").alias("rating"),
        F.col("text").alias("body"),
        F.col("lang"),
    )


def profiles(t: Tables) -> DataFrame:
    """Customer profile: segment, lifetime value, tenure in months."""
    o = (t.orders.groupBy("o_custkey")
         .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("ltv_dec"),
              F.min(F.to_date("o_orderdate")).alias("first_order"),
              F.max(F.to_date("o_orderdate")).alias("last_order")))
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    return j.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("ltv_dec").cast("double").alias("ltv"),
        _full_months("first_order", "last_order").alias("tenure_months"),
    )


def _full_months(start: str, end: str):
    """Whole calendar months from ``start`` to ``end`` (portable definition)."""
    s, e = F.col(start), F.col(end)
    months = (F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))
    return (months - F.when(F.dayofmonth(e) < F.dayofmonth(s), 1).otherwise(0)).cast("int")


def interactions(t: Tables) -> DataFrame:
    """Support-style interaction log from the events table."""
    e = t.events
    return e.select(
        F.col("event_id").alias("interaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("type"),
        F.format_string("[%s] value=%.2f", F.col("event_type"), F.col("value")).alias("summary"),
        F.col("ts").alias("date"),
    )


def user_items(t: Tables) -> DataFrame:
    """Implicit feedback rows (user, item, ts, type) for recommendation."""
    e = t.events.where(F.col("event_type").isin(*RECSYS_EVENT_TYPES))
    return e.select(
        "event_id", "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        "ts", F.col("event_type").alias("interaction_type"), "value",
    )


def drift_pair(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(baseline, current) event windows with numeric features."""
    e = t.events.select("event_id", "ts", "value", F.hour("ts").cast("double").alias("hour"))
    split = F.lit(DRIFT_SPLIT).cast("timestamp_ntz")
    return e.where(F.col("ts") < split), e.where(F.col("ts") >= split)


# --------------------------------------------------------------------------
# SQL twins (DuckDB dialect) for the oracle.
# --------------------------------------------------------------------------

VIEW_SQL = {
    "transactions": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_number,
               CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
               o_custkey AS customer_id, l_partkey AS article_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
               CAST(o_orderdate AS DATE) AS t_dat, o_orderpriority AS sales_channel,
               l_discount AS discount, l_returnflag AS return_flag
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "articles": """
        SELECT p_partkey AS article_id, p_name AS product_name, p_type AS product_type,
               p_brand AS department, p_retailprice AS price FROM part""",
    "reviews": """
        SELECT doc_id AS review_id,
               doc_id % (SELECT COUNT(*) FROM customer) AS customer_id,
               doc_id % (SELECT COUNT(*) FROM part) AS article_id,
               CAST(1 + n_chars % 5 AS INTEGER) AS rating, text AS body, lang
        FROM documents""",
    "profiles": """
        SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment,
               CAST(o.ltv_dec AS DOUBLE) AS ltv,
               CAST((year(o.last_order) * 12 + month(o.last_order)) - (year(o.first_order) * 12 + month(o.first_order))
                   - CASE WHEN day(o.last_order) < day(o.first_order) THEN 1 ELSE 0 END AS INTEGER) AS tenure_months
        FROM customer LEFT JOIN (
            SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS ltv_dec,
                   MIN(CAST(o_orderdate AS DATE)) AS first_order, MAX(CAST(o_orderdate AS DATE)) AS last_order
            FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey""",
    "interactions": """
        SELECT event_id AS interaction_id, user_id AS customer_id, event_type AS type,
               printf('[%s] value=%.2f', event_type, value) AS summary, ts AS date
        FROM events""",
    "user_items": """
        SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
               ts, event_type AS interaction_type, value
        FROM events WHERE event_type IN ('click', 'view', 'purchase')""",
    "drift_base": f"""
        SELECT event_id, ts, value, CAST(hour(ts) AS DOUBLE) AS hour FROM events
        WHERE ts < TIMESTAMP '{DRIFT_SPLIT}'""",
    "drift_cur": f"""
        SELECT event_id, ts, value, CAST(hour(ts) AS DOUBLE) AS hour FROM events
        WHERE ts >= TIMESTAMP '{DRIFT_SPLIT}'""",
}


def with_views(sql: str, *names: str, extra: dict | None = None) -> str:
    """Prefix ``sql`` with CTEs for the named views (in the given order)."""
    defs = dict(VIEW_SQL)
    defs.update(extra or {})
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in names)
    return f"WITH {ctes}\n{sql}" if names else sql


def catalog(t: Tables) -> DataFrame:
    """Product catalogue for search and explanations (from ``part``)."""
    p = t.part
    out = p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        F.concat_ws(" ", "p_brand", "p_name").alias("description"),
        F.array(F.lower("p_type"), F.col("p_brand")).alias("tags"),
        F.col("p_brand").alias("aisle"),
    )
    return out.withColumn("search_text", F.concat_ws(" ", "name", "description",
                                                     F.array_join("tags", " ")))


def model_replies(t: Tables) -> DataFrame:
    """Model-style JSON replies: plain, fenced in Markdown, or truncated."""
    e = t.events
    k = F.col("event_id") % 3
    reply = (F.when(k == 0, F.col("props"))
             .when(k == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
             .otherwise(F.expr("substring(props, 1, length(props) - 1)")))
    return e.select("event_id", reply.alias("reply"))


VIEW_SQL["catalog"] = """
    SELECT product_id, name, category, price, description, tags, aisle,
           concat_ws(' ', name, description, array_to_string(tags, ' ')) AS search_text
    FROM (SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_retailprice AS price,
                 concat_ws(' ', p_brand, p_name) AS description, [lower(p_type), p_brand] AS tags,
                 p_brand AS aisle FROM part)"""
VIEW_SQL["model_replies"] = """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN props
                          WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```'
                          ELSE substring(props, 1, length(props) - 1) END AS reply
    FROM events"""
