"""Marts, calendar and window features, churn / RFM / demand tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions.numeric import MONEY_AVG_2DP_SQL
from tessera.operators import features as FE
from tessera.operators import marts as M
from tessera.plans.catalog import query
from tessera.sources import Tables
from tessera.sources import views as V
from tessera.sources.views import with_views

# Query parameters (fixed so every run is repeatable).
AS_OF = "2001-08-01"       # last order date in the driver data
CUTOFF = "2001-05-01"      # churn cutoff; label window 90 days after it
POS = L.DRIVER_POSITIVE
NEG = L.DRIVER_NEGATIVE


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


AVG_CENTS = MONEY_AVG_2DP_SQL.format(c="price")

# DuckDB twins of the marts, reused by many oracle queries.
MART_SQL = {
    "demand_mart": """
        SELECT t.article_id, t.t_dat, COUNT(*) AS daily_units_sold,
               CAST(SUM(t.price) AS DOUBLE) AS daily_revenue, a.product_type
        FROM transactions t LEFT JOIN articles a ON t.article_id = a.article_id
        GROUP BY t.article_id, t.t_dat, a.product_type""",
    "customer_mart": f"""
        SELECT s.*, r.avg_review_rating FROM (
            SELECT t.customer_id, COUNT(*) AS order_count,
                   CAST(SUM(t.price) AS DOUBLE) AS total_spend,
                   {MONEY_AVG_2DP_SQL.format(c="t.price")} AS avg_order_value,
                   MAX(t.t_dat) AS last_purchase_date, MIN(t.t_dat) AS first_purchase_date,
                   COUNT(DISTINCT a.product_type) AS category_breadth
            FROM transactions t LEFT JOIN articles a ON t.article_id = a.article_id
            GROUP BY t.customer_id) s
        LEFT JOIN (SELECT customer_id, CAST(SUM(rating) AS DOUBLE) / COUNT(rating) AS avg_review_rating
                   FROM reviews GROUP BY customer_id) r ON s.customer_id = r.customer_id""",
}


def _views(spark, sf):
    return Tables(spark, sf)


def demand_mart(spark, sf):
    t = _views(spark, sf)
    return M.demand_mart(V.transactions(t), V.articles(t))


def customer_mart(spark, sf):
    t = _views(spark, sf)
    return M.customer_mart(V.transactions(t), V.reviews(t), V.articles(t))


# ---------------------------------------------------------------------------

@query("a3_demand_mart", bench=True, sql=with_views(
    "SELECT * FROM demand_mart", "transactions", "articles", "demand_mart",
    extra={"demand_mart": MART_SQL["demand_mart"]}))
def q_a3(spark, sf):
    return demand_mart(spark, sf)


@query("a1_customer_mart", bench=True, sql=with_views(
    "SELECT * FROM customer_mart", "transactions", "articles", "reviews", "customer_mart",
    extra={"customer_mart": MART_SQL["customer_mart"]}))
def q_a1(spark, sf):
    return customer_mart(spark, sf)


@query("a1_customer_mart_distinct_tx", sql=with_views("""
    SELECT customer_id, COUNT(DISTINCT transaction_id) AS order_count,
           CAST(SUM(price) AS DOUBLE) AS total_spend, """ + AVG_CENTS + """ AS avg_order_value,
           MAX(t_dat) AS last_purchase_date, MIN(t_dat) AS first_purchase_date
    FROM transactions GROUP BY customer_id""", "transactions"))
def q_a1_distinct(spark, sf):
    """D4 variant: distinct transaction ids (the key has real duplicates)."""
    t = _views(spark, sf)
    return M.customer_mart(V.transactions(t), distinct=True)


@query("a2_article_sentiment_mart", bench=True, sql=with_views(f"""
    SELECT s.*, a.product_type FROM (
      SELECT article_id,
             CAST(SUM(score) AS DOUBLE) / COUNT(score) AS avg_sentiment,
             COUNT(review_id) AS review_count,
             CAST(SUM(rating) AS DOUBLE) / COUNT(rating) AS avg_rating
      FROM (SELECT review_id, article_id, rating,
                   CAST(CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 3) ELSE 0 END AS DECIMAL(6,3)) AS score
            FROM (SELECT review_id, article_id, rating,
                         len(list_intersect(list_distinct(w), {_sql_list(POS)})) AS p,
                         len(list_intersect(list_distinct(w), {_sql_list(NEG)})) AS n
                  FROM (SELECT *, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+') AS w FROM reviews)))
      GROUP BY article_id) s
    LEFT JOIN articles a ON s.article_id = a.article_id""", "reviews", "articles"))
def q_a2(spark, sf):
    t = _views(spark, sf)
    return M.article_sentiment_mart(V.reviews(t), V.articles(t), POS, NEG)


@query("s9_mart_row_counts", sql=with_views("""
    SELECT 'customer' AS mart, COUNT(DISTINCT customer_id) AS row_count FROM transactions
    UNION ALL SELECT 'article_sentiment', COUNT(DISTINCT article_id) FROM reviews
    UNION ALL SELECT 'demand', COUNT(*) FROM (SELECT DISTINCT article_id, t_dat FROM transactions)""",
    "transactions", "reviews"))
def q_s9(spark, sf):
    t = _views(spark, sf)
    tx, rv, ar = V.transactions(t), V.reviews(t), V.articles(t)
    return M.mart_row_counts(customer=M.customer_mart(tx),
                             article_sentiment=M.article_sentiment_mart(rv, ar, POS, NEG),
                             demand=M.demand_mart(tx, ar))


# ---- windows --------------------------------------------------------------

_DEMAND = {"demand_mart": MART_SQL["demand_mart"]}

M3_SQL = with_views(f"""
    SELECT t_dat AS date, article_id, product_type, daily_units_sold, daily_revenue,
           CAST(isodow(t_dat) - 1 AS INTEGER) AS weekday,
           CAST(CASE WHEN isodow(t_dat) - 1 >= 5 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
           CAST(SUM(daily_units_sold) OVER w7 AS BIGINT) AS lag_7d_units,
           CAST(SUM(daily_units_sold) OVER w14 AS DOUBLE) / COUNT(daily_units_sold) OVER w14 AS rolling_14d_avg_units
    FROM demand_mart
    WHERE t_dat >= DATE '{AS_OF}' - INTERVAL 90 DAY AND t_dat <= DATE '{AS_OF}'
    WINDOW w7 AS (PARTITION BY article_id ORDER BY t_dat ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
           w14 AS (PARTITION BY article_id ORDER BY t_dat ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "transactions", "articles", "demand_mart", extra=_DEMAND)


@query("m3_demand_features", sql=M3_SQL, bench=True)
def q_m3(spark, sf):
    return FE.demand_features(demand_mart(spark, sf), AS_OF, 90)


@query("w1_trailing_sum_7", sql=with_views("""
    SELECT article_id, t_dat, daily_units_sold,
           CAST(SUM(daily_units_sold) OVER (PARTITION BY article_id ORDER BY t_dat
                ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS units_7_rows
    FROM demand_mart""", "transactions", "articles", "demand_mart", extra=_DEMAND))
def q_w1(spark, sf):
    d = demand_mart(spark, sf).select("article_id", "t_dat", "daily_units_sold")
    return FE.trailing_sum(d, "article_id", "t_dat", "daily_units_sold", 7, "units_7_rows")


@query("w2_trailing_avg_14", sql=with_views("""
    SELECT article_id, t_dat, CAST(daily_revenue AS DOUBLE) AS daily_revenue,
           CAST(SUM(daily_revenue) OVER w AS DOUBLE) / COUNT(daily_revenue) OVER w AS revenue_14_rows
    FROM (SELECT article_id, t_dat, CAST(daily_revenue AS DECIMAL(18,2)) AS daily_revenue FROM demand_mart)
    WINDOW w AS (PARTITION BY article_id ORDER BY t_dat ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "transactions", "articles", "demand_mart", extra=_DEMAND))
def q_w2(spark, sf):
    d = (demand_mart(spark, sf)
         .select("article_id", "t_dat", F.col("daily_revenue").cast("decimal(18,2)").alias("daily_revenue")))
    d = FE.trailing_avg(d, "article_id", "t_dat", "daily_revenue", 14, "revenue_14_rows")
    return d.withColumn("daily_revenue", F.col("daily_revenue").cast("double")) \
            .withColumn("revenue_14_rows", F.col("revenue_14_rows").cast("double"))


TYPE_SERIES_SQL = """
    SELECT a.product_type, t.t_dat, COUNT(*) AS units
    FROM transactions t JOIN articles a ON t.article_id = a.article_id
    GROUP BY a.product_type, t.t_dat"""


def type_series(spark, sf):
    """Daily units per product type (the forecast series, D10: summed per day)."""
    t = _views(spark, sf)
    tx = V.transactions(t).join(V.articles(t).select("article_id", "product_type"), "article_id")
    return tx.groupBy("product_type", "t_dat").agg(F.count(F.lit(1)).alias("units"))


@query("w3_lags_7_14", sql=with_views("""
    SELECT product_type, t_dat, units,
           lag(units, 7) OVER w AS lag_7_units, lag(units, 14) OVER w AS lag_14_units
    FROM type_series WINDOW w AS (PARTITION BY product_type ORDER BY t_dat)""",
    "transactions", "articles", "type_series", extra={"type_series": TYPE_SERIES_SQL}))
def q_w3(spark, sf):
    return FE.lags(type_series(spark, sf), "product_type", "t_dat", "units", (7, 14))


@query("w4_dense_calendar_windows", sql=with_views("""
    SELECT d.product_type, d.t_dat, d.units,
           lag(d.units, 7) OVER w AS lag_7_units,
           CAST(SUM(d.units) OVER (PARTITION BY d.product_type ORDER BY d.t_dat
                ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS units_7d
    FROM (SELECT c.product_type, CAST(c.t_dat AS DATE) AS t_dat, COALESCE(s.units, 0) AS units
          FROM (SELECT product_type, unnest(generate_series(min(t_dat), max(t_dat), INTERVAL 1 DAY)) AS t_dat
                FROM type_series GROUP BY product_type) c
          LEFT JOIN type_series s ON c.product_type = s.product_type AND CAST(c.t_dat AS DATE) = s.t_dat) d
    WINDOW w AS (PARTITION BY d.product_type ORDER BY d.t_dat)""",
    "transactions", "articles", "type_series", extra={"type_series": TYPE_SERIES_SQL}))
def q_w4(spark, sf):
    dense = FE.densify_days(type_series(spark, sf), "product_type", "t_dat", ["units"])
    dense = FE.lags(dense, "product_type", "t_dat", "units", (7,))
    dense = FE.trailing_sum(dense, "product_type", "t_dat", "units", 7, "units_7d")
    return dense.select("product_type", "t_dat", "units", "lag_7_units", "units_7d")


@query("w9_last_7_mean", sql=with_views("""
    SELECT product_type, CAST(SUM(units) AS DOUBLE) / COUNT(units) AS last_n_mean, COUNT(units) AS n_points
    FROM (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY t_dat DESC) AS rn FROM type_series)
    WHERE rn <= 7 GROUP BY product_type""",
    "transactions", "articles", "type_series", extra={"type_series": TYPE_SERIES_SQL}))
def q_w9(spark, sf):
    return FE.last_n_mean(type_series(spark, sf), "product_type", "t_dat", "units", 7)


@query("p7_calendar_cols", sql=with_views("""
    SELECT t_dat, CAST(isodow(t_dat) - 1 AS INTEGER) AS weekday,
           CAST(CASE WHEN isodow(t_dat) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
           COUNT(*) AS n_lines
    FROM transactions GROUP BY t_dat""", "transactions"))
def q_p7(spark, sf):
    tx = V.transactions(_views(spark, sf))
    return FE.calendar_cols(tx.groupBy("t_dat").agg(F.count(F.lit(1)).alias("n_lines")), "t_dat")


@query("s7_scan_since_180d", sql=with_views(f"""
    SELECT article_id, t_dat, daily_units_sold FROM demand_mart
    WHERE t_dat >= DATE '{AS_OF}' - INTERVAL 180 DAY AND t_dat <= DATE '{AS_OF}'""",
    "transactions", "articles", "demand_mart", extra=_DEMAND))
def q_s7(spark, sf):
    d = demand_mart(spark, sf).select("article_id", "t_dat", "daily_units_sold")
    return FE.scan_since(d, "t_dat", AS_OF, 180)


# ---- feature tables -------------------------------------------------------

SESSIONS_SQL = """
    SELECT user_id, sid, min(ts) AS s_start, max(ts) AS s_end,
           epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us
    FROM (SELECT user_id, ts, SUM(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
          FROM (SELECT user_id, ts, event_id,
                       CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                              OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 1800000000
                            THEN 1 ELSE 0 END AS new_s
                FROM events))
    GROUP BY user_id, sid"""

M1_SQL = with_views(f"""
    SELECT f.customer_id, f.order_count, f.total_spend, f.avg_order_value,
           CAST(DATE '{CUTOFF}' - f.last_purchase_date AS INTEGER) AS days_since_last_purchase,
           f.support_tickets, r.avg_review_rating, f.discount_code_usage_ratio, f.session_count_30d,
           s.avg_session_duration_s,
           CAST(CASE WHEN b.customer_id IS NULL THEN 1 ELSE 0 END AS INTEGER) AS churned
    FROM (SELECT customer_id, COUNT(*) AS order_count, CAST(SUM(price) AS DOUBLE) AS total_spend,
                 {AVG_CENTS} AS avg_order_value, MAX(t_dat) AS last_purchase_date,
                 COUNT(*) FILTER (WHERE return_flag = 'R') AS support_tickets,
                 CAST(COUNT(*) FILTER (WHERE discount > 0) AS DOUBLE) / COUNT(*) AS discount_code_usage_ratio,
                 COUNT(DISTINCT CASE WHEN t_dat > DATE '{CUTOFF}' - INTERVAL 30 DAY THEN t_dat END) AS session_count_30d
          FROM transactions WHERE t_dat <= DATE '{CUTOFF}' GROUP BY customer_id) f
    LEFT JOIN (SELECT customer_id, CAST(SUM(rating) AS DOUBLE) / COUNT(rating) AS avg_review_rating
               FROM reviews GROUP BY customer_id) r ON f.customer_id = r.customer_id
    LEFT JOIN (SELECT DISTINCT customer_id FROM transactions
               WHERE t_dat > DATE '{CUTOFF}' AND t_dat <= DATE '{CUTOFF}' + INTERVAL 90 DAY) b
           ON f.customer_id = b.customer_id
    LEFT JOIN (SELECT user_id, CAST(SUM(duration_us) AS DOUBLE) / COUNT(duration_us) / 1e6 AS avg_session_duration_s
               FROM sessions GROUP BY user_id) s ON f.customer_id = s.user_id
    WHERE f.last_purchase_date >= DATE '{CUTOFF}' - INTERVAL 1 YEAR""",
    "transactions", "reviews", "sessions", extra={"sessions": SESSIONS_SQL})


@query("m1_churn_features", sql=M1_SQL, bench=True)
def q_m1(spark, sf):
    t = _views(spark, sf)
    # the event log starts years after the last order: its clock is set back by a
    # fixed number of days, so that it ends before the cutoff (lengths stay)
    events = t.events.withColumn("ts", F.col("ts") - F.expr("INTERVAL 8500 DAYS"))
    return FE.churn_features(V.transactions(t), V.reviews(t), events, CUTOFF, 90, 12)


@query("m2_rfm_features", sql=with_views(f"""
    SELECT customer_id, CAST(DATE '{AS_OF}' - last_purchase_date AS INTEGER) AS recency,
           order_count AS frequency, total_spend AS monetary, avg_order_value AS avg_basket_size,
           CAST(COALESCE(category_breadth, 1) AS BIGINT) AS category_breadth
    FROM customer_mart""", "transactions", "articles", "reviews", "customer_mart",
    extra={"customer_mart": MART_SQL["customer_mart"]}))
def q_m2(spark, sf):
    return FE.rfm_features(customer_mart(spark, sf), AS_OF)


@query("x6_session_table_batch", sql=with_views(
    "SELECT user_id, CAST(sid AS BIGINT) AS session_id, s_start AS session_start, s_end AS session_end, duration_us FROM sessions",
    "sessions", extra={"sessions": SESSIONS_SQL}))
def q_sessions(spark, sf):
    from tessera.operators.scale import session_table
    s = session_table(Tables(spark, sf).events, "user_id", "ts", 1800, "event_id")
    return s.select("user_id", "session_id", "session_start", "session_end", "duration_us")


@query("k4_sorted_series", sql=with_views("""
    SELECT article_id, t_dat, daily_units_sold FROM demand_mart ORDER BY article_id, t_dat""",
    "transactions", "articles", "demand_mart", extra=_DEMAND))
def q_k4(spark, sf):
    """ORDER BY article, date: a range-partitioned sort (no single partition)."""
    return demand_mart(spark, sf).select("article_id", "t_dat", "daily_units_sold").orderBy("article_id", "t_dat")
