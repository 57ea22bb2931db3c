"""Feature tables: calendar columns, trailing windows, churn / RFM / demand.

Window functions are always partitioned by a series key; series are daily
aggregates, so a partition is bounded by the length of the calendar, not by
the size of the fact table.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.numeric import money_avg_2dp, money_sum
from tessera.operators.scale import session_table


def _d(x) -> Column:
    return F.lit(x).cast("date") if isinstance(x, str) else x


# ---- scalar predicates / projections --------------------------------------

def scan_since(df: DataFrame, col: str, as_of, days: int) -> DataFrame:
    """Rows with ``as_of − days <= col <= as_of`` (pushed to the scan)."""
    return df.where((F.col(col) >= F.date_sub(_d(as_of), days)) & (F.col(col) <= _d(as_of)))


def recency_days(as_of, col: str) -> Column:
    """Whole days between the last event and the as-of date."""
    return F.datediff(_d(as_of), F.col(col))


def calendar_cols(df: DataFrame, date_col: str) -> DataFrame:
    """Weekday (Monday = 0) and weekend flag (weekday >= 5)."""
    return (df.withColumn("weekday", F.weekday(date_col))
              .withColumn("is_weekend", (F.weekday(date_col) >= 5).cast("int")))


def fill_default(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    """P5: nulls in ``cols`` replaced by ``value``."""
    return df.fillna({c: value for c in cols})


def case_label(cond: Column) -> Column:
    """1 when the condition holds, else 0 (null counts as false)."""
    return F.when(cond, 1).otherwise(0)


# ---- window features ------------------------------------------------------

def trailing_sum(df: DataFrame, key, order: str, col: str, rows: int = 7,
                 name: str | None = None) -> DataFrame:
    """Sum over the current row and the ``rows − 1`` before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name or f"sum_{rows}_{col}", F.sum(col).over(w))


def trailing_avg(df: DataFrame, key, order: str, col: str, rows: int = 14,
                 name: str | None = None) -> DataFrame:
    """Mean over the current row and the ``rows − 1`` before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name or f"avg_{rows}_{col}",
                         F.sum(col).over(w).cast("double") / F.count(col).over(w))


def lags(df: DataFrame, key, order: str, col: str, offsets=(7, 14)) -> DataFrame:
    """Value ``k`` rows earlier in the series (null before the start)."""
    w = Window.partitionBy(key).orderBy(order)
    for k in offsets:
        df = df.withColumn(f"lag_{k}_{col}", F.lag(col, k).over(w))
    return df


def densify_days(df: DataFrame, key: str, date_col: str, cols: Sequence[str]) -> DataFrame:
    """One row per calendar day between each series' first and last day,
    zero-filled. The calendar is generated per series (bounded by its span)."""
    span = df.groupBy(key).agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    cal = span.select(key, F.explode(F.sequence("_lo", "_hi")).alias(date_col))
    out = cal.join(df, [key, date_col], "left")
    return out.fillna({c: 0 for c in cols})


def last_n_mean(df: DataFrame, key, order: str, col: str, n: int = 7,
                name: str = "last_n_mean") -> DataFrame:
    """Mean of the last ``n`` values of every series (top-n per key is
    planned as a WindowGroupLimit, so only n rows per key reach the sort)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    keys = [key] if isinstance(key, str) else list(key)
    return last.groupBy(*keys).agg((F.sum(col).cast("double") / F.count(col)).alias(name),
                                   F.count(col).alias("n_points"))


# ---- feature tables -------------------------------------------------------

def demand_features(mart: DataFrame, as_of, days: int = 90) -> DataFrame:
    """M3: demand mart restricted to the trailing window, with calendar
    columns, 7-row trailing sum and 14-row trailing mean per article."""
    d = scan_since(mart, "t_dat", as_of, days).withColumnRenamed("t_dat", "date")
    d = calendar_cols(d, "date")
    d = trailing_sum(d, "article_id", "date", "daily_units_sold", 7, "lag_7d_units")
    d = trailing_avg(d, "article_id", "date", "daily_units_sold", 14, "rolling_14d_avg_units")
    return d.select("date", "article_id", "product_type", "daily_units_sold", "daily_revenue",
                    "weekday", "is_weekend", "lag_7d_units", "rolling_14d_avg_units")


def churn_features(tx: DataFrame, reviews: DataFrame, events: DataFrame | None,
                   cutoff, horizon_days: int = 90, active_months: int = 12,
                   session_gap_s: int = 1800) -> DataFrame:
    """M1: nine behaviour features known at ``cutoff`` plus the churn label
    (no purchase in (cutoff, cutoff + horizon]); customers active in the year
    before the cutoff only.

    support_tickets = returned lines; discount_code_usage_ratio = share of
    discounted lines; session_count_30d = distinct purchase days in the 30
    days up to the cutoff; avg_session_duration_s = mean app-session length
    (30-minute gap) from the event log up to the cutoff day. Reviews carry no
    date; pass only those written by the cutoff.
    """
    c = _d(cutoff)
    if events is not None:
        events = events.where(F.to_date("ts") <= c)
    past = tx.where(F.col("t_dat") <= c)
    feats = past.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        money_sum("price").alias("total_spend"),
        money_avg_2dp("price").alias("avg_order_value"),
        F.max("t_dat").alias("last_purchase_date"),
        F.count_if(F.col("return_flag") == "R").alias("support_tickets"),
        (F.count_if(F.col("discount") > 0) / F.count(F.lit(1))).alias("discount_code_usage_ratio"),
        F.countDistinct(F.when(F.col("t_dat") > F.date_sub(c, 30), F.col("t_dat"))).alias("session_count_30d"),
    )
    feats = feats.where(F.col("last_purchase_date") >= F.add_months(c, -active_months))
    future = (tx.where((F.col("t_dat") > c) & (F.col("t_dat") <= F.date_add(c, horizon_days)))
              .select("customer_id").distinct().withColumn("_bought", F.lit(1)))
    rating = reviews.groupBy("customer_id").agg(
        (F.sum("rating").cast("double") / F.count("rating")).alias("avg_review_rating"))
    out = feats.join(rating, "customer_id", "left").join(future, "customer_id", "left")
    if events is not None:
        sess = (session_table(events, "user_id", "ts", session_gap_s, "event_id")
                .groupBy("user_id").agg(
                    (F.sum("duration_us") / F.count("duration_us") / 1e6).alias("avg_session_duration_s"))
                .withColumnRenamed("user_id", "customer_id"))
        out = out.join(sess, "customer_id", "left")
    else:
        out = out.withColumn("avg_session_duration_s", F.lit(None).cast("double"))
    return out.select(
        "customer_id", "order_count", "total_spend", "avg_order_value",
        recency_days(c, "last_purchase_date").alias("days_since_last_purchase"),
        "support_tickets", "avg_review_rating", "discount_code_usage_ratio",
        "session_count_30d", "avg_session_duration_s",
        case_label(F.col("_bought").isNull()).alias("churned"))


def rfm_features(mart: DataFrame, as_of) -> DataFrame:
    """M2 (+P6): recency / frequency / monetary / basket / breadth."""
    return mart.select(
        "customer_id",
        recency_days(as_of, "last_purchase_date").alias("recency"),
        F.col("order_count").alias("frequency"),
        F.col("total_spend").alias("monetary"),
        F.col("avg_order_value").alias("avg_basket_size"),
        F.coalesce(F.col("category_breadth"), F.lit(1)).cast("long").alias("category_breadth"),
    )
