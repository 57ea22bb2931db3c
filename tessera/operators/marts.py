"""Analytics marts: customer behaviour, article sentiment, daily demand.

Aggregations are written aggregate-before-join (both sides are reduced to one
row per key first), so the join only ever sees key-sized inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import lexicons as L
from tessera.functions.numeric import money_avg_2dp, money_sum, dec_avg
from tessera.functions.text import lexicon_score


def customer_mart(tx: DataFrame, reviews: DataFrame | None = None,
                  articles: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """A1 (+J1): per customer — line count, spend, mean price, last / first date,
    distinct product types (needs ``articles``), mean review rating (left join).

    ``distinct=True`` counts distinct transaction ids instead of rows.
    """
    base = tx
    if articles is not None:
        base = tx.join(articles.select("article_id", "product_type"), "article_id", "left")
    cnt = (F.countDistinct("transaction_id") if distinct else F.count(F.lit(1)))
    aggs = [cnt.alias("order_count"),
            money_sum("price").alias("total_spend"),
            money_avg_2dp("price").alias("avg_order_value"),
            F.max("t_dat").alias("last_purchase_date"),
            F.min("t_dat").alias("first_purchase_date")]
    if articles is not None:
        aggs.append(F.countDistinct("product_type").alias("category_breadth"))
    spend = base.groupBy("customer_id").agg(*aggs)
    if reviews is None:
        return spend
    rating = (reviews.groupBy("customer_id")
              .agg((F.sum("rating").cast("double") / F.count("rating")).alias("avg_review_rating")))
    return spend.join(rating, "customer_id", "left")


def scored_reviews(reviews: DataFrame, positive=L.MART_POSITIVE,
                   negative=L.MART_NEGATIVE) -> DataFrame:
    """T1 applied to every review body."""
    return reviews.withColumn("sentiment_score", lexicon_score("body", positive, negative))


def article_sentiment_mart(reviews: DataFrame, articles: DataFrame,
                           positive=L.MART_POSITIVE, negative=L.MART_NEGATIVE) -> DataFrame:
    """A2 (+J2): per article — mean T1 score, review count, mean rating, type."""
    agg = (scored_reviews(reviews, positive, negative).groupBy("article_id")
           .agg(dec_avg("sentiment_score", 3).alias("avg_sentiment"),
                F.count("review_id").alias("review_count"),
                (F.sum("rating").cast("double") / F.count("rating")).alias("avg_rating")))
    return with_article_dim(agg, articles, ["product_type"])


def with_article_dim(fact: DataFrame, articles: DataFrame, cols) -> DataFrame:
    """Fact ⟕ article dimension on ``article_id``.

    No broadcast hint: the dimension grows with the catalogue, so the choice is
    left to the size-checked planner (autoBroadcastJoinThreshold + AQE).
    """
    return fact.join(articles.select("article_id", *cols), "article_id", "left")


def demand_mart(tx: DataFrame, articles: DataFrame) -> DataFrame:
    """A3 (+J2): units (lines) and revenue per (article, day), with product type."""
    agg = (tx.groupBy("article_id", "t_dat")
           .agg(F.count(F.lit(1)).alias("daily_units_sold"),
                money_sum("price").alias("daily_revenue")))
    return with_article_dim(agg, articles, ["product_type"])


def mart_row_counts(**marts: DataFrame) -> DataFrame:
    """One row per mart with its row count, computed in one job."""
    parts = [df.select(F.lit(name).alias("mart")) for name, df in marts.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy("mart").agg(F.count(F.lit(1)).alias("row_count"))
