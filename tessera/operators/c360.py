"""Customer 360: interaction statistics, churn risk and trend, personas,
key interactions and timelines."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import lexicons as L
from tessera.operators.scale import ordered_positions
from tessera.operators.text_ops import latest_per_key


def ltv_tier(ltv: Column) -> Column:
    """HIGH above 2000, MEDIUM above 500, else LOW."""
    return F.when(ltv > 2000, "HIGH").when(ltv > 500, "MEDIUM").otherwise("LOW")


def retrieved(interactions: DataFrame, n: int = 10) -> DataFrame:
    """The interactions a persona is built from: the ``n`` newest per
    customer (per-key top-n; only n rows per key survive the sort)."""
    return latest_per_key(interactions, "customer_id", "date", "interaction_id", n)


def interaction_stats(interactions: DataFrame, complaint_terms: Sequence[str] = L.COMPLAINT_TERMS,
                      return_term: str = L.RETURN_TERM) -> DataFrame:
    """Per customer — interactions, distinct types, any return-type
    interaction, any complaint term in a summary, purchases."""
    low = F.lower("summary")
    complaint = F.lit(False)
    for t in complaint_terms:
        complaint = complaint | low.contains(t)
    return interactions.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.count_distinct("type").alias("n_types"),
        F.max(F.col("type").contains(return_term).cast("int")).cast("boolean").alias("has_returns"),
        F.max(complaint.cast("int")).cast("boolean").alias("has_complaints"),
        F.count_if(F.col("type") == "purchase").alias("purchase_count"))


def risk_and_trend(stats: DataFrame) -> DataFrame:
    """Churn risk and sentiment trend from the C1 flags."""
    c, r, p = F.col("has_complaints"), F.col("has_returns"), F.col("purchase_count")
    return (stats.withColumn("churn_risk", F.when(c & r, "HIGH").when(c, "MEDIUM").otherwise("LOW"))
                 .withColumn("sentiment_trend", F.when(c, "DECLINING").when(p >= 3, "IMPROVING")
                             .otherwise("STABLE")))


def key_interactions(retrieved_df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` retrieved interactions per customer (newest first),
    date cut to 10 characters and summary to 100."""
    top = latest_per_key(retrieved_df, "customer_id", "date", "interaction_id", n)
    w = Window.partitionBy("customer_id").orderBy(F.col("date").desc(), F.col("interaction_id").desc())
    return top.select("customer_id", F.row_number().over(w).cast("long").alias("pos"),
                      F.substring(F.col("date").cast("string"), 1, 10).alias("date"),
                      F.col("type"), F.substring("summary", 1, 100).alias("summary"))


def personas(profiles: DataFrame, interactions: DataFrame, complaint_terms=L.COMPLAINT_TERMS,
             return_term: str = L.RETURN_TERM, n: int = 10) -> DataFrame:
    """One persona row per profile (customers without interactions get
    zero counts): summary sentence, tiers, pain points, recommendations and the
    five newest interactions (date, type, first 100 characters)."""
    got = retrieved(interactions, n)
    stats = risk_and_trend(interaction_stats(got, complaint_terms, return_term))
    newest = F.sort_array(F.collect_list(F.struct("date", "interaction_id", "type", "summary")), asc=False)   # n per customer
    keys = got.groupBy("customer_id").agg(F.transform(F.slice(newest, 1, 5), lambda i: F.struct(
        F.substring(i["date"].cast("string"), 1, 10).alias("date"), F.coalesce(i["type"], F.lit("")).alias("type"),
        F.coalesce(F.substring(i["summary"], 1, 100), F.lit("")).alias("summary"))).alias("key_interactions"))
    p = profiles.join(stats, "customer_id", "left").join(keys, "customer_id", "left")
    p = p.fillna({"n_interactions": 0, "n_types": 0, "has_returns": False, "has_complaints": False,
                  "purchase_count": 0, "churn_risk": "LOW", "sentiment_trend": "STABLE"})
    comp, ret, high = F.col("has_complaints"), F.col("has_returns"), F.col("churn_risk") == "HIGH"
    summary = F.concat(
        F.coalesce(F.col("name"), F.lit("Customer")), F.lit(" is a "),
        F.coalesce(F.col("tenure_months"), F.lit(0)).cast("string"), F.lit("-month "),
        F.coalesce(F.col("segment"), F.lit("Standard")), F.lit(" customer with $"),
        F.format_number(F.coalesce(F.col("ltv"), F.lit(0.0)), 2), F.lit(" lifetime value. Recent activity shows "),
        F.col("n_interactions").cast("string"), F.lit(" interactions across "),
        F.col("n_types").cast("string"), F.lit(" channels. "),
        F.when(comp, "Shows signs of frustration requiring attention.").otherwise("Engagement pattern is healthy."))
    return p.select(
        "customer_id", summary.alias("summary"), "segment",
        ltv_tier(F.coalesce(F.col("ltv"), F.lit(0.0))).alias("lifetime_value_tier"),
        F.array(F.lit("Mobile app purchases"), F.lit("Quick resolution support"),
                F.concat(F.lit("Prefers "), F.lower("segment"), F.lit(" tier benefits"))).alias("preferences"),
        F.array(F.when(ret, "Shipping delays").otherwise("None identified"),
                F.when(comp, "Response time expectations").otherwise("Standard experience")).alias("pain_points"),
        "sentiment_trend", "churn_risk",
        F.array(F.when(high, "Proactive outreach with loyalty offer").otherwise("Continue standard engagement"),
                F.when(high, "Escalate to retention team").otherwise("Offer tier upgrade path"),
                F.lit("Personalize next campaign based on purchase history")).alias("recommendations"),
        F.least(F.col("n_interactions"), F.lit(5)).alias("n_key_interactions"),
        F.coalesce("key_interactions", F.array().cast(keys.schema["key_interactions"].dataType)).alias("key_interactions"))


def persona_export(personas_df: DataFrame) -> DataFrame:
    """P10: downstream view — summary, churn risk, next best action."""
    return personas_df.select("customer_id", "summary", "churn_risk",
                              F.col("recommendations")[0].alias("next_best_action"))


def timeline(interactions: DataFrame, descending: bool = False) -> DataFrame:
    """K3: per-customer timeline position (ascending by default), computed
    per (customer, day) piece so one busy customer is not one task."""
    pos = ordered_positions(interactions, "date", "interaction_id", "day", key="customer_id")
    if descending:
        n = interactions.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
        pos = pos.join(n, "customer_id").withColumn("position", F.col("_n") - 1 - F.col("position")).drop("_n")
    return pos
