"""Customer 360 queries."""

from __future__ import annotations

from tessera.operators import c360 as C
from tessera.plans.catalog import query
from tessera.sources import Tables
from tessera.sources import views as V
from tessera.sources.views import with_views

# Driver data: complaints show as 'error' events, returns as 'signup' events
# (so that every churn / trend branch has rows).
COMPLAINT, RETURN = ("error",), "signup"

RETRIEVED_SQL = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY date DESC, interaction_id DESC) AS rn
                   FROM interactions) WHERE rn <= 10"""
STATS_SQL = f"""
    SELECT customer_id, COUNT(*) AS n_interactions, COUNT(DISTINCT type) AS n_types,
           bool_or(contains(type, '{RETURN}')) AS has_returns,
           bool_or(contains(lower(summary), '{COMPLAINT[0]}')) AS has_complaints,
           COUNT(*) FILTER (WHERE type = 'purchase') AS purchase_count
    FROM retrieved GROUP BY customer_id"""
RISK_SQL = """
    SELECT *, CASE WHEN has_complaints AND has_returns THEN 'HIGH' WHEN has_complaints THEN 'MEDIUM' ELSE 'LOW' END AS churn_risk,
              CASE WHEN has_complaints THEN 'DECLINING' WHEN purchase_count >= 3 THEN 'IMPROVING' ELSE 'STABLE' END AS sentiment_trend
    FROM stats"""
PERSONA_SQL = """
    SELECT p.customer_id,
           COALESCE(p.name, 'Customer') || ' is a ' || CAST(COALESCE(p.tenure_months, 0) AS VARCHAR) || '-month '
           || COALESCE(p.segment, 'Standard') || ' customer with $' || format('{:,.2f}', COALESCE(p.ltv, 0.0))
           || ' lifetime value. Recent activity shows ' || CAST(COALESCE(r.n_interactions, 0) AS VARCHAR)
           || ' interactions across ' || CAST(COALESCE(r.n_types, 0) AS VARCHAR) || ' channels. '
           || CASE WHEN COALESCE(r.has_complaints, false) THEN 'Shows signs of frustration requiring attention.'
                   ELSE 'Engagement pattern is healthy.' END AS summary,
           p.segment,
           CASE WHEN COALESCE(p.ltv, 0) > 2000 THEN 'HIGH' WHEN COALESCE(p.ltv, 0) > 500 THEN 'MEDIUM' ELSE 'LOW' END AS lifetime_value_tier,
           ['Mobile app purchases', 'Quick resolution support', 'Prefers ' || lower(p.segment) || ' tier benefits'] AS preferences,
           [CASE WHEN COALESCE(r.has_returns, false) THEN 'Shipping delays' ELSE 'None identified' END,
            CASE WHEN COALESCE(r.has_complaints, false) THEN 'Response time expectations' ELSE 'Standard experience' END] AS pain_points,
           COALESCE(r.sentiment_trend, 'STABLE') AS sentiment_trend, COALESCE(r.churn_risk, 'LOW') AS churn_risk,
           [CASE WHEN r.churn_risk = 'HIGH' THEN 'Proactive outreach with loyalty offer' ELSE 'Continue standard engagement' END,
            CASE WHEN r.churn_risk = 'HIGH' THEN 'Escalate to retention team' ELSE 'Offer tier upgrade path' END,
            'Personalize next campaign based on purchase history'] AS recommendations,
           least(COALESCE(r.n_interactions, 0), 5) AS n_key_interactions
    FROM profiles p LEFT JOIN risk r ON p.customer_id = r.customer_id"""
_X = {"retrieved": RETRIEVED_SQL, "stats": STATS_SQL, "risk": RISK_SQL, "personas": PERSONA_SQL}
_ALL = ("profiles", "interactions", "retrieved", "stats", "risk", "personas")


def _personas(spark, sf):
    t = Tables(spark, sf)
    return C.personas(V.profiles(t), V.interactions(t), COMPLAINT, RETURN)


@query("c4_profiles", sql=with_views("SELECT * FROM profiles", "profiles"))
def q_c4(spark, sf):
    return V.profiles(Tables(spark, sf))


@query("c1_interaction_stats", sql=with_views("SELECT * FROM stats", "interactions", "retrieved", "stats", extra=_X))
def q_c1(spark, sf):
    return C.interaction_stats(C.retrieved(V.interactions(Tables(spark, sf))), COMPLAINT, RETURN)


@query("c2_risk_and_trend", sql=with_views(
    "SELECT customer_id, churn_risk, sentiment_trend FROM risk", "interactions", "retrieved", "stats", "risk", extra=_X))
def q_c2(spark, sf):
    s = C.interaction_stats(C.retrieved(V.interactions(Tables(spark, sf))), COMPLAINT, RETURN)
    return C.risk_and_trend(s).select("customer_id", "churn_risk", "sentiment_trend")


@query("c3_personas", bench=True, sql=with_views("SELECT * FROM personas", *_ALL, extra=_X))
def q_c3(spark, sf):
    return _personas(spark, sf).drop("key_interactions")


@query("c3_key_interactions", sql=with_views("""
    SELECT customer_id, rn AS pos, strftime(date, '%Y-%m-%d') AS date, type, substring(summary, 1, 100) AS summary
    FROM retrieved JOIN profiles USING (customer_id) WHERE rn <= 5""", "profiles", "interactions", "retrieved", extra=_X))
def q_c3_keys(spark, sf):
    """The interactions inside each persona, one row each."""
    from pyspark.sql import functions as F
    rows = _personas(spark, sf).select("customer_id", F.posexplode_outer("key_interactions").alias("pos", "i"))
    return rows.where("i is not null").select("customer_id", (F.col("pos") + 1).cast("long").alias("pos"), "i.*")


@query("p10_persona_export", sql=with_views(
    "SELECT customer_id, summary, churn_risk, recommendations[1] AS next_best_action FROM personas", *_ALL, extra=_X))
def q_p10(spark, sf):
    return C.persona_export(_personas(spark, sf))


@query("p8_ltv_tier_counts", sql=with_views("""
    SELECT CASE WHEN COALESCE(ltv, 0) > 2000 THEN 'HIGH' WHEN COALESCE(ltv, 0) > 500 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
           COUNT(*) AS n FROM profiles GROUP BY 1""", "profiles"))
def q_p8(spark, sf):
    from pyspark.sql import functions as F
    p = V.profiles(Tables(spark, sf))
    return p.groupBy(C.ltv_tier(F.coalesce(F.col("ltv"), F.lit(0.0))).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("p8_balance_tier_counts", sql="""
    SELECT CASE WHEN c_acctbal > 2000 THEN 'HIGH' WHEN c_acctbal > 500 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
           COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM customer GROUP BY 1""")
def q_p8_balance(spark, sf):
    """The tier rule on account balances, which reach all three tiers."""
    from pyspark.sql import functions as F
    c = Tables(spark, sf).customer.select("c_acctbal")
    return c.groupBy(C.ltv_tier(F.col("c_acctbal")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


@query("w8_key_interactions", sql=with_views("""
    SELECT customer_id, rn AS pos, strftime(date, '%Y-%m-%d') AS date, type, substring(summary, 1, 100) AS summary
    FROM retrieved WHERE rn <= 5""", "interactions", "retrieved", extra=_X))
def q_w8(spark, sf):
    return C.key_interactions(C.retrieved(V.interactions(Tables(spark, sf))), 5)


@query("k3_timeline", sql=with_views("""
    SELECT interaction_id, customer_id, date,
           row_number() OVER (PARTITION BY customer_id ORDER BY date, interaction_id) - 1 AS position
    FROM interactions""", "interactions"))
def q_k3(spark, sf):
    i = V.interactions(Tables(spark, sf)).select("interaction_id", "customer_id", "date")
    return C.timeline(i)


@query("k3_timeline_desc", sql=with_views("""
    SELECT interaction_id, customer_id, date,
           row_number() OVER (PARTITION BY customer_id ORDER BY date DESC, interaction_id DESC) - 1 AS position
    FROM interactions""", "interactions"))
def q_k3_desc(spark, sf):
    i = V.interactions(Tables(spark, sf)).select("interaction_id", "customer_id", "date")
    return C.timeline(i, descending=True)
