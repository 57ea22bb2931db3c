"""Drift and retraining queries: global baseline-vs-current checks and a
per-day drift / retraining decision table."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tessera.operators import drift as D
from tessera.plans.catalog import query
from tessera.sources import Tables
from tessera.sources import views as V
from tessera.sources.views import DRIFT_SPLIT, with_views

FEATURES = ("value", "hour")
TRAINED_ON = "2024-01-15"   # last day of the baseline window (model training day)
BASE_VIEWS = ("drift_base", "drift_cur")


def conversion(df):
    """Business metric: purchases per click-or-view event."""
    return F.try_divide(F.count_if(F.col("event_type") == "purchase"),
                        F.count_if(F.col("event_type").isin("click", "view")))


# ---- DuckDB generators ------------------------------------------------------------

def _long_sql(src: str, side: str, group: str) -> str:
    g = f"{group}, " if group else ""
    return " UNION ALL ".join(
        f"SELECT {g}{i} AS fi, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, '{side}' AS side FROM {src} WHERE {f} IS NOT NULL"
        for i, f in enumerate(FEATURES))


def psi_sql(base: str, cur: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gk = f"r.{group} = s.{group} AND " if group else ""
    return f"""
    WITH rws AS ({_long_sql(base, 'b', group)} UNION ALL {_long_sql(cur, 'c', group)}),
    st AS (SELECT {g}fi, feature, min(value) AS mn, max(value) AS mx,
                  COUNT(*) FILTER (WHERE side = 'b') AS nb, COUNT(*) FILTER (WHERE side = 'c') AS nc
           FROM rws GROUP BY ALL),
    cnt AS (SELECT {", ".join(f"r.{c}" for c in ([group] if group else []) + ["fi", "feature"])},
                   CAST(least(floor((r.value - s.mn) / ((s.mx - s.mn) / 10)), 9) AS INTEGER) AS bin,
                   COUNT(*) FILTER (WHERE side = 'b') AS cb, COUNT(*) FILTER (WHERE side = 'c') AS cc
            FROM rws r JOIN st s ON {gk}r.fi = s.fi GROUP BY ALL),
    grid AS (SELECT st.*, unnest(range(10)) AS bin FROM st),
    t AS (SELECT {", ".join(f"gr.{c}" for c in ([group] if group else []) + ["fi", "feature", "nb", "nc", "mn", "mx"])},
                 (COALESCE(cc, 0) / nc + 1e-6 - (COALESCE(cb, 0) / nb + 1e-6))
                 * ln((COALESCE(cc, 0) / nc + 1e-6) / (COALESCE(cb, 0) / nb + 1e-6)) AS term
          FROM grid gr LEFT JOIN cnt c ON {"gr." + group + " = c." + group + " AND " if group else ""}gr.fi = c.fi AND gr.bin = c.bin)
    SELECT {g}fi, feature,
           round(CASE WHEN max(nb) = 0 OR max(nc) = 0 OR max(mx) = max(mn) THEN 0.0 ELSE SUM(term) END, 9) AS psi
    FROM t GROUP BY ALL"""


def ks_sql(base: str, cur: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    pg = f"PARTITION BY {group} " if group else ""
    return f"""
    WITH pv AS (SELECT {g}v, SUM(ib) AS nb_v, SUM(ic) AS nc_v FROM (
                  SELECT {g}CAST(value AS DOUBLE) AS v, 1 AS ib, 0 AS ic FROM {base} WHERE value IS NOT NULL
                  UNION ALL SELECT {g}CAST(value AS DOUBLE), 0, 1 FROM {cur} WHERE value IS NOT NULL) GROUP BY ALL),
    c AS (SELECT {g}SUM(nb_v) OVER ({pg}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cb,
                 SUM(nc_v) OVER ({pg}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cc,
                 SUM(nb_v) OVER ({pg.strip()}) AS nb, SUM(nc_v) OVER ({pg.strip()}) AS nc FROM pv)
    SELECT {g}round(COALESCE(max(CASE WHEN nb > 0 AND nc > 0 THEN abs(cb / nb - cc / nc) END), 0.0), 9) AS ks
    FROM c {"GROUP BY " + group if group else ""}"""


METRIC_BASE_SQL = ("(SELECT COUNT(*) FILTER (WHERE event_type = 'purchase') / "
                   "COUNT(*) FILTER (WHERE event_type IN ('click', 'view')) FROM {src})")


def report_sql(psi: str, ks: str, metrics: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    on = f"USING ({group})" if group else "ON true"
    return f"""
    WITH p AS ({psi}), k AS ({ks}), m AS ({metrics}),
    f AS (SELECT {g}avg(psi) AS fds,
                 list(printf('Feature ''%s'' PSI=%.3f exceeds threshold', feature, psi) ORDER BY fi)
                   FILTER (WHERE psi > 0.2) AS fr
          FROM p {"GROUP BY " + group if group else ""}),
    j AS (SELECT *, CASE WHEN metric_baseline > 0 THEN (metric_baseline - metric_current) / metric_baseline ELSE 0.0 END AS decay
          FROM f JOIN k {on} JOIN m {on})
    SELECT {g}round(fds, 9) AS feature_drift_score, ks AS prediction_drift_score, metric_baseline, metric_current,
           round(decay, 9) AS relative_decay, rs AS reasons, len(rs) > 0 AS needs_retraining
    FROM (SELECT *, list_concat(COALESCE(fr, []), list_filter([
             CASE WHEN ks > 0.05 THEN printf('Prediction drift KS=%.3f exceeds threshold', ks) END,
             CASE WHEN decay > 0.1 THEN printf('Business metric decayed %.1f%% (from %.4f to %.4f)', decay * 100, metric_baseline, metric_current) END],
             lambda x: x IS NOT NULL)) AS rs FROM j)"""


# ---- global checks ------------------------------------------------------------------

@query("r1_psi", sql=with_views("SELECT * FROM (" + psi_sql("drift_base", "drift_cur") + ")", *BASE_VIEWS))
def q_r1(spark, sf):
    b, c = V.drift_pair(Tables(spark, sf))
    return D.psi(b, c, FEATURES)


@query("r2_ks_two_sample", sql=with_views("SELECT * FROM (" + ks_sql("drift_base", "drift_cur") + ")", *BASE_VIEWS))
def q_r2(spark, sf):
    b, c = V.drift_pair(Tables(spark, sf))
    return D.ks_two_sample(b, c, "value")


GLOBAL_METRICS_SQL = (f"SELECT {METRIC_BASE_SQL.format(src='drift_base_e')} AS metric_baseline, "
                      f"{METRIC_BASE_SQL.format(src='drift_cur_e')} AS metric_current")
_EV = {"drift_base_e": f"SELECT * FROM events WHERE ts < TIMESTAMP '{DRIFT_SPLIT}'",
       "drift_cur_e": f"SELECT * FROM events WHERE ts >= TIMESTAMP '{DRIFT_SPLIT}'"}


def _global_metrics(spark, sf):
    e = Tables(spark, sf).events
    split = F.lit(DRIFT_SPLIT).cast("timestamp_ntz")
    return e.agg(
        (F.count_if((F.col("ts") < split) & (F.col("event_type") == "purchase"))
         / F.count_if((F.col("ts") < split) & F.col("event_type").isin("click", "view"))).alias("metric_baseline"),
        (F.count_if((F.col("ts") >= split) & (F.col("event_type") == "purchase"))
         / F.count_if((F.col("ts") >= split) & F.col("event_type").isin("click", "view"))).alias("metric_current"))


@query("r4_drift_report", sql=with_views(
    "SELECT * FROM (" + report_sql(psi_sql("drift_base", "drift_cur"), ks_sql("drift_base", "drift_cur"),
                                   GLOBAL_METRICS_SQL) + ")",
    *BASE_VIEWS, "drift_base_e", "drift_cur_e", extra=_EV))
def q_r4(spark, sf):
    b, c = V.drift_pair(Tables(spark, sf))
    return D.drift_report(D.psi(b, c, FEATURES), D.ks_two_sample(b, c, "value"), _global_metrics(spark, sf))


@query("j10_paired_features", sql=with_views(f"""
    SELECT feature, true AS in_baseline, true AS in_current, psi FROM ({psi_sql("drift_base", "drift_cur")})
    UNION ALL SELECT 'weekday', true, false, NULL UNION ALL SELECT 'minute', false, true, NULL""", *BASE_VIEWS))
def q_j10(spark, sf):
    """Feature sets that differ: weekday only before, minute only now."""
    b, c = V.drift_pair(Tables(spark, sf))
    return D.paired_psi(b.withColumn("weekday", F.weekday("ts")), c.withColumn("minute", F.minute("ts")), exclude=["event_id"])


# ---- per-day signals ------------------------------------------------------------------

def _day_metrics(spark, sf):
    """One row per current day: its conversion, that of the baseline, events."""
    ev = Tables(spark, sf).events.withColumn("day", F.to_date("ts"))
    split = F.lit(DRIFT_SPLIT).cast("timestamp_ntz")
    base_metric = ev.where(F.col("ts") < split).agg(conversion(ev)).scalar()
    return (ev.where(F.col("ts") >= split).groupBy("day")
            .agg(conversion(ev).alias("metric_current"), F.count(F.lit(1)).alias("n_events"))
            .withColumn("metric_baseline", base_metric))


def daily_signals(spark, sf):
    """One row per current day: drift report vs the whole baseline window,
    days since training and cumulative new interactions."""
    b, c = V.drift_pair(Tables(spark, sf))
    c = c.withColumn("day", F.to_date("ts"))
    psi_d = D.psi(b, c, FEATURES, group=["day"])
    ks_d = D.ks_two_sample(b, c, "value", group=["day"])
    cur_m = _day_metrics(spark, sf)
    rep = D.drift_report(psi_d, ks_d, cur_m.select("day", "metric_baseline", "metric_current"), ["day"])
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)   # one row per day
    vol = cur_m.select("day", F.sum("n_events").over(w).alias("new_interactions"))
    return (rep.join(vol, "day")
            .withColumn("days_since_training", F.datediff("day", F.lit(TRAINED_ON).cast("date"))))


DAY_SQL = {
    "cur_d": f"SELECT *, CAST(ts AS DATE) AS day FROM drift_cur",
    "base_d": "SELECT b.*, d.day FROM drift_base b JOIN (SELECT DISTINCT day FROM cur_d) d ON true",
    "ev_d": "SELECT *, CAST(ts AS DATE) AS day FROM events",
}
DAY_METRICS_SQL = f"""
    SELECT day, {METRIC_BASE_SQL.format(src='drift_base_e')} AS metric_baseline,
           COUNT(*) FILTER (WHERE event_type = 'purchase') / COUNT(*) FILTER (WHERE event_type IN ('click', 'view')) AS metric_current
    FROM ev_d WHERE ts >= TIMESTAMP '{DRIFT_SPLIT}' GROUP BY day"""
SIGNALS_SQL = f"""
    SELECT r.*, v.new_interactions, CAST(r.day - DATE '{TRAINED_ON}' AS INTEGER) AS days_since_training
    FROM ({report_sql(psi_sql('base_d', 'cur_d', 'day'), ks_sql('base_d', 'cur_d', 'day'), DAY_METRICS_SQL, 'day')}) r
    JOIN (SELECT day, CAST(SUM(COUNT(*)) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS new_interactions
          FROM ev_d WHERE ts >= TIMESTAMP '{DRIFT_SPLIT}' GROUP BY day) v USING (day)"""
_DAY_X = dict(_EV, **DAY_SQL, signals=SIGNALS_SQL)
_DAY_V = (*BASE_VIEWS, "drift_base_e", "drift_cur_e", "cur_d", "base_d", "ev_d", "signals")

DECISION_SQL = """
    SELECT *, p4 IN ('critical', 'high', 'normal') AND enough AS should_retrain,
           p4 IN ('critical', 'high', 'normal') AND NOT enough AS blocked_by_volume, p4 AS priority,
           list_concat(
             CASE WHEN crit THEN [printf('Critical business metric decay: %.1f%% (threshold: %.0f%%)', relative_decay * 100, 20.0)] ELSE [] END,
             CASE WHEN needs_retraining THEN reasons ELSE [] END,
             list_filter([CASE WHEN days_since_training >= 14 THEN printf('Model stale: %d days since last training (max: %d)', days_since_training, 14) END,
                          CASE WHEN NOT enough AND p3 <> 'critical' THEN printf('Insufficient new data: %d/%d interactions (waiting for more data)', new_interactions, 10000) END],
                         lambda x: x IS NOT NULL)) AS trigger_reasons
    FROM (SELECT *, CASE WHEN NOT enough AND p3 IN ('normal', 'skip') THEN 'skip' ELSE p3 END AS p4 FROM (
      SELECT *, CASE WHEN days_since_training >= 14 AND p2 = 'skip' THEN 'normal' ELSE p2 END AS p3 FROM (
        SELECT *, CASE WHEN needs_retraining AND p1 <> 'critical'
                       THEN (CASE WHEN days_since_training > 7 THEN 'high' ELSE 'normal' END) ELSE p1 END AS p2 FROM (
          SELECT *, CASE WHEN crit THEN 'critical' ELSE 'skip' END AS p1, new_interactions >= 10000 AS enough FROM (
            SELECT *, metric_baseline > 0 AND relative_decay > 0.2 AS crit FROM signals)))))"""


@query("r4_daily_signals", sql=with_views("SELECT * FROM signals", *_DAY_V, extra=_DAY_X))
def q_signals(spark, sf):
    return daily_signals(spark, sf)


@query("r3_metric_decay", sql=with_views("SELECT day, relative_decay FROM signals", *_DAY_V, extra=_DAY_X))
def q_r3(spark, sf):
    s = _day_metrics(spark, sf)
    return s.select("day", F.round(D.metric_decay(F.col("metric_baseline"), F.col("metric_current")), 9)
                    .alias("relative_decay"))


@query("r5_retrain_decision", sql=with_views("""
    SELECT day, priority, should_retrain, blocked_by_volume, trigger_reasons FROM (""" + DECISION_SQL + ")",
    *_DAY_V, extra=_DAY_X))
def q_r5(spark, sf):
    return D.retrain_decision(daily_signals(spark, sf)).select(
        "day", "priority", "should_retrain", "blocked_by_volume", "trigger_reasons")


@query("r6_retrain_config", sql=with_views("""
    SELECT day, priority,
           CASE WHEN priority = 'critical' THEN 15 WHEN priority = 'high' THEN 10 ELSE 5 END AS epochs,
           CASE WHEN priority = 'critical' THEN 5e-4 ELSE 1e-3 END AS learning_rate,
           CASE WHEN priority IN ('critical', 'high') THEN 512 ELSE 256 END AS batch_size,
           CASE WHEN priority = 'critical' THEN 500 WHEN priority = 'high' THEN 200 ELSE 100 END AS warmup_steps,
           priority IN ('critical', 'high') AS use_full_dataset, priority IN ('critical', 'high') AS run_extended_eval
    FROM (""" + DECISION_SQL + ")", *_DAY_V, extra=_DAY_X))
def q_r6(spark, sf):
    d = D.retrain_config(D.retrain_decision(daily_signals(spark, sf)))
    return d.select("day", "priority", "epochs", "learning_rate", "batch_size", "warmup_steps",
                    "use_full_dataset", "run_extended_eval")


@query("r7_retrain_short", sql=with_views("""
    SELECT day, CASE WHEN needs_retraining THEN 'trigger_immediate_retrain'
                     WHEN days_since_training >= 14 THEN 'trigger_scheduled_retrain'
                     ELSE 'no_retrain_needed' END AS decision FROM signals""", *_DAY_V, extra=_DAY_X))
def q_r7(spark, sf):
    return D.retrain_short(daily_signals(spark, sf)).select("day", "decision")


@query("s8_audit_sink", sql=with_views("""
    SELECT day, priority, should_retrain, blocked_by_volume, trigger_reasons FROM (""" + DECISION_SQL + ")",
    *_DAY_V, extra=_DAY_X))
def q_s8(spark, sf):
    """Daily retraining decisions appended to the JSON audit sink, read back
    with their own schema (the audit timestamp column is dropped)."""
    import uuid
    from tessera.session import checkpoint_dir
    from tessera.sources.files import write_audit
    dec = D.retrain_decision(daily_signals(spark, sf)).select(
        "day", "priority", "should_retrain", "blocked_by_volume", "trigger_reasons")
    path = f"{checkpoint_dir(spark).rstrip('/')}/audit/retrain-{uuid.uuid4().hex}"
    write_audit(dec, path)
    return spark.read.schema(dec.schema).json(path)
