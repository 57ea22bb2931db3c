"""Models, forecasts and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.operators import evaluation as EV
from tessera.operators import features as FE
from tessera.operators import forecast as FC
from tessera.operators import models as MD
from tessera.plans.catalog import memo, query
from tessera.plans.q_marts import M1_SQL, TYPE_SERIES_SQL, q_m1, q_m2, type_series
from tessera.session import materialize
from tessera.sources import Tables
from tessera.sources.views import with_views

CHURN_COLS = ["order_count", "total_spend", "avg_order_value", "days_since_last_purchase",
              "support_tickets", "avg_review_rating", "discount_code_usage_ratio",
              "session_count_30d", "avg_session_duration_s"]
RFM_COLS = ["recency", "frequency", "monetary", "avg_basket_size", "category_breadth"]
SCALE_COLS = ["avg_review_rating", "avg_session_duration_s", "total_spend"]
RULE_DAYS = 90          # transparent churn rule: no purchase for more than 90 days


# ---- M4 / M5 ----------------------------------------------------------------------

@query("m4_stratified_split", sql=f"""
    SELECT customer_id, churned,
           CASE WHEN row_number() OVER (PARTITION BY churned ORDER BY h, customer_id) - 1
                     < floor(COUNT(*) OVER (PARTITION BY churned) * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT customer_id, churned, ((customer_id % 2147483648) * 2654435761 + 42) % 4294967296 AS h FROM ({M1_SQL}))""")
def q_m4(spark, sf):
    return MD.stratified_split(q_m1(spark, sf).select("customer_id", "churned"), "customer_id", "churned")


@query("m5_impute_scale", sql=f"""
    WITH f AS ({M1_SQL}),
    m AS (SELECT {", ".join(f"median({c}) AS med_{c}" for c in SCALE_COLS)} FROM f),
    i AS (SELECT customer_id, {", ".join(f"COALESCE(CAST({c} AS DOUBLE), m.med_{c}) AS {c}" for c in SCALE_COLS)} FROM f, m),
    s AS (SELECT {", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in SCALE_COLS)} FROM i)
    SELECT customer_id, {", ".join(f"{c}, round(CASE WHEN sd_{c} > 0 THEN ({c} - mu_{c}) / sd_{c} ELSE 0 END, 9) AS {c}_z" for c in SCALE_COLS)}
    FROM i, s""")
def q_m5(spark, sf):
    return EV.impute_scale(q_m1(spark, sf).select("customer_id", *SCALE_COLS), SCALE_COLS) \
             .select("customer_id", *[x for c in SCALE_COLS for x in (c, f"{c}_z")])


# ---- M7 / M8 on the transparent churn rule --------------------------------------------

@query("m7_binary_metrics", sql=f"""
    SELECT (tp + tn) / (tp + fp + fn + tn) AS accuracy, precision, recall,
           CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1,
           tp, fp, fn, tn
    FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
                    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall
          FROM (SELECT COUNT(*) FILTER (WHERE churned = 1 AND p = 1) AS tp, COUNT(*) FILTER (WHERE churned <> 1 AND p = 1) AS fp,
                       COUNT(*) FILTER (WHERE churned = 1 AND p <> 1) AS fn, COUNT(*) FILTER (WHERE churned <> 1 AND p <> 1) AS tn
                FROM (SELECT churned, CASE WHEN days_since_last_purchase > {RULE_DAYS} THEN 1 ELSE 0 END AS p FROM ({M1_SQL}))))""")
def q_m7(spark, sf):
    f = q_m1(spark, sf).withColumn("prediction", (F.col("days_since_last_purchase") > RULE_DAYS).cast("int"))
    return EV.binary_metrics(f, "churned", "prediction")


AUC_SQL = f"""
    SELECT round(SUM(pos * (below + neg * 0.5)) / (max(P) * max(N)), 9) AS auc FROM (
      SELECT s, pos, neg, SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below0,
             COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
             SUM(pos) OVER () AS P, SUM(neg) OVER () AS N
      FROM (SELECT CAST(days_since_last_purchase AS DOUBLE) AS s, COUNT(*) FILTER (WHERE churned = 1) AS pos,
                   COUNT(*) FILTER (WHERE churned <> 1) AS neg FROM ({M1_SQL}) GROUP BY 1))"""


@query("m8_auc", sql=AUC_SQL)
def q_m8(spark, sf):
    return EV.auc(q_m1(spark, sf), "days_since_last_purchase", "churned")


# ---- M6 / K5: boosted trees (rows-only) -----------------------------------------------

@memo
def _churn_model(spark, sf):
    f = q_m1(spark, sf)
    split = MD.stratified_split(f, "customer_id", "churned")
    filled = EV.impute_scale(split, ["avg_review_rating", "avg_session_duration_s"])  # median impute (D11)
    filled = FE.fill_default(filled, CHURN_COLS, 0)
    train, test = filled.where(F.col("split") == "train"), filled.where(F.col("split") == "test")
    model = MD.fit_churn(train, CHURN_COLS)
    return model, MD.churn_scores(model, test)


@query("m6_churn_gbt_metrics")
def q_m6(spark, sf):
    """Held-out accuracy / precision / recall / F1 / AUC of the GBT model."""
    _, pred = _churn_model(spark, sf)
    m = EV.binary_metrics(pred.withColumn("prediction", F.col("prediction").cast("int")), "churned", "prediction")
    return m.withColumn("auc", EV.auc(pred, "p_churn", "churned").scalar())


@query("k5_top_importances")
def q_k5(spark, sf):
    model, _ = _churn_model(spark, sf)
    return MD.top_importances(model, CHURN_COLS, 5)


# ---- M9 / M12 (W5, J3, A7): segmentation ----------------------------------------------

@memo
def _segment_model(spark, sf):
    rfm = materialize(FE.fill_default(q_m2(spark, sf), RFM_COLS, 0))       # for the scaler, the fits and the names
    return (rfm, *MD.fit_segments(rfm, RFM_COLS, k=5, restarts=10))


@memo
def _segments(spark, sf):
    rfm, model, scaler, data = _segment_model(spark, sf)
    names = MD.name_segments(model, scaler, RFM_COLS)
    return MD.attach_segment(rfm, model, data, names, "customer_id"), names


def _scaled_segments(spark, sf):
    """customer_id, cluster and the scaled features that k-means saw."""
    from pyspark.ml.functions import vector_to_array
    _, model, _, data = _segment_model(spark, sf)
    got = model.transform(data).withColumn("scaled", vector_to_array(model.getFeaturesCol()))
    return got.select("customer_id", F.col(model.getPredictionCol()).cast("string").alias("cluster"), "scaled")


@query("m9_kmeans_segments")
def q_m9(spark, sf):
    labelled, _ = _segments(spark, sf)
    return labelled.groupBy("cluster", "segment").agg(F.count(F.lit(1)).alias("customers"))


@query("m12_segment_stats")
def q_m12(spark, sf):
    labelled, _ = _segments(spark, sf)
    return MD.segment_stats(labelled)


# ---- M10 / M11 on labelled vectors --------------------------------------------------------

def _vecs(spark, sf):
    return Tables(spark, sf).embeddings.select("vec_id", "embedding", "label")


DV = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("m10_silhouette", sql=f"""
    WITH v AS (SELECT vec_id, label, {DV} AS e FROM embeddings),
    d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, sqrt(greatest(list_dot_product(a.e, a.e) + list_dot_product(b.e, b.e)
                 - 2 * list_dot_product(a.e, b.e), 0)) AS dist
          FROM v a, v b),
    per AS (SELECT i, li, lj, SUM(dist) AS s, COUNT(*) AS n FROM d GROUP BY ALL),
    ab AS (SELECT i, max(CASE WHEN li = lj THEN CASE WHEN n > 1 THEN s / (n - 1) END END) AS a,
                  min(CASE WHEN li <> lj THEN s / n END) AS b,
                  max(CASE WHEN li = lj THEN n END) AS own_n FROM per GROUP BY i)
    SELECT round(avg(CASE WHEN own_n <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab""")
def q_m10(spark, sf):
    return EV.silhouette(_vecs(spark, sf), "vec_id", "embedding", "label")


@query("m11_davies_bouldin", sql=f"""
    WITH v AS (SELECT vec_id, label, {DV} AS e FROM embeddings),
    ex AS (SELECT label, unnest(range(len(e))) AS d, unnest(e) AS x FROM v),
    c AS (SELECT label, list(m ORDER BY d) AS cen FROM (SELECT label, d, avg(x) AS m FROM ex GROUP BY ALL) GROUP BY label),
    sp AS (SELECT v.label, avg(sqrt(list_sum(list_transform(list_zip(v.e, c.cen), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS S
           FROM v JOIN c USING (label) GROUP BY v.label),
    cs AS (SELECT c.label, c.cen, sp.S FROM c JOIN sp USING (label))
    SELECT round(avg(R), 6) AS davies_bouldin FROM (
      SELECT a.label, max((a.S + b.S) / sqrt(list_sum(list_transform(list_zip(a.cen, b.cen), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))) AS R
      FROM cs a, cs b WHERE a.label <> b.label GROUP BY a.label)""")
def q_m11(spark, sf):
    return EV.davies_bouldin(_vecs(spark, sf), "embedding", "label")


# ---- forecasts (M13 / M14 / M15 / A9) --------------------------------------------------------

DENSE_SQL = """
    SELECT c.product_type, CAST(c.t_dat AS DATE) AS t_dat, COALESCE(s.units, 0) AS units
    FROM (SELECT product_type, unnest(generate_series(min(t_dat), max(t_dat), INTERVAL 1 DAY)) AS t_dat
          FROM type_series GROUP BY product_type) c
    LEFT JOIN type_series s ON c.product_type = s.product_type AND CAST(c.t_dat AS DATE) = s.t_dat"""
_TS = {"type_series": TYPE_SERIES_SQL, "dense": DENSE_SQL}
_TSV = ("transactions", "articles", "type_series", "dense")


def dense_series(spark, sf):
    return FE.densify_days(type_series(spark, sf), "product_type", "t_dat", ["units"])


@query("m13_naive_forecast", sql=with_views("""
    SELECT product_type, step, CAST(last_d + step * INTERVAL 1 DAY AS DATE) AS date,
           round(mean, 6) AS forecast, round(mean * 0.85, 6) AS lower, round(mean * 1.15, 6) AS upper, training_days
    FROM (SELECT product_type, CAST(SUM(units) FILTER (WHERE rn <= 7) AS DOUBLE) / COUNT(*) FILTER (WHERE rn <= 7) AS mean,
                 COUNT(*) AS training_days, max(t_dat) AS last_d
          FROM (SELECT *, row_number() OVER (PARTITION BY product_type ORDER BY t_dat DESC) AS rn FROM type_series)
          GROUP BY product_type HAVING COUNT(*) >= 14), range(1, 31) r(step)""",
    "transactions", "articles", "type_series", extra=_TS))
def q_m13(spark, sf):
    return FC.naive_forecast(type_series(spark, sf), "product_type", "t_dat", "units", 30)


FIT = {
    "s0": """SELECT d.*, CAST(d.t_dat - m.d0 AS DOUBLE) AS t, m.d0 FROM dense d
             JOIN (SELECT product_type, min(t_dat) AS d0 FROM dense GROUP BY 1) m USING (product_type)""",
    "lin": """SELECT product_type, regr_slope(units, t) AS slope, regr_intercept(units, t) AS icpt,
                     COUNT(*) AS training_days, max(t_dat) AS last_d, min(d0) AS d0 FROM s0 GROUP BY 1""",
    "s1": """SELECT s0.*, lin.slope, lin.icpt, CAST(isodow(s0.t_dat) - 1 AS INTEGER) AS wd,
                    lin.icpt + lin.slope * s0.t AS trend FROM s0 JOIN lin USING (product_type)""",
    "wk": "SELECT product_type, wd, avg(units - trend) AS wd_eff FROM s1 GROUP BY 1, 2",
    "s2": "SELECT s1.*, trend + wk.wd_eff AS fitted FROM s1 JOIN wk USING (product_type, wd)",
    "sd": "SELECT product_type, stddev_pop(units - fitted) AS resid_sd FROM s2 GROUP BY 1",
}
_FX = dict(_TS, **FIT)
_FV = (*_TSV, "s0", "lin", "s1", "wk", "s2", "sd")


@query("m14_trend_forecast", sql=with_views("""
    SELECT f.product_type, f.step, f.date, round(f.fc, 6) AS forecast, round(f.fc - 1.96 * f.resid_sd, 6) AS lower,
           round(f.fc + 1.96 * f.resid_sd, 6) AS upper, f.training_days
    FROM (SELECT l.product_type, r.step, CAST(l.last_d + r.step * INTERVAL 1 DAY AS DATE) AS date, l.training_days, sd.resid_sd,
                 l.icpt + l.slope * CAST(CAST(l.last_d + r.step * INTERVAL 1 DAY AS DATE) - l.d0 AS DOUBLE)
                 + COALESCE(wk.wd_eff, 0) AS fc
          FROM lin l JOIN sd USING (product_type) CROSS JOIN range(1, 31) r(step)
          LEFT JOIN wk ON wk.product_type = l.product_type
                      AND wk.wd = CAST(isodow(CAST(l.last_d + r.step * INTERVAL 1 DAY AS DATE)) - 1 AS INTEGER)
          WHERE l.training_days >= 14) f""", *_FV, extra=_FX))
def q_m14(spark, sf):
    return FC.trend_forecast(dense_series(spark, sf), "product_type", "t_dat", "units", 30)


MAPE_SQL = """
    SELECT s2.product_type, round(avg(CASE WHEN units > 0 THEN abs((units - fitted) / units) END) * 100, 2) AS mape_pct,
           COUNT(*) AS training_days
    FROM s2 JOIN lin USING (product_type) WHERE lin.training_days >= 14 GROUP BY s2.product_type"""


@query("m15_mape", sql=with_views(MAPE_SQL, *_FV, extra=_FX))
def q_m15(spark, sf):
    return FC.mape(dense_series(spark, sf), "product_type", "t_dat", "units")


@query("a9_mean_mape", sql=with_views("SELECT round(avg(mape_pct), 6) AS avg_mape_pct FROM (" + MAPE_SQL + ")",
                                       *_FV, extra=_FX))
def q_a9(spark, sf):
    return FC.mape(dense_series(spark, sf), "product_type", "t_dat", "units") \
             .agg(F.round(F.avg("mape_pct"), 6).alias("avg_mape_pct"))   # mean over series (A9)


# ---- M16: quality gates ---------------------------------------------------------------------

def _metric_table(spark, sf):
    m7 = q_m7(spark, sf).select(F.lit("churn_f1").alias("metric"), F.col("f1").alias("value"))
    m8 = q_m8(spark, sf).select(F.lit("churn_auc_roc").alias("metric"), F.col("auc").alias("value"))
    m10 = q_m10(spark, sf).select(F.lit("segmentation_silhouette").alias("metric"), F.col("silhouette").alias("value"))
    a9 = q_a9(spark, sf).select(F.lit("demand_mape").alias("metric"), F.col("avg_mape_pct").alias("value"))
    return m7.unionByName(m8).unionByName(m10).unionByName(a9)


def _m16_sql() -> str:
    from tessera.plans.catalog import REGISTRY
    sql = {n: REGISTRY[n].sql for n in ("m7_binary_metrics", "m8_auc", "m10_silhouette", "a9_mean_mape")}
    gates = ", ".join(f"('{n}', '{op}', CAST({float(t)} AS DOUBLE))" for n, op, t in L.QUALITY_GATES)
    return f"""
    WITH m AS (SELECT 'churn_f1' AS metric, f1 AS value FROM ({sql['m7_binary_metrics']})
               UNION ALL SELECT 'churn_auc_roc', auc FROM ({sql['m8_auc']})
               UNION ALL SELECT 'segmentation_silhouette', silhouette FROM ({sql['m10_silhouette']})
               UNION ALL SELECT 'demand_mape', avg_mape_pct FROM ({sql['a9_mean_mape']})),
    j AS (SELECT g.gate, g.op, g.threshold, m.value,
                 COALESCE(CASE WHEN g.op = '>=' THEN m.value >= g.threshold ELSE m.value <= g.threshold END, false) AS passed
          FROM (VALUES {gates}) g(gate, op, threshold) LEFT JOIN m ON m.metric = g.gate)
    SELECT *, CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status,
           CASE WHEN (SELECT bool_and(passed) FROM j) THEN 'PROMOTE' ELSE 'HOLD' END AS recommendation
    FROM j"""


@query("m16_quality_report", sql=_m16_sql())
def q_m16(spark, sf):
    """Gate table over the rule-based churn metrics, vector silhouette and
    mean MAPE, with the PROMOTE / HOLD decision."""
    return EV.quality_report(_metric_table(spark, sf))


@query("m16_model_status", sql=f"""
    SELECT o.model, CASE WHEN bool_and(r.passed) THEN 'PASS' ELSE 'FAIL' END AS status, COUNT(*) AS n_gates,
           list_sort(coalesce(list(r.gate) FILTER (WHERE NOT r.passed), [])) AS failed_gates, any_value(r.recommendation) AS recommendation
    FROM (VALUES {", ".join(f"('{m}', '{g}')" for m, gs in EV.MODEL_GATES.items() for g in gs)}) o(model, gate)
    JOIN ({_m16_sql()}) r ON r.gate = o.gate GROUP BY o.model""")
def q_m16_status(spark, sf):
    """PASS / FAIL of each model from the gate table of ``m16_quality_report``."""
    return EV.model_status(EV.quality_report(_metric_table(spark, sf)))


@query("m16_trained_models")
def q_m16_trained(spark, sf):
    """Gates of the trained models themselves: boosted trees (M6), k-means
    segments by the silhouette of their scaled features (M9, M10), forecasts (A9)."""
    m6 = q_m6(spark, sf)
    scaled = _scaled_segments(spark, sf)
    metrics = (m6.select(F.lit("churn_f1").alias("metric"), F.col("f1").alias("value"))
               .unionByName(m6.select(F.lit("churn_auc_roc").alias("metric"), F.col("auc").alias("value")))
               .unionByName(EV.silhouette(scaled, "customer_id", "scaled", "cluster").select(
                   F.lit("segmentation_silhouette").alias("metric"), F.col("silhouette").alias("value")))
               .unionByName(q_a9(spark, sf).select(F.lit("demand_mape").alias("metric"), F.col("avg_mape_pct").alias("value"))))
    return EV.model_status(EV.quality_report(metrics))


# ---- P5: defaults in the training frame; F3: batch inference --------------------------------------

@query("p5_filled_features", sql=f"""
    SELECT customer_id, churned, {", ".join(f"CAST(COALESCE({c}, 0) AS DOUBLE) AS {c}" for c in CHURN_COLS)} FROM ({M1_SQL})""")
def q_p5(spark, sf):
    f = FE.fill_default(q_m1(spark, sf), CHURN_COLS, 0)
    return f.select("customer_id", "churned", *[F.col(c).cast("double").alias(c) for c in CHURN_COLS])


@query("f3_batch_scores", sql=f"""
    SELECT doc_id, n_words, CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 6) ELSE 0.0 END AS score
    FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(list_filter(w, lambda x: x IN {tuple(L.DRIVER_POSITIVE)})) AS p,
                 len(list_filter(w, lambda x: x IN {tuple(L.DRIVER_NEGATIVE)})) AS n
          FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents))""")
def q_f3(spark, sf):
    """A batch model (weights in the task's closure) over Arrow batches of all
    documents: share of positive less negative words, every occurrence counted."""
    import regex
    word = regex.compile(r"[\p{L}\p{N}_]+")
    weight = {**{w: 1 for w in L.DRIVER_POSITIVE}, **{w: -1 for w in L.DRIVER_NEGATIVE}}

    def model(pdf):
        import pandas as pd
        out = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            words = word.findall(text)
            hit = [weight[w] for w in words if w in weight]
            out.append((doc, len(words), round(sum(hit) / len(hit), 6) if hit else 0.0))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "score"])

    d = Tables(spark, sf).documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return MD.score_batches(d, model, "doc_id long, n_words long, score double")


# ---- M17 / M18 / T10: multi-label text model ------------------------------------------------------

def _tagged(spark, sf):
    t = Tables(spark, sf)
    lab = t.labels
    d = t.documents.join(lab, "doc_id")
    labels = F.filter(F.array(F.concat(F.lit("lang:"), F.col("lang")),
                              F.when(F.col("quality") == 1, F.lit("quality:1")),
                              F.when(F.col("toxic") == 1, F.lit("toxic:1"))), lambda x: x.isNotNull())
    return d.select("doc_id", "text", "lang", "n_chars", labels.alias("labels"))


LABEL_SET = ("lang:en", "lang:de", "lang:fr", "lang:es", "quality:1", "toxic:1")


@memo
def _multilabel(spark, sf):
    d = _tagged(spark, sf).withColumn("_h", MD.split_hash("doc_id"))
    train = d.where(F.col("_h") % 5 != 0)
    test = d.where(F.col("_h") % 5 == 0)
    cv, models = MD.fit_multilabel(train, "text", LABEL_SET)
    pred = MD.predict_multilabel(cv, models, test, "text", "doc_id")
    return pred.join(test.select("doc_id", "labels"), "doc_id")


@query("m17_multilabel_predictions")
def q_m17(spark, sf):
    p = _multilabel(spark, sf)
    predicted = F.map_keys(F.map_filter("probs", lambda k, v: v >= 0.35))
    return p.select("doc_id", "labels", F.array_sort(predicted).alias("predicted"))


@query("m18_micro_prf_model")
def q_m18_model(spark, sf):
    return EV.micro_prf(q_m17(spark, sf), "labels", "predicted")


@query("m18_micro_prf", sql="""
    WITH d AS (SELECT l.doc_id,
                      list_filter(['lang:' || lang, CASE WHEN quality = 1 THEN 'quality:1' END,
                                   CASE WHEN toxic = 1 THEN 'toxic:1' END], lambda x: x IS NOT NULL) AS truth,
                      list_filter(['lang:' || lang, CASE WHEN n_chars >= 1000 THEN 'quality:1' END], lambda x: x IS NOT NULL) AS pred
               FROM documents JOIN labels l USING (doc_id)),
    s AS (SELECT SUM(len(list_intersect(truth, pred))) AS tp,
                 SUM(len(list_filter(pred, lambda x: NOT list_contains(truth, x)))) AS fp,
                 SUM(len(list_filter(truth, lambda x: NOT list_contains(pred, x)))) AS fn FROM d)
    SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / (tp + fp + 1e-9) AS precision, tp / (tp + fn + 1e-9) AS recall,
           2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / ((tp / (tp + fp + 1e-9)) + (tp / (tp + fn + 1e-9)) + 1e-9) AS f1
    FROM s""")
def q_m18(spark, sf):
    """Micro P/R/F1 of a transparent rule (language tag + 'long text is
    quality') against the label table."""
    d = _tagged(spark, sf)
    pred = F.filter(F.array(F.concat(F.lit("lang:"), F.col("lang")),
                            F.when(F.col("n_chars") >= 1000, F.lit("quality:1"))), lambda x: x.isNotNull())
    return EV.micro_prf(d.withColumn("pred", pred), "labels", "pred")


_SCORES = {"sentiment:positive": "(doc_id * 37 + coalesce(quality, 0)) % 101", "sentiment:negative": "(doc_id * 53 + coalesce(toxic, 0)) % 97",
           "sentiment:mixed": "doc_id * 29 % 89", "aspect:delivery_time": "doc_id * 41 % 83", "aspect:price": "doc_id * 67 % 79"}


@query("t10_decode_labels", sql=f"""
    SELECT doc_id, label AS sentiment, round(CASE WHEN best < 0.35 THEN 1 - best ELSE best END, 3) AS confidence,
           CASE WHEN label <> 'NEGATIVE' THEN 'LOW' WHEN pn > 0.75 THEN 'CRITICAL' WHEN pn > 0.55 THEN 'HIGH' ELSE 'MEDIUM' END AS urgency,
           CASE WHEN pa >= 0.35 AND pb >= 0.35 THEN 'delivery time,price' WHEN pa >= 0.35 THEN 'delivery time'
                WHEN pb >= 0.35 THEN 'price' ELSE 'overall experience' END AS aspects
    FROM (SELECT *, greatest(pp, pn, pm) AS best,
                 CASE WHEN greatest(pp, pn, pm) < 0.35 THEN 'NEUTRAL' WHEN pp >= pn AND pp >= pm THEN 'POSITIVE'
                      WHEN pn >= pm THEN 'NEGATIVE' ELSE 'MIXED' END AS label
          FROM (SELECT doc_id, {", ".join(f"CAST(({e}) AS DOUBLE) / 100 AS {c}" for e, c in zip(_SCORES.values(), ("pp", "pn", "pm", "pa", "pb")))}
                FROM labels))""")
def q_t10(spark, sf):
    """Probabilities worked out from the labelled documents reach every branch."""
    probs = F.create_map(*[c for k, e in _SCORES.items() for c in (F.lit(k), F.expr(f"CAST(({e}) AS DOUBLE) / 100"))])
    d = Tables(spark, sf).labels.select("doc_id", MD.decode_labels(probs).alias("d"))
    return d.select("doc_id", "d.sentiment", "d.confidence", "d.urgency", F.array_join("d.aspects.aspect", ",").alias("aspects"))


@query("t10_decode_model")
def q_t10_model(spark, sf):
    p = _multilabel(spark, sf)
    dec = MD.decode_labels(F.col("probs"))
    return p.select("doc_id", dec["sentiment"].alias("sentiment"), dec["confidence"].alias("confidence"),
                    dec["urgency"].alias("urgency"), F.size(dec["aspects"]).alias("n_aspects"))
