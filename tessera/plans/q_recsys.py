"""Vector search and recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ann_index as ANN
from tessera.operators import recsys as R
from tessera.operators import text_ops as TO
from tessera.operators import vectors as VX
from tessera.plans.catalog import memo, query
from tessera.session import materialize
from tessera.sources import Tables
from tessera.sources import views as V
from tessera.sources.views import with_views
from tessera.streaming.jobs import scratch

K = 10


def vectors(spark, sf):
    return Tables(spark, sf).embeddings.select(F.col("vec_id").alias("item_id"),
                                               F.col("embedding").alias("vec"), "label")


def exemplars(spark, sf):
    """One query vector per label: the label's lowest vec_id."""
    v = vectors(spark, sf)
    ex = v.groupBy("label").agg(F.min("item_id").alias("query_id"))
    return ex.join(v.select(F.col("item_id").alias("query_id"), "vec"), "query_id")


# ---- W6 / V11 / V8 / V9 -------------------------------------------------------

@query("w6_temporal_split", sql=with_views("""
    SELECT event_id, position,
           CASE WHEN position < floor(n * 0.7) THEN 'train'
                WHEN position < floor(n * (0.7 + 0.15)) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position,
                 COUNT(*) OVER () AS n FROM user_items)""", "user_items"))
def q_w6(spark, sf):
    ui = V.user_items(Tables(spark, sf))
    return R.temporal_split(ui, "ts", "event_id").select("event_id", "position", "split")


WEIGHT_SQL = """
    SELECT user_id, item_id, SUM(w) AS weight, COUNT(*) AS n FROM (
      SELECT user_id, item_id, CASE interaction_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.5
                                   WHEN 'add_to_cart' THEN 2.0 WHEN 'purchase' THEN 3.0 END AS w
      FROM user_items) WHERE w IS NOT NULL GROUP BY user_id, item_id"""


@query("v11_implicit_weights", sql=with_views(
    "SELECT user_id, item_id, CAST(weight AS DOUBLE) AS weight, n FROM (" + WEIGHT_SQL + ")", "user_items"))
def q_v11(spark, sf):
    return R.implicit_weights(V.user_items(Tables(spark, sf)))


@query("v8_dense_ids", sql=with_views("""
    SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS user_id_idx
    FROM (SELECT DISTINCT user_id FROM user_items)""", "user_items"))
def q_v8(spark, sf):
    from tessera.operators.scale import dense_ids
    return dense_ids(V.user_items(Tables(spark, sf)), "user_id")


@query("v9_standardize", sql="""
    SELECT event_id, value,
           round((value - (SELECT CAST(avg(CAST(value AS DECIMAL(20,6))) AS DOUBLE) FROM events))
                 / (SELECT stddev_pop(value) FROM events), 9) AS value_z
    FROM events""")
def q_v9(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", "value")
    return R.standardize(ev, ["value"])


# ---- catalogue joins (J4 / J5 / V13) ------------------------------------------

SEARCH_SQL = """
    SELECT query_id, product_id, rank, round(score, 3) AS similarity_score FROM (
      SELECT query_id, product_id, score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank
      FROM (SELECT q.query_id, c.product_id, CAST(COUNT(*) AS DOUBLE) / greatest(max(q.n), 1) AS score
            FROM (SELECT query_id, len(ws) AS n, unnest(ws) AS w
                  FROM (SELECT item_id AS query_id,
                               list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws
                        FROM benchmark)) q
            JOIN (SELECT product_id, lower(search_text) AS st FROM catalog) c ON contains(c.st, q.w)
            GROUP BY q.query_id, c.product_id))
    WHERE rank <= 5"""


def search_hits(spark, sf):
    t = Tables(spark, sf)
    qs = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return TO.keyword_search(V.catalog(t), qs, k=5), qs


@query("v13_match_reasons", sql=with_views(
    "SELECT product_id, [category, tags[1], tags[2]] AS match_reasons FROM catalog", "catalog"))
def q_v13(spark, sf):
    c = V.catalog(Tables(spark, sf))
    return c.select("product_id", R.match_reasons(c).alias("match_reasons"))


@query("j4_hits_to_products", sql=with_views("""
    SELECT h.query_id, h.product_id, h.rank, h.similarity_score, c.name, c.category, c.price
    FROM search h JOIN catalog c ON h.product_id = c.product_id""", "catalog", "search",
    extra={"search": SEARCH_SQL}))
def q_j4(spark, sf):
    hits, _ = search_hits(spark, sf)
    c = V.catalog(Tables(spark, sf)).select("product_id", "name", "category", "price")
    return R.hits_to_products(hits, c)


@query("j5_with_explanations", sql=with_views("""
    SELECT h.query_id, h.product_id, h.rank,
           'Matches your interest in ''' || b.text || '''.' AS explanation,
           [c.category, c.tags[1], c.tags[2]] AS match_reasons
    FROM search h JOIN catalog c ON h.product_id = c.product_id JOIN benchmark b ON b.item_id = h.query_id""",
    "catalog", "search", extra={"search": SEARCH_SQL}))
def q_j5(spark, sf):
    hits, qs = search_hits(spark, sf)
    c = V.catalog(Tables(spark, sf)).select("product_id", "category", "tags")
    j = R.hits_to_products(hits, c).join(qs, "query_id")
    return R.with_explanations(j, None).select("query_id", "product_id", "rank", "explanation", "match_reasons")


@query("j5_given_explanations", sql=with_views("""
    SELECT h.query_id, h.product_id,
           CASE WHEN c.product_id % 3 = 0 THEN 'Made for ' || c.category ELSE 'Matches your interest in ''' || b.text || '''.' END AS explanation,
           CASE WHEN c.product_id % 6 = 0 THEN [c.category] ELSE [c.category, c.tags[1], c.tags[2]] END AS match_reasons
    FROM search h JOIN catalog c ON h.product_id = c.product_id JOIN benchmark b ON b.item_id = h.query_id""",
    "catalog", "search", extra={"search": SEARCH_SQL}))
def q_j5_given(spark, sf):
    """Explanations given for some products, reasons for fewer: defaults fill in."""
    hits, qs = search_hits(spark, sf)
    c = V.catalog(Tables(spark, sf)).select("product_id", "category", "tags")
    given = c.where("product_id % 3 = 0").select(
        "product_id", F.concat(F.lit("Made for "), "category").alias("explanation"),
        F.when(F.col("product_id") % 6 == 0, F.array("category")).alias("match_reasons"))
    j = R.hits_to_products(hits, c).join(qs, "query_id")
    return R.with_explanations(j, given).select("query_id", "product_id", "explanation", "match_reasons")


@query("t12_recommendation_prompt", sql=with_views("""
    SELECT query_id, 'Why do these suit ' || max(b.text) || '? ['
           || string_agg('{"product_id":' || CAST(c.product_id AS VARCHAR) || ',"name":"' || c.name || '","description":"' || c.description
                         || '","category":"' || c.category || '"}', ',' ORDER BY h.rank) || ']' AS prompt
    FROM search h JOIN catalog c ON h.product_id = c.product_id JOIN benchmark b ON b.item_id = h.query_id
    GROUP BY query_id""", "catalog", "search", extra={"search": SEARCH_SQL}))
def q_t12_recommendation(spark, sf):
    hits, qs = search_hits(spark, sf)
    c = V.catalog(Tables(spark, sf)).select("product_id", "name", "description", "category")
    j = TO.products_json(R.hits_to_products(hits, c)).join(qs, "query_id")
    return j.select("query_id", TO.fill_template("Why do these suit {query}? {products}", query=F.col("query"),
                                                 products=F.col("products_json")).alias("prompt"))


# ---- vector search (V2 / V3 / J7 / V4) -----------------------------------------

VEC_SQL = """
    WITH v AS (SELECT vec_id AS item_id, embedding AS vec, label FROM embeddings),
    ex AS (SELECT v.label, v.item_id AS query_id, v.vec FROM v
           JOIN (SELECT label, min(item_id) AS q FROM v GROUP BY label) m ON v.item_id = m.q),
    s AS (SELECT ex.query_id, ex.label AS qlabel, v.item_id, v.label,
                 round(list_dot_product(list_transform(ex.vec, lambda x: CAST(x AS DOUBLE)),
                                        list_transform(v.vec, lambda x: CAST(x AS DOUBLE)))
                       / (sqrt(list_dot_product(list_transform(ex.vec, lambda x: CAST(x AS DOUBLE)),
                                                list_transform(ex.vec, lambda x: CAST(x AS DOUBLE))))
                          * sqrt(list_dot_product(list_transform(v.vec, lambda x: CAST(x AS DOUBLE)),
                                                  list_transform(v.vec, lambda x: CAST(x AS DOUBLE))))), 6) AS similarity
          FROM ex, v {where})
    SELECT query_id, item_id, similarity, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM s)
    WHERE rank <= 10"""


@query("v2_cosine_topk", sql=VEC_SQL.format(where=""), bench=True)
def q_v2(spark, sf):
    return VX.cosine_topk(vectors(spark, sf), exemplars(spark, sf), K).select(
        "query_id", "item_id", "similarity", "rank")


@query("v3_filtered_topk", sql=VEC_SQL.format(where="WHERE ex.label = v.label"))
def q_v3(spark, sf):
    """Filtered search: each query only sees items with its own label
    (equi-join on the filter key), then the V2 ranking."""
    v, q = vectors(spark, sf), exemplars(spark, sf)
    j = q.select("query_id", F.col("vec").alias("qvec"), "label").join(v, "label")
    s = j.select("query_id", "item_id", F.round(VX.cosine("qvec", "vec"), 6).alias("similarity"))
    from pyspark.sql import Window
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("item_id"))
    return s.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= K)


@query("v3_customer_topk", sql=f"""
    WITH nv AS (SELECT COUNT(*) AS n FROM embeddings),
    it AS (SELECT e.user_id AS customer_id, e.event_id AS interaction_id, e.ts AS date,
                  list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)) AS vec
           FROM events e, nv JOIN embeddings v ON v.vec_id = e.event_id % nv.n),
    qs AS (SELECT c.customer_id, c.customer_id AS query_id,
                  CASE WHEN c.customer_id % 10 <> 0 THEN list_transform(v.embedding, lambda x: CAST(x AS DOUBLE)) END AS qvec
           FROM (SELECT DISTINCT user_id AS customer_id FROM events) c, nv JOIN embeddings v ON v.vec_id = c.customer_id % nv.n),
    s AS (SELECT query_id, customer_id, interaction_id, date,
                 round(list_dot_product(qvec, vec) / (sqrt(list_dot_product(qvec, qvec)) * sqrt(list_dot_product(vec, vec))), 6) AS similarity
          FROM qs JOIN it USING (customer_id)),
    top AS (SELECT * FROM s WHERE similarity IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, interaction_id) <= {K}),
    rest AS (SELECT * FROM s WHERE query_id NOT IN (SELECT query_id FROM top)
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY date DESC, interaction_id) <= {K})
    SELECT query_id, customer_id, interaction_id, date, similarity, matched,
           row_number() OVER (PARTITION BY query_id ORDER BY date DESC, similarity DESC NULLS LAST, interaction_id) AS rank
    FROM (SELECT *, true AS matched FROM top UNION ALL SELECT *, false FROM rest)""")
def q_v3_customer(spark, sf):
    """Each customer's ten nearest interactions, latest first; customers
    without a query vector (every tenth here) get their latest ten."""
    t = Tables(spark, sf)
    v = t.embeddings.select("vec_id", F.col("embedding").alias("vec"))
    n = v.agg(F.count(F.lit(1))).scalar()
    items = t.events.select(F.col("user_id").alias("customer_id"), F.col("event_id").alias("interaction_id"), F.col("ts").alias("date"),
                            (F.col("event_id") % n).alias("vec_id")).join(v, "vec_id").drop("vec_id")
    q = t.events.select(F.col("user_id").alias("customer_id")).distinct().withColumn("vec_id", F.col("customer_id") % n).join(v, "vec_id")
    q = q.select("customer_id", F.col("customer_id").alias("query_id"), F.when(F.col("customer_id") % 10 != 0, F.col("vec")).alias("vec"))
    return VX.keyed_topk(items, q, K, "customer_id", "date", "interaction_id", "vec", "query_id", "vec", fallback=K)


@query("j7_drop_excluded", sql=f"""
    SELECT query_id, item_id, similarity FROM ({VEC_SQL.format(where="")}) WHERE query_id <> item_id""")
def q_j7(spark, sf):
    top = q_v2(spark, sf)
    excluded = exemplars(spark, sf).select("query_id", F.col("query_id").alias("item_id"))
    return R.drop_excluded(top, excluded, ["query_id", "item_id"]).select("query_id", "item_id", "similarity")


@query("v4_ann_recall")
def q_v4(spark, sf):
    """Approximate top-10 from the stored index, its recall against the exact
    top-10 and the shares of items scored by code and compared exactly."""
    v, q = vectors(spark, sf), exemplars(spark, sf)
    index = ANN.build_index(v, scratch(spark, "v4"), "item_id", "vec", K)
    approx = materialize(ANN.search(index, q, K))
    exact = VX.cosine_topk(v, q, K)
    hit = exact.join(approx.select("query_id", "item_id"), ["query_id", "item_id"], "left_semi")
    work = approx.groupBy("query_id").agg(F.first("n_coded").alias("n_coded"), F.first("n_compared").alias("n_compared"))
    return (exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"))
            .join(hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_found")), "query_id", "left").join(work, "query_id", "left")
            .withColumn("n_items", v.agg(F.count(F.lit(1))).scalar())
            .fillna({"n_found": 0})
            .withColumn("recall", F.col("n_found") / F.col("n_exact")))


# ---- ranks and metrics on given vectors (W7 / V7) ---------------------------------

RANK_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings),
    ex AS (SELECT label, min(vec_id) AS target FROM v GROUP BY label),
    r AS (SELECT v.vec_id AS row_id, v.vec_id AS user_id, ex.target AS item_id, v.vec
          FROM v JOIN ex ON v.label = ex.label WHERE v.vec_id <> ex.target),
    ts AS (SELECT r.row_id, r.item_id, round(list_dot_product(r.vec, t.vec), 6) AS tscore, r.vec
           FROM r JOIN v t ON t.vec_id = r.item_id),
    ranks AS (SELECT ts.row_id, ts.item_id,
                     1 + COUNT(*) FILTER (WHERE round(list_dot_product(ts.vec, o.vec), 6) > ts.tscore
                                          OR (round(list_dot_product(ts.vec, o.vec), 6) = ts.tscore AND o.vec_id < ts.item_id)) AS rank
              FROM ts, v o GROUP BY ts.row_id, ts.item_id)"""


def vector_ranks(spark, sf):
    v = vectors(spark, sf)
    ex = v.groupBy("label").agg(F.min("item_id").alias("target"))
    rows = (v.join(ex, "label").where(F.col("item_id") != F.col("target"))
            .select(F.col("item_id").alias("row_id"), F.col("item_id").alias("user_id"),
                    F.col("target").alias("item_id")))
    users = v.select(F.col("item_id").alias("user_id"), F.col("vec").alias("features"))
    items = v.select("item_id", F.col("vec").alias("features"))
    return VX.target_rank(rows, users, items)


@query("w7_target_rank", sql=RANK_SQL + "\nSELECT row_id, item_id, rank FROM ranks")
def q_w7(spark, sf):
    return vector_ranks(spark, sf).select("row_id", "item_id", "rank")


@query("v7_rank_metrics", sql=RANK_SQL + """
    SELECT COUNT(*) AS n, round(avg(1.0 / rank), 9) AS mrr,
           round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate_at_10,
           round(avg(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0.0 END), 9) AS ndcg_at_10,
           round(avg(CASE WHEN rank <= 50 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate_at_50,
           round(avg(CASE WHEN rank <= 50 THEN 1.0 / log2(rank + 1) ELSE 0.0 END), 9) AS ndcg_at_50,
           round(avg(CASE WHEN rank <= 100 THEN 1.0 ELSE 0.0 END), 9) AS hit_rate_at_100,
           round(avg(CASE WHEN rank <= 100 THEN 1.0 / log2(rank + 1) ELSE 0.0 END), 9) AS ndcg_at_100
    FROM ranks""")
def q_v7(spark, sf):
    m = VX.rank_metrics(vector_ranks(spark, sf))
    return m.select("n", *[F.round(c, 9).alias(c) for c in m.columns if c != "n"])


# ---- factor model (V5 / V6 / V7 on the temporal split / V10 / V12) -----------------

@memo
def _als(spark, sf):
    """One factor-model fit per data folder, shared by V5 / V6 / V7 / V12."""
    train, test, w = _split_weights(spark, sf)
    return R.factor_frames(R.fit_factors(w, rank=64))


@memo
def _split_weights(spark, sf):
    """The split is stored once: the fit, the seen pairs, the held-out rows and
    both rankings read it instead of ordering the events again each time."""
    ui = V.user_items(Tables(spark, sf))
    split = materialize(R.temporal_split(ui, "ts", "event_id").select("event_id", "user_id", "item_id", "interaction_type", "split"))
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    return train, test, R.implicit_weights(train)


@query("v5_als_factors")
def q_v5(spark, sf):
    u, i = _als(spark, sf)
    return (u.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), F.size("features").alias("dims"))
            .unionByName(i.select(F.lit("item").alias("side"), F.col("item_id").alias("id"),
                                  F.size("features").alias("dims"))))


@query("v6_recommend_top10")
def q_v6(spark, sf):
    train, _, _ = _split_weights(spark, sf)
    u, i = _als(spark, sf)
    return R.recommend(u, i, K, seen=train.select("user_id", "item_id").distinct())


@query("v7_rank_metrics_als", bench=True)
def q_v7_als(spark, sf):
    """Held-out ranking quality of the factor model vs item popularity."""
    train, test, _ = _split_weights(spark, sf)
    u, i = _als(spark, sf)
    rows = test.select(F.col("event_id").alias("row_id"), "user_id", "item_id")
    als = VX.rank_metrics(VX.target_rank(rows, u, i)).withColumn("model", F.lit("als"))
    # popularity baseline through the same exact ranking path: 1-d vectors
    pop = train.groupBy("item_id").agg(F.array(F.count(F.lit(1)).cast("float")).alias("features"))
    ones = rows.select("user_id").distinct().withColumn("features", F.array(F.lit(1.0).cast("float")))
    base = VX.rank_metrics(VX.target_rank(rows, ones, pop)).withColumn("model", F.lit("popularity"))
    return als.unionByName(base)


@query("v10_negative_samples", sql=with_views(f"""
    SELECT * FROM (WITH ui AS (SELECT DISTINCT user_id, item_id FROM user_items),
    ix AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM ui)),
    n AS (SELECT count(*) AS total FROM ix),
    walk AS (SELECT user_id, item_id, total, ((user_id % total) * {R.START_USER} + (item_id % total) * {R.START_ITEM} + 42) % total AS start,
                    unnest(range(total)) AS j FROM ui, n),
    place AS (SELECT user_id, item_id, j, (start + j * ({R.WALK_STEP} % total)) % total AS i FROM walk),
    cand AS (SELECT p.user_id, p.item_id, ix.item_id AS neg_item, p.j FROM place p JOIN ix USING (i)
             WHERE NOT EXISTS (SELECT 1 FROM ui s WHERE s.user_id = p.user_id AND s.item_id = ix.item_id))
    SELECT user_id, item_id, neg_item FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY j) AS r FROM cand) WHERE r <= 4)""", "user_items"))
def q_v10(spark, sf):
    ui = V.user_items(Tables(spark, sf)).select("user_id", "item_id").distinct()
    return R.negative_samples(ui, ui.select("item_id"), n=4)


@query("v12_hybrid_candidates")
def q_v12(spark, sf):
    train, _, w = _split_weights(spark, sf)
    from pyspark.sql import Window
    personal = (w.withColumn("_r", F.row_number().over(
        Window.partitionBy("user_id").orderBy(F.col("weight").desc(), F.col("item_id"))))
        .where(F.col("_r") <= K).select("user_id", "item_id", F.col("weight").alias("score")))
    u, i = _als(spark, sf)
    semantic = R.recommend(u, i, K).select("user_id", "item_id", "score")
    return R.hybrid_candidates(personal, semantic)


@query("v1_embed_documents")
def q_v1(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text")
    e = VX.embed_text(d, "text", 1 << 12)
    return e.select("doc_id", F.size(F.filter("embedding.values", lambda x: x != 0)).alias("nonzero"),
                    F.round(VX.sparse_norm("embedding"), 6).alias("norm"))


@query("j8_score_all_items", sql="""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    s AS (SELECT a.vec_id AS user_id, b.vec_id AS item_id, round(list_dot_product(a.e, b.e), 6) AS score
          FROM v a, v b WHERE a.vec_id <> b.vec_id)
    SELECT user_id, item_id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s)
    WHERE rank <= 5""")
def q_j8(spark, sf):
    """Every vector scored against every item (blocked broadcast + Arrow
    batches, no pair rows); each vector's own id is excluded (J7)."""
    v = vectors(spark, sf)
    users = v.select(F.col("item_id").alias("user_id"), F.col("vec").alias("features"))
    items = v.select("item_id", F.col("vec").alias("features"))
    seen = v.select(F.col("item_id").alias("user_id"), "item_id")
    return VX.score_all(users, items, 5, seen=seen).select("user_id", "item_id", "score", "rank")
