"""Basket graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.lexicons import RECIPE_RELATION
from tessera.operators import graph as G
from tessera.plans.catalog import query
from tessera.sources import Tables
from tessera.sources import views as V
from tessera.sources.views import with_views

MIN_SUPPORT_NAME = 2   # product-name level (support 23–118 in the driver data)
MIN_SUPPORT_PART = 2   # part level (max support is small)
SEARCH = "which red widget products are bought with blue bolt"
NAME_PAIR = ("red widget", "blue bolt")


def name_baskets(spark, sf):
    t = Tables(spark, sf)
    tx = V.transactions(t).select("order_id", "article_id", "customer_id")
    return tx.join(V.articles(t).select("article_id", "product_name"), "article_id")


def part_graph(spark, sf):
    t = Tables(spark, sf)
    co = G.co_purchase(V.transactions(t), "order_id", "article_id", MIN_SUPPORT_PART)
    return G.product_graph(V.catalog(t), co)


BI_NAME = """SELECT DISTINCT t.order_id AS bk, a.product_name AS it
             FROM transactions t JOIN articles a ON t.article_id = a.article_id"""
BI_PART = "SELECT DISTINCT order_id AS bk, article_id AS it FROM transactions"


def co_sql(bi: str, min_support: int) -> str:
    return f"""
    WITH bi AS ({bi}),
    sup AS (SELECT it, COUNT(*) AS s FROM bi GROUP BY it),
    nb AS (SELECT COUNT(DISTINCT bk) AS n FROM bi),
    pr AS (SELECT x.it AS item_a, y.it AS item_b, COUNT(*) AS support
           FROM bi x JOIN bi y ON x.bk = y.bk AND x.it < y.it GROUP BY 1, 2 HAVING COUNT(*) >= {min_support})
    SELECT pr.item_a, pr.item_b, pr.support, sa.s AS support_a, sb.s AS support_b,
           pr.support / sa.s AS confidence_ab, pr.support / sb.s AS confidence_ba,
           (pr.support * nb.n) / (sa.s * sb.s) AS lift
    FROM pr JOIN sup sa ON pr.item_a = sa.it JOIN sup sb ON pr.item_b = sb.it CROSS JOIN nb"""


def _with(sql_body: str, *views) -> str:
    """Attach view CTEs to a query that starts with its own WITH."""
    head = with_views("SELECT 1", *views)
    ctes = head[len("WITH "):head.rindex("\nSELECT 1")]
    assert sql_body.lstrip().startswith("WITH ")
    return "WITH " + ctes + ",\n" + sql_body.lstrip()[len("WITH "):]


@query("g1_order_graph_edges", sql="""
    SELECT 'c_' || CAST(o_custkey AS VARCHAR) AS source, 'o_' || CAST(o_orderkey AS VARCHAR) AS target,
           'PLACED' AS relation, CAST(NULL AS DOUBLE) AS confidence FROM orders
    UNION ALL
    SELECT DISTINCT 'o_' || CAST(l_orderkey AS VARCHAR), 'p_' || CAST(l_partkey AS VARCHAR), 'CONTAINS', CAST(NULL AS DOUBLE)
    FROM lineitem""")
def q_g1(spark, sf):
    t = Tables(spark, sf)
    return G.build_order_graph(t.customer, t.orders, t.lineitem)[1]


@query("g1_order_graph_stats", sql="""
    SELECT 'nodes:Customer' AS metric, COUNT(*) AS value FROM customer
    UNION ALL SELECT 'nodes:Order', COUNT(*) FROM orders
    UNION ALL SELECT 'nodes:Product', COUNT(DISTINCT l_partkey) FROM lineitem
    UNION ALL SELECT 'edges', (SELECT COUNT(*) FROM orders) + (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
    UNION ALL SELECT 'relation_types', 2""")
def q_g1_stats(spark, sf):
    t = Tables(spark, sf)
    return G.graph_stats(*G.build_order_graph(t.customer, t.orders, t.lineitem))


@query("g2_co_purchase_names", bench=True,
       sql=_with(co_sql(BI_NAME, MIN_SUPPORT_NAME), "transactions", "articles"))
def q_g2(spark, sf):
    return G.co_purchase(name_baskets(spark, sf), "order_id", "product_name", MIN_SUPPORT_NAME)


@query("g2_co_purchase_parts", sql=_with(co_sql(BI_PART, MIN_SUPPORT_PART), "transactions"))
def q_g2_parts(spark, sf):
    tx = V.transactions(Tables(spark, sf))
    return G.co_purchase(tx, "order_id", "article_id", MIN_SUPPORT_PART)


@query("j9_basket_pairs", sql=with_views(f"""
    SELECT x.it AS item_a, y.it AS item_b, COUNT(*) AS support
    FROM ({BI_NAME}) x JOIN ({BI_NAME}) y ON x.bk = y.bk AND x.it < y.it GROUP BY 1, 2""",
    "transactions", "articles"))
def q_j9(spark, sf):
    return G.basket_pairs(name_baskets(spark, sf), "order_id", "product_name", 1)


@query("j9_basket_pairs_small_blocks", sql=with_views(f"""
    SELECT x.it AS item_a, y.it AS item_b, COUNT(*) AS support
    FROM ({BI_NAME}) x JOIN ({BI_NAME}) y ON x.bk = y.bk AND x.it < y.it GROUP BY 1, 2""",
    "transactions", "articles"))
def q_j9_blocks(spark, sf):
    """Same pairs with a 2-item block, so every basket takes the split path."""
    return G.basket_pairs(name_baskets(spark, sf), "order_id", "product_name", 1, block=2)


PG_EDGES_SQL = f"""
    SELECT CAST(item_a AS VARCHAR) AS source, CAST(item_b AS VARCHAR) AS target,
           'FREQUENTLY_BOUGHT_WITH' AS relation, confidence_ab AS confidence FROM co
    UNION ALL SELECT CAST(item_b AS VARCHAR), CAST(item_a AS VARCHAR), 'FREQUENTLY_BOUGHT_WITH', confidence_ba FROM co
    UNION ALL SELECT CAST(product_id AS VARCHAR), 'cat_' || category, 'IN_CATEGORY', 1.0 FROM catalog
    UNION ALL SELECT CAST(product_id AS VARCHAR), 'aisle_' || aisle, 'IN_AISLE', 1.0 FROM catalog"""
PG_NODES_SQL = """
    SELECT CAST(product_id AS VARCHAR) AS id, name AS label, 'Product' AS type, category, price, aisle FROM catalog
    UNION ALL SELECT DISTINCT 'cat_' || category, category, 'Category', NULL, NULL, NULL FROM catalog
    UNION ALL SELECT DISTINCT 'aisle_' || aisle, aisle, 'Aisle', NULL, NULL, NULL FROM catalog"""


def pg_sql(body: str) -> str:
    return with_views(body, "transactions", "catalog", "co", "pg_edges", "pg_nodes",
                      extra={"co": _co_as_view(), "pg_edges": PG_EDGES_SQL, "pg_nodes": PG_NODES_SQL})


def _co_as_view() -> str:
    return f"""
        WITH bi AS ({BI_PART}),
        sup AS (SELECT it, COUNT(*) AS s FROM bi GROUP BY it),
        nb AS (SELECT COUNT(DISTINCT bk) AS n FROM bi),
        pr AS (SELECT x.it AS item_a, y.it AS item_b, COUNT(*) AS support
               FROM bi x JOIN bi y ON x.bk = y.bk AND x.it < y.it GROUP BY 1, 2 HAVING COUNT(*) >= {MIN_SUPPORT_PART})
        SELECT pr.item_a, pr.item_b, pr.support / sa.s AS confidence_ab, pr.support / sb.s AS confidence_ba
        FROM pr JOIN sup sa ON pr.item_a = sa.it JOIN sup sb ON pr.item_b = sb.it"""


@query("g3_product_graph_edges", sql=pg_sql("SELECT * FROM pg_edges"))
def q_g3(spark, sf):
    return part_graph(spark, sf)[1]


@query("g4_graph_stats", sql=pg_sql("""
    SELECT 'nodes:' || type AS metric, COUNT(*) AS value FROM pg_nodes GROUP BY type
    UNION ALL SELECT 'edges', COUNT(*) FROM pg_edges
    UNION ALL SELECT 'relation_types', COUNT(DISTINCT relation) FROM pg_edges"""))
def q_g4(spark, sf):
    return G.graph_stats(*part_graph(spark, sf))


J6_SQL = """
    SELECT e.source, e.target, e.relation, e.confidence,
           COALESCE(s.label, '') AS src_label, COALESCE(s.category, '') AS src_category, COALESCE(s.aisle, '') AS src_aisle,
           COALESCE(t.label, '') AS tgt_label, COALESCE(t.category, '') AS tgt_category, COALESCE(t.aisle, '') AS tgt_aisle,
           s.price AS src_price, t.price AS tgt_price
    FROM pg_edges e LEFT JOIN pg_nodes s ON e.source = s.id LEFT JOIN pg_nodes t ON e.target = t.id"""


@query("j6_edges_with_nodes", sql=pg_sql(J6_SQL))
def q_j6(spark, sf):
    nodes, edges = part_graph(spark, sf)
    return G.edges_with_nodes(edges, nodes)


def _pattern_sql(where: str) -> str:
    return pg_sql(f"""
    SELECT src_label AS product, relation AS relationship, tgt_label AS related_to, confidence
    FROM ({J6_SQL}) WHERE src_price IS NOT NULL AND tgt_price IS NOT NULL AND {where}
    ORDER BY confidence DESC, source, target LIMIT 10""")


@query("g5_pattern_frequently_bought", sql=_pattern_sql("relation = 'FREQUENTLY_BOUGHT_WITH'"))
def q_g5_rel(spark, sf):
    return G.run_pattern(*part_graph(spark, sf), "relation", G.FBW)


@query("g5_pattern_recipe", sql=_pattern_sql("relation = 'FREQUENTLY_BOUGHT_WITH' AND src_aisle = tgt_aisle").replace(
    "relation AS relationship", f"'{RECIPE_RELATION}' AS relationship"))
def q_g5_recipe(spark, sf):
    """Co-purchases within one aisle stand in for recipe edges."""
    nodes, edges = part_graph(spark, sf)
    ends = G.edges_with_nodes(edges, nodes).where((F.col("relation") == G.FBW) & (F.col("src_aisle") == F.col("tgt_aisle")))
    recipe = ends.select("source", "target", F.lit(RECIPE_RELATION).alias("relation"), "confidence")
    return G.run_pattern(nodes, edges.unionByName(recipe), "recipe")


@query("g5_pattern_name_contains", sql=_pattern_sql("contains(src_label, 'red')"))
def q_g5_name(spark, sf):
    return G.run_pattern(*part_graph(spark, sf), "name_contains", "red")


@query("g5_pattern_aisle", sql=_pattern_sql("src_aisle = 'Brand#1'"))
def q_g5_aisle(spark, sf):
    return G.run_pattern(*part_graph(spark, sf), "aisle", "Brand#1")


@query("g5_pattern_default", sql=_pattern_sql("true"))
def q_g5_default(spark, sf):
    return G.run_pattern(*part_graph(spark, sf), "default")


@query("g5_pattern_expensive", sql=with_views("""
    SELECT name, category, aisle, price FROM catalog WHERE price > 990
    ORDER BY price DESC, CAST(product_id AS VARCHAR) LIMIT 10""", "catalog"))
def q_g5_exp(spark, sf):
    return G.run_pattern(*part_graph(spark, sf), "expensive", 990)


def _search_where() -> str:
    from tessera.functions.lexicons import GRAPH_STOPWORDS
    words = [w for w in SEARCH.lower().split() if w not in set(GRAPH_STOPWORDS)]
    conds = []
    for w in words:
        conds.append(f"contains(lower(concat_ws(' ', src_label, src_category, src_aisle)), '{w}')")
        conds.append(f"contains(lower(concat_ws(' ', tgt_label, tgt_category, tgt_aisle)), '{w}')")
        conds.append(f"contains(lower(relation), '{w}')")
    return " OR ".join(conds)


@query("g6_edge_search", sql=pg_sql(f"""
    SELECT src_label AS product, relation AS relationship, tgt_label AS related_to, confidence, source, target
    FROM ({J6_SQL}) WHERE src_price IS NOT NULL AND tgt_price IS NOT NULL AND ({_search_where()})"""))
def q_g6(spark, sf):
    return G.edge_search(*part_graph(spark, sf), SEARCH)


@query("t17_explain_first_hit", sql=pg_sql(f"""
    SELECT 'The graph shows that ' || product || ' is connected to ' || related_to || ' via a '
           || lower(replace(relationship, '_', ' ')) || ' relationship (confidence: '
           || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '%). Found '
           || CAST(n AS VARCHAR) || ' relevant connections in the product knowledge graph.' AS explanation,
           n AS n_results
    FROM (SELECT *, COUNT(*) OVER () AS n, row_number() OVER (ORDER BY confidence DESC, source, target) AS rn
          FROM (SELECT src_label AS product, relation AS relationship, tgt_label AS related_to, confidence, source, target
                FROM ({J6_SQL}) WHERE src_price IS NOT NULL AND tgt_price IS NOT NULL AND ({_search_where()})))
    WHERE rn = 1"""))
def q_t17(spark, sf):
    hits = G.edge_search(*part_graph(spark, sf), SEARCH).withColumn("neg_conf", -F.col("confidence"))
    return G.explain_first_hit(hits, ["neg_conf", "source", "target"])


@query("u5_bought_both", sql=with_views(f"""
    SELECT t.customer_id FROM transactions t JOIN articles a ON t.article_id = a.article_id
    WHERE a.product_name IN {NAME_PAIR} GROUP BY t.customer_id
    HAVING COUNT(DISTINCT a.product_name) = 2""", "transactions", "articles"))
def q_u5(spark, sf):
    return G.bought_all(name_baskets(spark, sf), "customer_id", "product_name", NAME_PAIR)


@query("g3_product_graph_nodes", sql=pg_sql("SELECT id, label, type, category, price, aisle FROM pg_nodes"))
def q_g3_nodes(spark, sf):
    """Product ∪ category ∪ aisle nodes."""
    return part_graph(spark, sf)[0].select("id", "label", "type", "category", "price", "aisle")
