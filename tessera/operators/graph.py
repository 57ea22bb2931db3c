"""Basket graph: order graph, co-purchase edges, product graph, pattern
queries, keyword edge search and graph statistics.

Graphs are two DataFrames — nodes(id, label, type, …) and
edges(source, target, relation, confidence) — so every pattern is a join or
filter that Catalyst plans like any other query.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import lexicons as L
from tessera.session import materialize

FBW = "FREQUENTLY_BOUGHT_WITH"


def build_order_graph(customers: DataFrame, orders: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G1: Customer –PLACED→ Order –CONTAINS→ Product (distinct lines)."""
    nodes = (customers.select(F.concat(F.lit("c_"), F.col("c_custkey").cast("string")).alias("id"),
                              F.col("c_name").alias("label"), F.lit("Customer").alias("type"))
             .unionByName(orders.select(F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("id"),
                                        F.col("o_orderkey").cast("string").alias("label"),
                                        F.lit("Order").alias("type")))
             .unionByName(lines.select("l_partkey").distinct().select(
                 F.concat(F.lit("p_"), F.col("l_partkey").cast("string")).alias("id"),
                 F.col("l_partkey").cast("string").alias("label"), F.lit("Product").alias("type"))))
    placed = orders.select(F.concat(F.lit("c_"), F.col("o_custkey").cast("string")).alias("source"),
                           F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("target"),
                           F.lit("PLACED").alias("relation"))
    contains = lines.select("l_orderkey", "l_partkey").distinct().select(
        F.concat(F.lit("o_"), F.col("l_orderkey").cast("string")).alias("source"),
        F.concat(F.lit("p_"), F.col("l_partkey").cast("string")).alias("target"),
        F.lit("CONTAINS").alias("relation"))
    edges = placed.unionByName(contains).withColumn("confidence", F.lit(None).cast("double"))
    return nodes, edges


ROWS_EACH, PAIRS_EACH = 250_000, 1_000_000     # rows and pairs of one task


def _tasks(df: DataFrame, n: int, each: int) -> int:
    """Tasks of about ``each`` rows, or less where that leaves cores idle."""
    return max(1, -(-n // each), min(df.sparkSession.sparkContext.defaultParallelism, n // 10_000))


def basket_arrays(baskets: DataFrame, basket: str, item: str, block: int = 64) -> tuple[DataFrame, int]:
    """(t, bk, h, pieces, items; number of pairs at most): the distinct items of
    each basket as a sorted array. A basket of more than ``block`` rows is cut by
    item hash into ``pieces`` of about ``block`` items, so that no array grows
    with a hot basket. Null baskets and items are left out.

    Two passes count the rows, then the rows per basket. Where all baskets are small, nothing is joined: one shuffle gathers
    the arrays, in as many tasks (``t``) as the rows ask for."""
    bi = baskets.select(F.col(basket).alias("bk"), F.col(item).alias("it")).where("bk is not null and it is not null")
    tasks = _tasks(bi, bi.count(), ROWS_EACH)
    per = bi.repartition(tasks, "bk").groupBy("bk").agg(F.count(F.lit(1)).alias("n"))
    most, pairs = per.agg(F.max("n"), F.sum(F.col("n").cast("decimal(20,0)") * (F.col("n") - 1) / 2)).first()
    if (most or 0) <= block:
        cut = bi.withColumns({"pieces": F.lit(1), "h": F.lit(0)})
    else:
        big = materialize(per.where(F.col("n") > block).select("bk", F.ceil(F.col("n") / block).cast("int").alias("pieces")))
        cut = bi.join(big, "bk", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        cut = cut.withColumn("h", F.pmod(F.xxhash64("it"), F.col("pieces")).cast("int"))
    cut = cut.withColumn("t", F.pmod(F.xxhash64("bk", "h"), F.lit(tasks)).cast("int")).repartitionById(tasks, "t")
    return cut.groupBy("t", "bk", "h", "pieces").agg(F.sort_array(F.collect_set("it")).alias("items")), int(pairs or 0)


def _count_pairs(arrays: DataFrame, most: int, min_support: int) -> DataFrame:
    """Pairs are counted inside each task of the arrays first (no shuffle), then
    over all, in as many tasks as ``most`` pairs ask for."""
    # inside an array: each item with those behind it
    inside = arrays.where(F.size("items") > 1).select("t", "items", F.posexplode("items").alias("i", "a")).select(
        "t", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    # across the pieces of a large basket: each two pieces are one row
    cut = arrays.where("pieces > 1")
    low = cut.select("bk", "h", F.explode(F.sequence(F.col("h"), F.col("pieces") - 1)).alias("o"), F.col("items").alias("x")).where("o > h")
    high = cut.select("bk", F.col("h").alias("o"), F.explode(F.sequence(F.lit(0), F.col("h"))).alias("h"), F.col("items").alias("y")).where("h < o")
    tasks = _tasks(arrays, most, PAIRS_EACH)
    met = low.join(high, ["bk", "h", "o"]).select(F.pmod(F.xxhash64("bk", "h", "o"), F.lit(tasks)).cast("int").alias("t"), "x", "y")
    across = met.repartitionById(tasks, "t").select("t", F.explode("x").alias("a"), "y").select("t", "a", F.explode("y").alias("b"))
    across = across.select("t", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    here = [p.groupBy("t", "a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", "n") for p in (inside, across)]
    out = here[0].unionAll(here[1]).repartition(tasks, "a", "b").groupBy(F.col("a").alias("item_a"), F.col("b").alias("item_b")).agg(
        F.sum("n").alias("support"))
    return out.where(F.col("support") >= min_support) if min_support > 1 else out


def basket_pairs(baskets: DataFrame, basket: str, item: str, min_support: int = 1, block: int = 64) -> DataFrame:
    """Unordered item pairs (a < b) bought in the same basket, with the
    number of baskets containing both (support >= ``min_support``).

    Pairs come from the baskets' arrays, not from a self-join of their rows, and
    are counted partially before the shuffle; pieces of a large basket meet two
    by two."""
    return _count_pairs(*basket_arrays(baskets, basket, item, block), min_support)


def co_purchase(baskets: DataFrame, basket: str, item: str, min_support: int = 2,
                block: int = 64) -> DataFrame:
    """Pair support, confidence both ways and lift.

    confidence(a→b) = support(a,b) / support(a);
    lift = support(a,b) · N / (support(a) · support(b)), N = baskets.
    The pairs, the items' support and N all read the whole arrays, so that one
    shuffle serves them (Spark reuses an exchange of the same columns).
    """
    arrays, most = basket_arrays(baskets, basket, item, block)
    item_sup = arrays.select(F.explode("items").alias("it")).groupBy("it").agg(F.count(F.lit(1)).alias("s"))
    n = arrays.where(F.size("items") > 0).agg(
        F.count_if(F.col("pieces") == 1) + F.count_distinct(F.when(F.col("pieces") > 1, F.col("bk")))).scalar()
    pairs = _count_pairs(arrays, most, min_support)
    sa = item_sup.select(F.col("it").alias("item_a"), F.col("s").alias("support_a"))
    sb = item_sup.select(F.col("it").alias("item_b"), F.col("s").alias("support_b"))
    p = pairs.join(sa, "item_a").join(sb, "item_b")
    return p.select(
        "item_a", "item_b", "support", "support_a", "support_b",
        (F.col("support") / F.col("support_a")).alias("confidence_ab"),
        (F.col("support") / F.col("support_b")).alias("confidence_ba"),
        ((F.col("support") * n) / (F.col("support_a") * F.col("support_b"))).alias("lift"))


def product_graph(products: DataFrame, co: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G3 (+U2): product, category and aisle nodes; co-purchase edges both
    ways with their confidence; IN_CATEGORY and IN_AISLE edges at 1.0."""
    pid = F.col("product_id").cast("string")
    nodes = (products.select(pid.alias("id"), F.col("name").alias("label"), F.lit("Product").alias("type"),
                             "category", "price", "aisle")
             .unionByName(products.select("category").distinct().select(
                 F.concat(F.lit("cat_"), "category").alias("id"), F.col("category").alias("label"),
                 F.lit("Category").alias("type")), allowMissingColumns=True)
             .unionByName(products.select("aisle").distinct().select(
                 F.concat(F.lit("aisle_"), "aisle").alias("id"), F.col("aisle").alias("label"),
                 F.lit("Aisle").alias("type")), allowMissingColumns=True))
    fwd = co.select(F.col("item_a").cast("string").alias("source"), F.col("item_b").cast("string").alias("target"),
                    F.lit(FBW).alias("relation"), F.col("confidence_ab").alias("confidence"))
    bwd = co.select(F.col("item_b").cast("string").alias("source"), F.col("item_a").cast("string").alias("target"),
                    F.lit(FBW).alias("relation"), F.col("confidence_ba").alias("confidence"))
    in_cat = products.select(pid.alias("source"), F.concat(F.lit("cat_"), "category").alias("target"),
                             F.lit("IN_CATEGORY").alias("relation"), F.lit(1.0).alias("confidence"))
    in_aisle = products.select(pid.alias("source"), F.concat(F.lit("aisle_"), "aisle").alias("target"),
                               F.lit("IN_AISLE").alias("relation"), F.lit(1.0).alias("confidence"))
    return nodes, fwd.unionByName(bwd).unionByName(in_cat).unionByName(in_aisle)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node counts per type, edge count, distinct relation types."""
    n = nodes.groupBy(F.concat(F.lit("nodes:"), F.col("type")).alias("metric")).agg(
        F.count(F.lit(1)).alias("value"))
    e = edges.agg(F.count(F.lit(1)).alias("value")).select(F.lit("edges").alias("metric"), "value")
    r = edges.agg(F.count_distinct("relation").alias("value")).select(F.lit("relation_types").alias("metric"), "value")
    return n.unionByName(e).unionByName(r)


def edges_with_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ⟕ source node ⟕ target node; missing attributes → ''."""
    def side(prefix):
        return nodes.select(F.col("id").alias(f"{prefix}_id"),
                            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"{prefix}_{c}")
                              for c in ("label", "category", "aisle")],
                            F.col("price").alias(f"{prefix}_price"))
    s, t = side("src"), side("tgt")
    j = (edges.join(s, edges.source == s.src_id, "left").join(t, F.col("target") == t.tgt_id, "left"))
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in
            ("src_label", "src_category", "src_aisle", "tgt_label", "tgt_category", "tgt_aisle")]
    return j.select("source", "target", "relation", "confidence", *cols, "src_price", "tgt_price")


def top_edges(df: DataFrame, by: str, k: int = 10, tiebreak: Sequence[str] = ("source", "target")) -> DataFrame:
    """K1: ORDER BY ``by`` DESC LIMIT k (a top-k sort: each task keeps k rows)."""
    return df.orderBy(F.col(by).desc(), *[F.col(c) for c in tiebreak]).limit(k)


def run_pattern(nodes: DataFrame, edges: DataFrame, pattern: str, value=None, k: int = 10) -> DataFrame:
    """The six templated graph patterns, executed (not keyword-matched).

    relation: edges of relation ``value``; name_contains: source name
    contains ``value``; aisle: source aisle equals ``value``; recipe:
    OFTEN_IN_SAME_RECIPE edges; expensive: products with price > ``value``;
    default: all product→product edges. Top ``k`` by confidence (or price).
    """
    prods = nodes.where(F.col("type") == "Product")
    if pattern == "expensive":
        p = prods.where(F.col("price") > float(value if value is not None else 5.0))
        return (p.orderBy(F.col("price").desc(), F.col("id")).limit(k)
                 .select(F.col("label").alias("name"), "category", "aisle", "price"))
    e = edges_with_nodes(edges, nodes).where(F.col("src_price").isNotNull() & F.col("tgt_price").isNotNull())
    if pattern == "relation":
        e = e.where(F.col("relation") == value)
    elif pattern == "recipe":
        e = e.where(F.col("relation") == L.RECIPE_RELATION)
    elif pattern == "name_contains":
        e = e.where(F.col("src_label").contains(value))
    elif pattern == "aisle":
        e = e.where(F.col("src_aisle") == value)
    elif pattern != "default":
        raise ValueError(f"unknown pattern {pattern!r}")
    top = top_edges(e, "confidence", k)
    return top.select(F.col("src_label").alias("product"), F.col("relation").alias("relationship"),
                      F.col("tgt_label").alias("related_to"), "confidence")


def edge_search(nodes: DataFrame, edges: DataFrame, query: str,
                stopwords: Sequence[str] = L.GRAPH_STOPWORDS, fallback: int = 5) -> DataFrame:
    """product→product edges where any (non-stop) query word occurs in
    the source text, target text ('name category aisle', lower case) or the
    relation name; when nothing matches, the first ``fallback`` edges."""
    words = [w for w in query.lower().split() if w not in set(stopwords)]
    e = edges_with_nodes(edges, nodes).where(F.col("src_price").isNotNull() & F.col("tgt_price").isNotNull())
    # used three times below (hits, fallback, hit count): materialise once
    e = materialize(e)
    st = F.lower(F.concat_ws(" ", "src_label", "src_category", "src_aisle"))
    tt = F.lower(F.concat_ws(" ", "tgt_label", "tgt_category", "tgt_aisle"))
    rel = F.lower("relation")
    cond: Column = F.lit(False)
    for w in words:
        cond = cond | st.contains(w) | tt.contains(w) | rel.contains(w)
    hits = e.where(cond).withColumn("_fallback", F.lit(False))
    first = (e.orderBy("source", "target").limit(fallback).withColumn("_fallback", F.lit(True)))
    n_hits = hits.agg(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    out = hits.unionByName(first).where((n_hits > 0) != F.col("_fallback"))
    return out.select(F.col("src_label").alias("product"), F.col("relation").alias("relationship"),
                      F.col("tgt_label").alias("related_to"), "confidence", "source", "target")


def explain_first_hit(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """One sentence about the first hit plus the number of hits."""
    first = F.min_by(F.struct("product", "relationship", "related_to", "confidence"),
                     F.struct(*[F.col(c) for c in order]))
    agg = results.agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    rel = F.lower(F.regexp_replace("f.relationship", "_", " "))
    pct = F.round(F.col("f.confidence") * 100, 0).cast("int").cast("string")
    text = F.concat(F.lit("The graph shows that "), F.col("f.product"), F.lit(" is connected to "),
                    F.col("f.related_to"), F.lit(" via a "), rel, F.lit(" relationship (confidence: "),
                    pct, F.lit("%). Found "), F.col("n").cast("string"),
                    F.lit(" relevant connections in the product knowledge graph."))
    return agg.select(F.when(F.col("n") > 0, text).otherwise(F.lit("No results found for this query."))
                      .alias("explanation"), F.col("n").alias("n_results"))


def bought_all(lines: DataFrame, customer: str, item: str, items: Sequence) -> DataFrame:
    """Customers who bought every item in ``items`` (relational division)."""
    return (lines.where(F.col(item).isin(*items)).groupBy(customer)
            .agg(F.count_distinct(item).alias("_k")).where(F.col("_k") == len(set(items)))
            .select(customer))
