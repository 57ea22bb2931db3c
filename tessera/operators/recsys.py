"""Recommendation jobs: temporal split, implicit feedback, factor model,
batch recommendation, candidates, catalogue joins and feature scaling."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import materialize
from tessera.operators.scale import dense_ids, ordered_positions
from tessera.operators.vectors import score_all

# Our default weights per interaction type (a parameter, not a fixed value).
DEFAULT_WEIGHTS = {"click": 1.0, "view": 0.5, "add_to_cart": 2.0, "purchase": 3.0}


def temporal_split(df: DataFrame, ts: str, tiebreak: str, train: float = 0.7,
                   val: float = 0.15, bucket: str = "minute") -> DataFrame:
    """Global time order; the first ``int(n·train)`` rows are train, up to
    ``int(n·(train+val))`` val, the rest test. Positions are exact but
    computed per time bucket (no single-partition global window)."""
    n = df.agg(F.count(F.lit(1))).scalar()
    pos = ordered_positions(df, ts, tiebreak, bucket)
    t_end = F.floor(n * train)
    v_end = F.floor(n * (train + val))
    return pos.withColumn("split", F.when(F.col("position") < t_end, "train")
                          .when(F.col("position") < v_end, "val").otherwise("test"))


def implicit_weights(events: DataFrame, weights: Mapping[str, float] = DEFAULT_WEIGHTS,
                     user: str = "user_id", item: str = "item_id",
                     type_col: str = "interaction_type") -> DataFrame:
    """Weight per (user, item) = Σ weight of its interaction types
    (types without a weight are ignored)."""
    w = None
    for t, v in weights.items():
        w = (F.when(F.col(type_col) == t, F.lit(float(v))) if w is None
             else w.when(F.col(type_col) == t, F.lit(float(v))))
    return (events.withColumn("_w", w).where(F.col("_w").isNotNull())
            .groupBy(user, item).agg(F.sum("_w").alias("weight"), F.count(F.lit(1)).alias("n")))


def fit_factors(ratings: DataFrame, rank: int = 64, max_iter: int = 10, reg: float = 0.1,
                alpha: float = 1.0, seed: int = 42, user: str = "user_id", item: str = "item_id",
                rating: str = "weight"):
    """V5: implicit-feedback matrix factorisation (ALS) — the re-aimed
    two-tower model: dot product of learnt user and item vectors.

    In every round a user's vector travels to each block of items that the user
    has met, so few items are dealt into few blocks (10, Spark's default, from
    1,000 items on). The start and the sums are those of any number of blocks."""
    from pyspark.ml.recommendation import ALS
    blocks = min(10, max(4, -(-ratings.select(item).distinct().count() // 100)))
    als = ALS(rank=rank, numItemBlocks=blocks, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=True,
              userCol=user, itemCol=item, ratingCol=rating, seed=seed,
              coldStartStrategy="drop", checkpointInterval=5)
    return als.fit(ratings)


def factor_frames(model, user: str = "user_id", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    u = model.userFactors.select(F.col("id").cast("long").alias(user), "features")
    i = model.itemFactors.select(F.col("id").cast("long").alias(item), "features")
    return u, i


def recommend(users: DataFrame, items: DataFrame, k: int = 10, seen: DataFrame | None = None,
              user: str = "user_id", item: str = "item_id") -> DataFrame:
    """V6: top-k items per user over all items, seen items excluded."""
    return score_all(users, items, k, user, item, "features", seen)


def drop_excluded(scores: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove excluded / already-seen pairs (anti-join)."""
    return scores.join(excluded.select(*keys), list(keys), "left_anti")


def standardize(df: DataFrame, cols: Sequence[str], digits: int = 9) -> DataFrame:
    """V9: zero mean, unit population variance; statistics are one scalar
    aggregate each, broadcast back as scalar subqueries."""
    out = df
    for c in cols:
        mu = df.agg(F.avg(F.col(c).cast("decimal(20,6)"))).scalar()
        sd = df.agg(F.stddev_pop(c)).scalar()
        out = out.withColumn(f"{c}_z", F.round((F.col(c) - mu.cast("double")) / sd, digits))
    return out


#: A prime step walks the whole item index (it divides no index
#: size below itself), two odd factors spread the starting points.
WALK_STEP, START_USER, START_ITEM = 2_147_483_647, 40_503, 30_011


def negative_samples(pos: DataFrame, items: DataFrame, n: int = 4, seed: int = 42,
                     user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Exactly ``n`` unseen items per positive row, or all unseen ones if
    the user has fewer.

    Every row walks the dense item index from its own starting point by a step
    coprime to the index size, so places never repeat; its negatives are the
    first ``n`` places that the user has not seen. Of the first n + s places
    at least n are unseen by a user with s seen items, so the first pass takes
    as many as are expected to do, and only rows still short walk that far."""
    idx = materialize(dense_ids(items.select(item).distinct(), item, name="_ix"))
    total = idx.count()
    if not total:
        return pos.select(user, item, F.col(item).alias("neg_item")).where(F.lit(False))
    step = WALK_STEP % total if total > 1 else 0
    seen = materialize(pos.select(user, F.col(item).alias("neg_item")).distinct())
    n_seen = seen.groupBy(user).agg(F.count(F.lit(1)).alias("_s"))
    start = F.pmod(F.pmod(F.col(user), F.lit(total)) * START_USER + F.pmod(F.col(item), F.lit(total)) * START_ITEM + seed, F.lit(total))
    rows = materialize(pos.select(user, item).distinct().join(n_seen, user).withColumn("_start", start))
    due = F.least(F.lit(n), F.lit(total) - F.col("_s"))

    def walk(d: DataFrame, places) -> DataFrame:
        c = (d.withColumn("_j", F.explode(F.sequence(F.lit(0), F.least(places, F.lit(total)).cast("long") - 1)))
             .withColumn("_ix", F.pmod(F.col("_start") + F.col("_j") * step, F.lit(total)).cast("long")))
        c = c.join(idx.withColumnRenamed(item, "neg_item"), "_ix").join(seen, [user, "neg_item"], "left_anti")
        w = Window.partitionBy(user, item).orderBy("_j")
        return c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(user, item, "neg_item")

    open_rows = rows.where(due > 0)
    expected = F.ceil(n * F.lit(total) / (F.lit(total) - F.col("_s"))) + n
    first = materialize(walk(open_rows, expected))
    got = first.groupBy(user, item).agg(F.count(F.lit(1)).alias("_got"))
    short = open_rows.join(got, [user, item], "left").where(F.coalesce("_got", F.lit(0)) < due)
    rest = walk(short.drop("_got"), F.lit(n) + F.col("_s"))
    return first.join(short.select(user, item), [user, item], "left_anti").unionAll(rest)


def hybrid_candidates(personal: DataFrame, semantic: DataFrame, user: str = "user_id",
                      item: str = "item_id", score: str = "score") -> DataFrame:
    """Personalised ∪ semantic candidates, one row per (user, item),
    max score and source flags."""
    p = personal.select(user, item, F.col(score).alias("s"), F.lit(True).alias("p"), F.lit(False).alias("q"))
    q = semantic.select(user, item, F.col(score).alias("s"), F.lit(False).alias("p"), F.lit(True).alias("q"))
    return (p.unionByName(q).groupBy(user, item)
            .agg(F.max("s").alias(score), F.max("p").alias("from_personal"), F.max("q").alias("from_semantic")))


def match_reasons(products: DataFrame) -> Column:
    """Category followed by the first two tags."""
    return F.concat(F.array(F.coalesce(F.col("category"), F.lit(""))), F.slice(F.col("tags"), 1, 2))


def hits_to_products(hits: DataFrame, catalog: DataFrame, id_col: str = "product_id") -> DataFrame:
    """Search hits ⋈ catalogue by id (unknown ids are dropped)."""
    return hits.join(catalog, id_col, "inner")


def with_explanations(hits: DataFrame, explanations: DataFrame | None, query_col: str = "query",
                      id_col: str = "product_id") -> DataFrame:
    """J5 (+V13): hit ⟕ explanation; defaults when a field is missing."""
    default_expl = F.concat(F.lit("Matches your interest in '"), F.col(query_col), F.lit("'."))
    if explanations is None:
        out = hits.withColumn("_e", F.lit(None).cast("string")).withColumn(
            "_r", F.lit(None).cast("array<string>"))
    else:
        ex = explanations.select(id_col, F.col("explanation").alias("_e"), F.col("match_reasons").alias("_r"))
        out = hits.join(ex, id_col, "left")
    return (out.withColumn("explanation", F.coalesce("_e", default_expl))
               .withColumn("match_reasons", F.coalesce("_r", match_reasons(out)))
               .drop("_e", "_r"))
