"""Text jobs: batch scoring and statistics, vocabulary, encoding, reply
parsing, prompt tables and catalogue keyword search."""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tessera.functions import lexicons as L
from tessera.functions import text as TX
from tessera.functions.scorers import get_scorer, has_scorer

LABELS = ("POSITIVE", "NEGATIVE", "NEUTRAL", "MIXED")
URGENCIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def with_aspect_flags(df: DataFrame, low: str, groups=L.ASPECT_GROUPS,
                      positive=L.RULE_POSITIVE, negative=L.RULE_NEGATIVE) -> DataFrame:
    """Positive / negative hit counts and one hit flag per aspect group,
    computed once per row from the lower-cased text (``low``)."""
    low_c = F.col(low)
    out = (df.withColumn("_pc", TX.substring_count(low_c, positive))
             .withColumn("_nc", TX.substring_count(low_c, negative)))
    for i, (_, keywords, _) in enumerate(groups):
        hit = F.lit(False)
        for kw in keywords:
            hit = hit | low_c.contains(kw)
        out = out.withColumn(f"_h{i}", hit)
    return out


def aspects_from_flags(groups=L.ASPECT_GROUPS) -> Column:
    """T3 from the flags of ``with_aspect_flags`` (same rules as ``TX.aspects``)."""
    pc, nc = F.col("_pc"), F.col("_nc")
    any_pos, any_neg = pc > 0, nc > 0
    label = F.when(any_pos & ~any_neg, "POSITIVE").when(any_neg & ~any_pos, "NEGATIVE").otherwise("MIXED")
    entries = []
    for i, (name, _, base) in enumerate(groups):
        score = (F.when(any_pos & ~any_neg, min(0.95, round(base + 0.05, 2)))
                 .when(any_neg & ~any_pos, max(0.15, round(base - 0.30, 2))).otherwise(base))
        entries.append(F.when(F.col(f"_h{i}"), F.struct(F.lit(name).alias("aspect"), label.alias("sentiment"),
                                                        F.round(score, 2).cast("double").alias("score"))))
    found = F.filter(F.array(*entries), lambda x: x.isNotNull())
    o_label = F.when(pc > nc, "POSITIVE").when(nc > pc, "NEGATIVE").when(any_pos & any_neg, "MIXED") \
               .otherwise("NEUTRAL")
    o_conf = (F.when(pc > nc, F.least(F.lit(0.95), F.lit(0.65) + pc * 0.1))
              .when(nc > pc, F.least(F.lit(0.95), F.lit(0.65) + nc * 0.1))
              .when(any_pos & any_neg, F.lit(0.72)).otherwise(F.lit(0.60)))
    fallback = F.array(F.struct(F.lit("overall experience").alias("aspect"), o_label.alias("sentiment"),
                                F.round(o_conf, 2).cast("double").alias("score")))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def drop_flags(df: DataFrame, groups=L.ASPECT_GROUPS) -> DataFrame:
    return df.drop("_pc", "_nc", *[f"_h{i}" for i in range(len(groups))])


def label_text(col: str, positive, negative, scorer: str | None = None, low: str | None = None) -> Column:
    """F2: label and confidence by the named scorer; by the rules and the given
    words (on ``low``, the lower-cased text, if at hand) where none, or an
    unknown one, is named."""
    if scorer in (None, "rules") or not has_scorer(scorer):
        return TX.sentiment_label(low or col, positive, negative, lowered=low is not None)
    return get_scorer(scorer)(F.col(col))


def score_texts(df: DataFrame, col: str, positive=L.RULE_POSITIVE, negative=L.RULE_NEGATIVE,
                groups=L.ASPECT_GROUPS, scorer: str | None = None) -> DataFrame:
    """T2–T6 + T16 in one pass: label and confidence (by the named ``scorer``,
    F2), aspects, entities, urgency, key phrases, summary, stored source text."""
    # lower(text), the word array and the keyword flags are materialised once
    # per row and shared by every rule (array lambdas would re-evaluate them)
    base = df.withColumn("_low", F.lower(col)).withColumn("_words", TX.whitespace_words(col))
    base = with_aspect_flags(base, "_low", groups, positive, negative)
    s = label_text(col, positive, negative, scorer, low="_low")
    out = (base.withColumn("_s", s)
               .withColumn("label", F.col("_s.label"))
               .withColumn("confidence", F.col("_s.confidence"))
               .withColumn("aspects", aspects_from_flags(groups))
               .withColumn("entities", TX.entities("_low", lowered=True))
               .withColumn("urgency", TX.urgency("_low", negative, lowered=True))
               .withColumn("key_phrases", TX.key_phrases(col, words=F.col("_words"))))
    out = out.withColumn("summary", TX.summary_text(F.col("label"), F.col("confidence"),
                                                    F.size("aspects")))
    out = out.withColumn("source_text", TX.source_text(col)).drop("_s", "_low", "_words")
    return drop_flags(out, groups)


def _round_mean_int(total: Column, n: Column, unit: int, digits: int) -> Column:
    """Half-up rounded mean of values held as integers of 1/``unit``,
    to ``digits`` decimals, exactly: floor((2·10^d·Σ + unit·n) / (2·unit·n))."""
    scale = 10 ** digits
    return (F.floor((total * 2 * scale + n * unit) / (n * 2 * unit)) / scale).cast("double")


def sentiment_stats(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """A4: zero-filled label and urgency counts and mean confidence (3 dp)
    per batch ``by`` — a single partial/final aggregate."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col("label") == x).alias(f"n_{x.lower()}") for x in LABELS]
    aggs += [F.count_if(F.col("urgency") == x).alias(f"urgency_{x.lower()}") for x in URGENCIES]
    conf_h = F.sum(F.round(F.col("confidence") * 100).cast("long"))
    aggs.append(_round_mean_int(conf_h, F.count(F.lit(1)), 100, 3).alias("avg_confidence"))
    return scored.groupBy(*by).agg(*aggs)


def aspect_stats(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per aspect — mean score (2 dp), mentions and dominant
    sentiment (mode; ties go to the alphabetically first label)."""
    ex = scored.select(*by, F.explode_outer("aspects").alias("a")).where(F.col("a").isNotNull()).select(
        *by, F.lower(F.col("a.aspect")).alias("aspect"), F.col("a.sentiment").alias("sentiment"),
        F.round(F.col("a.score") * 100).cast("long").alias("score_h"))
    per = ex.groupBy(*by, "aspect", "sentiment").agg(F.count(F.lit(1)).alias("c"),
                                                      F.sum("score_h").alias("s"))
    return per.groupBy(*by, "aspect").agg(
        _round_mean_int(F.sum("s"), F.sum("c"), 100, 2).alias("avg_score"),
        F.sum("c").alias("mentions"),
        F.min_by("sentiment", F.struct(-F.col("c"), F.col("sentiment"))).alias("dominant_sentiment"))


def by_mentions(stats: DataFrame) -> DataFrame:
    """K7: aspects (one row each) numbered from the most mentioned; ties by name."""
    w = Window.orderBy(F.col("mentions").desc(), "aspect")
    return stats.withColumn("position", F.row_number().over(w).cast("long"))


def daily_trend(scored: DataFrame, date_col: str, score_col: str = "score") -> DataFrame:
    """A10: per day — count per label and mean score."""
    return scored.groupBy(F.to_date(date_col).alias("date")).agg(
        *[F.count_if(F.col("label") == x).alias(x.lower()) for x in LABELS],
        (F.sum(F.col(score_col).cast("decimal(10,3)")).cast("double")
         / F.count(score_col)).alias("avg_score"))


def recent(df: DataFrame, ts: str, tiebreak: str, n: int = 50) -> DataFrame:
    """K2: newest ``n`` rows (top-n by timestamp: each task keeps n rows)."""
    return df.orderBy(F.col(ts).desc(), F.col(tiebreak).desc()).limit(n)


# ---- vocabulary / encoding ---------------------------------------------------

def build_vocab(df: DataFrame, col: str, n: int = 5000) -> DataFrame:
    """Top-``n`` tokens by (−frequency, token), ids from 1 (0 = <unk>).

    Counting is a distributed aggregate; only the ``n`` winners are ordered.
    """
    # explode_outer + null filter: a plain explode makes Catalyst add a
    # size(array) > 0 filter below the projection, re-tokenising every text
    counts = (df.select(F.explode_outer(TX.tokenize(col)).alias("token")).where(F.col("token").isNotNull())
              .groupBy("token").agg(F.count(F.lit(1)).alias("freq")))
    top = counts.orderBy(F.col("freq").desc(), F.col("token")).limit(n)
    w = Window.orderBy(F.col("freq").desc(), F.col("token"))  # over ≤ n rows
    return top.withColumn("idx", F.row_number().over(w).cast("long"))


def encode(df: DataFrame, key: str, col: str, vocab: DataFrame) -> DataFrame:
    """Token ids in text order, out-of-vocabulary → 0.

    The vocabulary has at most ``n`` rows (a proven bound). It becomes one scalar
    value: an array of small maps, a token lying in the map that its hash names,
    so that a look-up is one array access and a map of about one entry (a plain
    map is searched from end to end). Documents are encoded in place, in the JVM;
    tokens are never exploded or shuffled."""
    n = 1 << max(4, (vocab.count() - 1).bit_length())
    own = lambda t: F.pmod(F.xxhash64(t), F.lit(n)).cast("int")
    maps = vocab.groupBy(own(F.col("token")).alias("_b")).agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("idx").cast("long")))).alias("m"))
    every = vocab.sparkSession.range(n).select(F.col("id").cast("int").alias("_b"))
    empty = F.create_map().cast("map<string,bigint>")
    table = every.join(maps, "_b", "left").agg(F.sort_array(F.collect_list(F.struct("_b", F.map_entries("m").alias("m")))).alias("t"))
    table = table.select(F.transform("t", lambda x: F.map_from_entries(F.coalesce(x["m"], F.map_entries(empty)))).alias("t"))
    toks = df.select(key, TX.tokenize(col).alias("_tk")).withColumn("_m", table.scalar())
    return toks.select(key, F.transform("_tk", lambda t: F.coalesce(F.get(F.col("_m"), own(t))[t], F.lit(0).cast("long"))).alias("ids"))


# ---- model replies ---------------------------------------------------------------

def parse_reply(col, schema: T.StructType) -> Column:
    """Strip Markdown fences, parse JSON; invalid → null fields, an
    ``error`` message and the first 500 characters as ``raw``."""
    body = TX.strip_code_fence(col)
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    ok = F.coalesce(F.get_json_object(body, "$").isNotNull(), F.lit(False))
    return F.struct(*[F.when(ok, parsed[f.name]).alias(f.name) for f in schema.fields],
                    F.when(~ok, F.lit("Failed to parse response")).alias("error"),
                    F.when(~ok, F.substring(body, 1, 500)).alias("raw"))


REPLY = T.StructType([
    T.StructField("sentiment", T.StringType()), T.StructField("confidence", T.StringType()),
    T.StructField("urgency", T.StringType()), T.StructField("summary", T.StringType()),
    T.StructField("key_phrases", T.ArrayType(T.StringType())),
    T.StructField("aspects", T.ArrayType(T.StructType([T.StructField("aspect", T.StringType()),
                                                       T.StructField("sentiment", T.StringType()),
                                                       T.StructField("score", T.DoubleType())])))])


def analyse_replies(df: DataFrame, reply: str, text: str, positive=L.RULE_POSITIVE,
                    negative=L.RULE_NEGATIVE, scorer: str | None = None) -> DataFrame:
    """Model replies as scored rows. A missing (or null) field takes its
    default: NEUTRAL, 0.5, LOW, an empty summary or list. A reply that is not a
    JSON object, reports an ``error`` or holds an unknown label, urgency or
    confidence is set aside: the named ``scorer`` (rules by default) scores the
    text instead, and ``scored_by`` says so."""
    d = df.withColumn("_b", TX.strip_code_fence(reply)).withColumn("_p", F.from_json("_b", REPLY))
    conf = F.expr("try_cast(_p.confidence as double)")
    ok = (F.get_json_object("_b", "$").isNotNull() & F.col("_b").startswith("{")
          & F.get_json_object("_b", "$.error").isNull()
          & (F.col("_p.sentiment").isNull() | F.col("_p.sentiment").isin(*LABELS))
          & (F.col("_p.urgency").isNull() | F.col("_p.urgency").isin(*URGENCIES))
          & (F.col("_p.confidence").isNull() | conf.isNotNull()))
    d = d.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("_s", label_text(text, positive, negative, scorer))
    rule_aspects = F.transform(TX.aspects(text, positive=positive, negative=negative), lambda a: F.struct(
        a["aspect"].alias("aspect"), a["sentiment"].alias("sentiment"), a["score"].alias("score")))
    none = F.array().cast(REPLY["aspects"].dataType)
    d = d.withColumn("aspects", F.when(F.col("_ok"), F.coalesce("_p.aspects", none)).otherwise(rule_aspects))
    pick = lambda field, default, rule: F.when(F.col("_ok"), F.coalesce(field, default)).otherwise(rule)
    return d.select(
        *df.columns, pick(F.col("_p.sentiment"), F.lit("NEUTRAL"), F.col("_s.label")).alias("label"),
        pick(conf, F.lit(0.5), F.col("_s.confidence")).alias("confidence"),
        pick(F.col("_p.urgency"), F.lit("LOW"), TX.urgency(text, negative)).alias("urgency"),
        pick(F.col("_p.summary"), F.lit(""), TX.summary_text(F.col("_s.label"), F.col("_s.confidence"), F.size("aspects"))).alias("summary"),
        pick(F.col("_p.key_phrases"), F.array().cast("array<string>"), TX.key_phrases(text)).alias("key_phrases"),
        "aspects", F.when(F.col("_ok"), "model").otherwise(F.lit(scorer or "rules")).alias("scored_by"))


# ---- prompts ---------------------------------------------------------------

def fill_template(template: str, **fields: Column) -> Column:
    """``template`` with each ``{name}`` replaced by that column (null:
    empty); an unknown name is an error."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(fields[p].cast("string"), F.lit(""))
                      for i, p in enumerate(parts)])


def context_line(context: Column) -> Column:
    """The line that tells a model where a text comes from, if known."""
    return F.when(F.coalesce(context, F.lit("")) == "", "").otherwise(
        F.concat(F.lit(L.CONTEXT_LINE[0]), context, F.lit(L.CONTEXT_LINE[1])))


def products_json(hits: DataFrame, qid: str = "query_id", rank: str = "rank") -> DataFrame:
    """Per query, its hits (top-k) as a JSON array in rank order."""
    item = F.struct("product_id", "name", "description", "category")
    rows = F.array_sort(F.collect_list(F.struct(F.col(rank), item.alias("p"))))
    return hits.groupBy(qid).agg(F.to_json(F.transform(rows, lambda r: r["p"])).alias("products_json"))


def latest_per_key(df: DataFrame, key: str, ts: str, tiebreak: str, n: int) -> DataFrame:
    """The ``n`` newest rows per key (planned as a WindowGroupLimit)."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def prompt_table(interactions: DataFrame, key: str = "customer_id", n: int = 10) -> DataFrame:
    """Per customer, ``[YYYY-MM-DD] (TYPE) summary`` lines newest first,
    over the ``n`` latest interactions (bounded per key), newline-joined."""
    last = latest_per_key(interactions, key, "date", "interaction_id", n)
    line = F.format_string("  [%s] (%s) %s", F.substring(F.col("date").cast("string"), 1, 10),
                           F.upper("type"), F.col("summary"))
    rows = last.select(key, F.struct(F.col("date"), F.col("interaction_id"), line.alias("line")).alias("r"))
    agg = rows.groupBy(key).agg(F.sort_array(F.collect_list("r"), asc=False).alias("rs"))
    return agg.select(key, F.array_join(F.col("rs.line"), "\n").alias("interactions_text"),
                      F.size("rs").cast("long").alias("n_lines"))


# ---- keyword search --------------------------------------------------------

def _substrings(token: Column, lengths: Column) -> Column:
    """Distinct substrings of a token that have one of the given lengths."""
    n = F.length(token)
    return F.array_distinct(F.flatten(F.transform(F.filter(lengths, lambda m: m <= n), lambda m: F.transform(
        F.sequence(F.lit(1), n - m + 1), lambda i: F.substring(token, i, m)))))


def keyword_search(catalog: DataFrame, queries: DataFrame, k: int = 5,
                   id_col: str = "product_id", text_col: str = "search_text",
                   qid: str = "query_id", qtext: str = "query") -> DataFrame:
    """score = share of query words (whitespace split, lower case, with
    repeats) found as a substring of the product text; > 0 only; top-k per
    query by score desc then catalogue order; rounded to 3 decimals.

    Exact without pairing every query with every product. A query word (no
    whitespace) is inside a text iff it is a substring of one of its tokens, so
    each distinct token is cut once, into substrings as long as some query
    word, and joined with the distinct query words. Products with the same set
    of query words score alike for every query: they form one class, of which
    the ``k`` first ids suffice. Queries meet classes, never products; a word
    that nearly every product has costs one row per class.
    """
    words = queries.select(qid, TX.whitespace_words(F.lower(qtext)).alias("ws"))
    qw = (words.select(qid, F.size("ws").alias("n_words"), F.explode_outer("ws").alias("w"))
          .where(F.col("w").isNotNull())
          .groupBy(qid, "n_words", "w").agg(F.count(F.lit(1)).alias("mult")))
    wanted = qw.select("w").distinct()
    lengths = wanted.agg(F.collect_set(F.length("w"))).scalar()   # one entry per word length
    tokens = (catalog.select(id_col, F.explode_outer(F.array_distinct(
        TX.whitespace_words(F.lower(text_col)))).alias("tok")).where(F.col("tok").isNotNull()))
    cut = (tokens.select("tok").distinct().withColumn("lengths", lengths)
           .select("tok", F.explode_outer(_substrings(F.col("tok"), F.col("lengths"))).alias("w"))
           .where(F.col("w").isNotNull()).join(wanted, "w", "left_semi")
           .groupBy("tok").agg(F.collect_set("w").alias("found")))   # at most the substrings of one token
    prod = (tokens.join(cut, "tok").groupBy(id_col)
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("ws")))
    first = Window.partitionBy("ws").orderBy(id_col)
    classes = (prod.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
               .groupBy("ws").agg(F.array_sort(F.collect_list(id_col)).alias("ids")))   # k ids
    hits = classes.select("ids", F.explode("ws").alias("w")).join(qw, "w")
    scored = (hits.groupBy(qid, "ids", "n_words").agg(F.sum("mult").alias("found"))
              .withColumn("score", F.col("found") / F.greatest(F.col("n_words"), F.lit(1))))
    # k classes by (score, first id) hold the k best products
    best = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col("ids")[0])
    top = scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), F.col(id_col))
    top = top.select(qid, "score", F.explode("ids").alias(id_col))
    return (top.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            .select(qid, id_col, "rank", F.round("score", 3).alias("similarity_score")))
