"""Text queries: lexicon scoring, rule sentiment, aspects, phrases, tokens,
vocabulary, encoding, reply parsing, prompts, keyword search, batch stats."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tessera.functions import lexicons as L
from tessera.functions import text as TX
from tessera.operators import text_ops as TO
from tessera.plans.catalog import query
from tessera.sources import Tables
from tessera.sources import views as V
from tessera.sources.views import with_views

POS, NEG = L.DRIVER_POSITIVE, L.DRIVER_NEGATIVE
# Event-log lexicon for the interaction trend: purchases and sign-ups read as
# positive, errors as negative.
EVENT_POS, EVENT_NEG = ("purchase", "signup"), ("error",)
VOCAB_N = 5000


# ---- DuckDB expression generators (oracle side) ---------------------------

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_count(low: str, words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({low}, {_q(w.lower())}) THEN 1 ELSE 0 END"
                            for w in words) + ")"


def sql_any(low: str, words) -> str:
    return "(" + " OR ".join(f"contains({low}, {_q(w)})" for w in words) + ")"


def sql_label(low: str, pos=POS, neg=NEG) -> tuple[str, str]:
    p, n = sql_count(low, pos), sql_count(low, neg)
    label = (f"CASE WHEN {p} > {n} THEN 'POSITIVE' WHEN {n} > {p} THEN 'NEGATIVE' "
             f"WHEN {p} > 0 AND {n} > 0 THEN 'MIXED' ELSE 'NEUTRAL' END")
    conf = (f"CAST(CASE WHEN {p} > {n} THEN least(0.95, 0.65 + {p} * 0.1) "
            f"WHEN {n} > {p} THEN least(0.95, 0.65 + {n} * 0.1) "
            f"WHEN {p} > 0 AND {n} > 0 THEN 0.72 ELSE 0.60 END AS DOUBLE)")
    return label, conf


def sql_urgency(low: str, neg=NEG) -> str:
    n = sql_count(low, neg)
    crit = sql_any(low, L.CRITICAL_TERMS)
    high = sql_any(low, L.HIGH_TERMS)
    return (f"CASE WHEN {n} >= 3 OR {crit} THEN 'CRITICAL' WHEN {n} >= 2 OR {high} THEN 'HIGH' "
            f"WHEN {n} >= 1 THEN 'MEDIUM' ELSE 'LOW' END")


def sql_aspect_rows(src: str, key: str, low: str, pos=POS, neg=NEG) -> str:
    """(key, ord, aspect, sentiment, score) rows, one per matched group, plus
    the 'overall experience' fallback row."""
    ap, an = f"({sql_count(low, pos)} > 0)", f"({sql_count(low, neg)} > 0)"
    sent = (f"CASE WHEN {ap} AND NOT {an} THEN 'POSITIVE' WHEN {an} AND NOT {ap} THEN 'NEGATIVE' "
            f"ELSE 'MIXED' END")
    parts, hits = [], []
    for i, (name, kws, base) in enumerate(L.ASPECT_GROUPS):
        hit = sql_any(low, kws)
        hits.append(hit)
        score = (f"CASE WHEN {ap} AND NOT {an} THEN {min(0.95, round(base + 0.05, 2))} "
                 f"WHEN {an} AND NOT {ap} THEN {max(0.15, round(base - 0.30, 2))} ELSE {base} END")
        parts.append(f"SELECT {key}, {i} AS ord, {_q(name)} AS aspect, {sent} AS sentiment, "
                     f"CAST(round({score}, 2) AS DOUBLE) AS score FROM {src} WHERE {hit}")
    label, conf = sql_label(low, pos, neg)
    parts.append(f"SELECT {key}, 99 AS ord, 'overall experience', {label}, round({conf}, 2) "
                 f"FROM {src} WHERE NOT ({' OR '.join(hits)})")
    return "\nUNION ALL ".join(parts)


WS_WORDS = "list_filter(string_split_regex({c}, '\\s+'), lambda x: x <> '')"
PUNCT = L.TOKEN_PUNCTUATION


def sql_tokens(c: str) -> str:
    spaced = f"translate({c}, {_q(PUNCT)}, {_q(' ' * len(PUNCT))})"
    return WS_WORDS.format(c=f"lower({spaced})")


DOCS_LOW = "(SELECT doc_id, text, source, lower(text) AS low FROM documents)"


def scored_docs(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text", "source")
    return TO.score_texts(d, "text", POS, NEG)


# ---- T1 / U6 -----------------------------------------------------------------

@query("t1_lexicon_score", sql=f"""
    SELECT review_id, CAST(CAST(CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 3) ELSE 0 END AS DECIMAL(6,3)) AS DOUBLE) AS sentiment_score,
           p AS pos_words, n AS neg_words
    FROM (SELECT review_id,
                 len(list_intersect(list_distinct(w), {list(POS)})) AS p,
                 len(list_intersect(list_distinct(w), {list(NEG)})) AS n
          FROM (SELECT review_id, regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_]+') AS w
                FROM ({V.VIEW_SQL['reviews']})))""")
def q_t1(spark, sf):
    r = V.reviews(Tables(spark, sf))
    toks = TX.word_tokens("body")
    return r.select("review_id",
                    TX.lexicon_score("body", POS, NEG).cast("double").alias("sentiment_score"),
                    TX.lexicon_hits(toks, POS).cast("long").alias("pos_words"),
                    TX.lexicon_hits(toks, NEG).cast("long").alias("neg_words"))


# ---- T2 / T5 / T13 / T16 -------------------------------------------------------

_LBL, _CONF = sql_label("low")


@query("t2_sentiment_label", bench=True, sql=f"""
    SELECT doc_id, {_LBL} AS label, {_CONF} AS confidence FROM {DOCS_LOW}""")
def q_t2(spark, sf):
    d = Tables(spark, sf).documents
    s = TX.sentiment_label("text", POS, NEG)
    return d.select("doc_id", s["label"].alias("label"), s["confidence"].alias("confidence"))


@query("t5_urgency", sql=f"SELECT doc_id, {sql_urgency('low')} AS urgency FROM {DOCS_LOW}")
def q_t5(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", TX.urgency("text", NEG).alias("urgency"))


@query("t13_confidence_route", sql=f"""
    SELECT doc_id, CASE WHEN label = 'POSITIVE' AND confidence > 0.9 THEN 'local' ELSE 'premium' END AS route
    FROM (SELECT doc_id, {_LBL} AS label, {_CONF} AS confidence FROM {DOCS_LOW})""")
def q_t13(spark, sf):
    d = Tables(spark, sf).documents
    s = TX.sentiment_label("text", POS, NEG)
    return d.select("doc_id", TX.route(s["label"], s["confidence"], 0.9).alias("route"))


_ASPECT_SQL = sql_aspect_rows(DOCS_LOW, "doc_id", "low")


@query("t16_summary_text", sql=f"""
    SELECT d.doc_id,
           upper(substring(label, 1, 1)) || lower(substring(label, 2)) || ' sentiment detected with '
           || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '% confidence across '
           || CAST(a.n AS VARCHAR) || ' aspect(s).' AS summary,
           substring(d.text, 1, 200) AS source_text
    FROM (SELECT doc_id, text, {_LBL} AS label, {_CONF} AS confidence FROM {DOCS_LOW}) d
    JOIN (SELECT doc_id, COUNT(*) AS n FROM ({_ASPECT_SQL}) GROUP BY doc_id) a ON d.doc_id = a.doc_id""")
def q_t16(spark, sf):
    return scored_docs(spark, sf).select("doc_id", "summary", "source_text")


# ---- T3 / F5 / T4 / T6 ---------------------------------------------------------

@query("t3_aspects", sql=f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos, aspect, sentiment, score
    FROM ({_ASPECT_SQL})""")
def q_t3(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", F.lower("text").alias("low"))
    d = TO.with_aspect_flags(d, "low", L.ASPECT_GROUPS, POS, NEG).select("doc_id", TO.aspects_from_flags().alias("a"))
    ex = d.select("doc_id", F.posexplode_outer("a").alias("pos", "x")).where(F.col("x").isNotNull())
    return ex.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("x.aspect").alias("aspect"),
                     F.col("x.sentiment").alias("sentiment"), F.col("x.score").alias("score"))


#: the driver's prose names no product: two of its words stand in, in capitals
ENTITIES = (*L.PRODUCT_ENTITIES, "Attion", "EROR")


@query("t4_entities", sql=" UNION ALL ".join(
    f"SELECT doc_id, {_q(n)} AS name, 'PRODUCT' AS type FROM documents WHERE contains(lower(text), {_q(n.lower())})"
    for n in ENTITIES))
def q_t4(spark, sf):
    d = Tables(spark, sf).documents
    return (d.select("doc_id", F.explode_outer(TX.entities("text", ENTITIES)).alias("name")).where(F.col("name").isNotNull())
             .withColumn("type", F.lit("PRODUCT")))


_PHRASE = ("regexp_replace(array_to_string(w[{i} + 1:{i} + 3], ' '), "
           "'^[.,!?;:]+|[.,!?;:]+$', '', 'g')")


@query("t6_key_phrases", sql=f"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, phrase FROM (
      SELECT doc_id, i, phrase FROM (
        {" UNION ALL ".join(
            f"SELECT doc_id, {i} AS i, len(w) AS n, {_PHRASE.format(i=i)} AS phrase FROM (SELECT doc_id, {WS_WORDS.format(c='text')} AS w FROM documents)"
            for i in (0, 2, 4))})
      WHERE n > 3 AND i < least(n - 2, 6) AND length(phrase) > 5)""")
def q_t6(spark, sf):
    d = (Tables(spark, sf).documents.select("doc_id", TX.whitespace_words("text").alias("w"))
         .select("doc_id", TX.key_phrases(None, words=F.col("w")).alias("kp")))
    ex = d.select("doc_id", F.posexplode_outer("kp").alias("pos", "phrase")).where(F.col("phrase").isNotNull())
    return ex.withColumn("pos", (F.col("pos") + 1).cast("long"))


# ---- T7 / T8 / K6 / T9 -------------------------------------------------------

@query("t7_tokenize", sql=f"""
    SELECT doc_id, len(tk) AS n_tokens, len(list_distinct(tk)) AS n_distinct
    FROM (SELECT doc_id, {sql_tokens('text')} AS tk FROM documents)""")
def q_t7(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", TX.tokenize("text").alias("tk"))
    return d.select("doc_id", F.size("tk").cast("long").alias("n_tokens"),
                    F.size(F.array_distinct("tk")).cast("long").alias("n_distinct"))


VOCAB_SQL = f"""
    SELECT token, freq, row_number() OVER (ORDER BY freq DESC, token) AS idx FROM (
      SELECT token, COUNT(*) AS freq FROM (SELECT unnest({sql_tokens('text')}) AS token FROM documents)
      GROUP BY token ORDER BY freq DESC, token LIMIT {VOCAB_N})"""


@query("t8_build_vocab", sql=VOCAB_SQL, bench=True)
def q_t8(spark, sf):
    return TO.build_vocab(Tables(spark, sf).documents, "text", VOCAB_N)


@query("t9_encode", sql=f"""
    WITH vocab AS ({VOCAB_SQL}),
    toks AS (SELECT doc_id, unnest(tk) AS token, unnest(range(len(tk))) AS pos
             FROM (SELECT doc_id, {sql_tokens('text')} AS tk FROM documents))
    SELECT doc_id, list(CAST(COALESCE(v.idx, 0) AS BIGINT) ORDER BY pos) AS ids
    FROM toks LEFT JOIN vocab v ON toks.token = v.token GROUP BY doc_id""")
def q_t9(spark, sf):
    d = Tables(spark, sf).documents
    return TO.encode(d, "doc_id", "text", TO.build_vocab(d, "text", VOCAB_N))


# ---- T11 -----------------------------------------------------------------------

REPLY_SCHEMA = T.StructType([T.StructField("k", T.IntegerType())])


@query("t11_parse_reply", sql=with_views("""
    SELECT event_id, CASE WHEN ok THEN CAST(json_extract_string(body, '$.k') AS INTEGER) END AS k,
           CASE WHEN ok THEN NULL ELSE 'Failed to parse response' END AS error,
           CASE WHEN ok THEN NULL ELSE substring(body, 1, 500) END AS raw
    FROM (SELECT event_id, body, COALESCE(json_valid(body), false) AS ok FROM (
      SELECT event_id,
             CASE WHEN starts_with(trim(reply), '```')
                  THEN regexp_replace(regexp_replace(trim(reply), '^```[^\\n]*(\\n|$)', ''), '\\n[ \\t]*```[ \\t]*$', '')
                  ELSE trim(reply) END AS body
      FROM model_replies))""", "model_replies"))
def q_t11(spark, sf):
    r = V.model_replies(Tables(spark, sf))
    p = TO.parse_reply("reply", REPLY_SCHEMA)
    return r.select("event_id", p["k"].alias("k"), p["error"].alias("error"), p["raw"].alias("raw"))


_FULL = """'{"sentiment":"POSITIVE","confidence":0.9,"urgency":"HIGH","summary":"' || coalesce(source, '') || '","aspects":[{"aspect":"a","sentiment":"MIXED","score":0.5}]}'"""
#: replies of every kind, made from the documents: whole, fenced after an empty
#: line, without most fields, unknown label, cut off, an error report
REPLIES = f"""CASE doc_id % 6 WHEN 0 THEN {_FULL} WHEN 1 THEN chr(10) || '```json' || chr(10) || {_FULL} || chr(10) || '```'
              WHEN 2 THEN '{{"summary":"short"}}' WHEN 3 THEN '{{"sentiment":"GLAD"}}'
              WHEN 4 THEN substring({_FULL}, 1, 40) ELSE '{{"error":"quota"}}' END"""


@query("t11_scored_replies", sql=f"""
    SELECT d.doc_id, CASE WHEN k < 2 THEN 'POSITIVE' WHEN k = 2 THEN 'NEUTRAL' ELSE label END AS label,
           CASE WHEN k < 2 THEN 0.9 WHEN k = 2 THEN 0.5 ELSE confidence END AS confidence,
           CASE WHEN k < 2 THEN 'HIGH' WHEN k = 2 THEN 'LOW' ELSE urgency END AS urgency,
           CASE WHEN k < 2 THEN coalesce(source, '') WHEN k = 2 THEN 'short' ELSE
                upper(substring(label, 1, 1)) || lower(substring(label, 2)) || ' sentiment detected with '
                || CAST(CAST(round(confidence * 100) AS INTEGER) AS VARCHAR) || '% confidence across '
                || CAST(a.n AS VARCHAR) || ' aspect(s).' END AS summary,
           CASE WHEN k < 2 THEN 1 WHEN k = 2 THEN 0 ELSE a.n END AS n_aspects,
           CASE WHEN k <= 2 THEN 'model' ELSE 'rules' END AS scored_by
    FROM (SELECT doc_id, source, doc_id % 6 AS k, {_LBL} AS label, {_CONF} AS confidence, {sql_urgency('low')} AS urgency FROM {DOCS_LOW}) d
    JOIN (SELECT doc_id, COUNT(*) AS n FROM ({_ASPECT_SQL}) GROUP BY doc_id) a ON d.doc_id = a.doc_id""")
def q_t11_scored(spark, sf):
    d = Tables(spark, sf).documents.select("doc_id", "text", "source").withColumn("reply", F.expr(REPLIES))
    got = TO.analyse_replies(d, "reply", "text", POS, NEG)
    return got.select("doc_id", "label", "confidence", "urgency", "summary", F.size("aspects").cast("long").alias("n_aspects"), "scored_by")


@query("t3_aspect_confidence", sql=f"SELECT doc_id, aspect, sentiment, score, score AS confidence FROM ({_ASPECT_SQL})")
def q_t3_conf(spark, sf):
    """The second aspect list of a scored text: its confidence is the score."""
    d = Tables(spark, sf).documents.select("doc_id", F.lower("text").alias("low"))
    d = TO.with_aspect_flags(d, "low", L.ASPECT_GROUPS, POS, NEG).select("doc_id", TO.aspects_from_flags().alias("a"))
    ex = d.select("doc_id", F.explode_outer("a").alias("x")).where(F.col("x").isNotNull())
    return ex.select("doc_id", "x.aspect", "x.sentiment", "x.score", F.col("x.score").alias("confidence"))


# ---- T12 / K2 ----------------------------------------------------------------

@query("t12_prompt_table", sql=with_views("""
    SELECT customer_id, string_agg(line, chr(10) ORDER BY date DESC, interaction_id DESC) AS interactions_text,
           COUNT(*) AS n_lines
    FROM (SELECT customer_id, date, interaction_id,
                 '  [' || strftime(date, '%Y-%m-%d') || '] (' || upper(type) || ') ' || summary AS line,
                 row_number() OVER (PARTITION BY customer_id ORDER BY date DESC, interaction_id DESC) AS rn
          FROM interactions) WHERE rn <= 10 GROUP BY customer_id""", "interactions"))
def q_t12(spark, sf):
    return TO.prompt_table(V.interactions(Tables(spark, sf)), "customer_id", 10)


ANALYSIS = "{context}Label this text: {text}"


@query("t12_analysis_prompt", sql="""
    SELECT doc_id, CASE WHEN coalesce(source, '') = '' THEN '' ELSE 'BUSINESS CONTEXT: This is a ' || source || '.' || chr(10) END
           || 'Label this text: ' || coalesce(text, '') AS prompt FROM documents""")
def q_t12_analysis(spark, sf):
    d = Tables(spark, sf).documents
    return d.select("doc_id", TO.fill_template(ANALYSIS, context=TO.context_line(F.col("source")), text=F.col("text")).alias("prompt"))


PERSONA = "{name} ({customer_id}), {segment}, {tenure} months\n{interactions}"


@query("t12_persona_prompt", sql=with_views("""
    SELECT p.customer_id, coalesce(p.name, 'Unknown') || ' (' || CAST(p.customer_id AS VARCHAR) || '), ' || coalesce(p.segment, 'Unknown') || ', '
           || CAST(coalesce(p.tenure_months, 0) AS VARCHAR) || ' months' || chr(10) || coalesce(i.t, '') AS prompt
    FROM profiles p LEFT JOIN (
      SELECT customer_id, string_agg(line, chr(10) ORDER BY date DESC, interaction_id DESC) AS t
      FROM (SELECT customer_id, date, interaction_id,
                   '  [' || strftime(date, '%Y-%m-%d') || '] (' || upper(type) || ') ' || summary AS line,
                   row_number() OVER (PARTITION BY customer_id ORDER BY date DESC, interaction_id DESC) AS rn
            FROM interactions) WHERE rn <= 10 GROUP BY customer_id) i USING (customer_id)""", "profiles", "interactions"))
def q_t12_persona(spark, sf):
    """Profile header fields, then the newest interactions (none: empty)."""
    t = Tables(spark, sf)
    p = V.profiles(t).join(TO.prompt_table(V.interactions(t), "customer_id", 10), "customer_id", "left")
    return p.select("customer_id", TO.fill_template(
        PERSONA, name=F.coalesce("name", F.lit("Unknown")), customer_id=F.col("customer_id"),
        segment=F.coalesce("segment", F.lit("Unknown")), tenure=F.coalesce("tenure_months", F.lit(0)),
        interactions=F.col("interactions_text")).alias("prompt"))


@query("k2_recent_50", sql=with_views("""
    SELECT interaction_id, customer_id, type, date FROM interactions
    ORDER BY date DESC, interaction_id DESC LIMIT 50""", "interactions"))
def q_k2(spark, sf):
    i = V.interactions(Tables(spark, sf)).select("interaction_id", "customer_id", "type", "date")
    return TO.recent(i, "date", "interaction_id", 50)


# ---- T14 / T15 ------------------------------------------------------------------

@query("t15_index_text", sql=with_views("""
    SELECT product_id, name || ' - ' || description || ' Category: ' || category || ' Tags: '
           || array_to_string(tags, ', ') AS index_text FROM catalog""", "catalog"))
def q_t15(spark, sf):
    c = V.catalog(Tables(spark, sf))
    return c.select("product_id", TX.index_text("name", "description", "category", "tags").alias("index_text"))


@query("t14_keyword_search", bench=True, sql=with_views(f"""
    SELECT query_id, product_id, rank, round(score, 3) AS similarity_score FROM (
      SELECT query_id, product_id, score,
             row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank
      FROM (SELECT q.query_id, c.product_id, CAST(COUNT(*) AS DOUBLE) / greatest(max(q.n), 1) AS score
            FROM (SELECT query_id, len(ws) AS n, unnest(ws) AS w
                  FROM (SELECT item_id AS query_id, {WS_WORDS.format(c='lower(text)')} AS ws FROM benchmark)) q
            JOIN (SELECT product_id, lower(search_text) AS st FROM catalog) c ON contains(c.st, q.w)
            GROUP BY q.query_id, c.product_id))
    WHERE rank <= 5""", "catalog"))
def q_t14(spark, sf):
    t = Tables(spark, sf)
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return TO.keyword_search(V.catalog(t), queries, k=5)


# ---- A4 / F4 / K7 / A10 ------------------------------------------------------------

@query("a4_sentiment_stats", bench=True, sql=f"""
    SELECT source, COUNT(*) AS total,
           {", ".join(f"COUNT(*) FILTER (WHERE label = '{x}') AS n_{x.lower()}" for x in TO.LABELS)},
           {", ".join(f"COUNT(*) FILTER (WHERE urgency = '{x}') AS urgency_{x.lower()}" for x in TO.URGENCIES)},
           CAST(floor((SUM(CAST(round(confidence * 100) AS BIGINT)) * 2000 + COUNT(*) * 100) / (COUNT(*) * 200)) / 1000 AS DOUBLE) AS avg_confidence
    FROM (SELECT source, {_LBL} AS label, {_CONF} AS confidence, {sql_urgency('low')} AS urgency FROM {DOCS_LOW})
    GROUP BY source""")
def q_a4(spark, sf):
    return TO.sentiment_stats(scored_docs(spark, sf), ["source"])


@query("a4_aspect_stats", sql=f"""
    SELECT source, aspect,
           CAST(floor((SUM(s) * 200 + SUM(c) * 100) / (SUM(c) * 200)) / 100 AS DOUBLE) AS avg_score,
           CAST(SUM(c) AS BIGINT) AS mentions,
           arg_min(sentiment, (-c, sentiment)) AS dominant_sentiment
    FROM (SELECT d.source, a.aspect, a.sentiment, COUNT(*) AS c, SUM(CAST(round(a.score * 100) AS BIGINT)) AS s
          FROM ({_ASPECT_SQL}) a JOIN documents d ON a.doc_id = d.doc_id
          GROUP BY d.source, a.aspect, a.sentiment)
    GROUP BY source, aspect""")
def q_a4_aspects(spark, sf):
    return TO.aspect_stats(scored_docs(spark, sf), ["source"])


@query("k7_aspects_by_mentions", sql=f"""
    SELECT aspect, mentions, row_number() OVER (ORDER BY mentions DESC, aspect) AS position
    FROM (SELECT aspect, COUNT(*) AS mentions FROM ({_ASPECT_SQL}) GROUP BY aspect)""")
def q_k7(spark, sf):
    return TO.by_mentions(TO.aspect_stats(scored_docs(spark, sf), [])).select("aspect", "mentions", "position")


_EV_LBL, _ = sql_label("lower(summary)", EVENT_POS, EVENT_NEG)


@query("a10_daily_trend", sql=with_views(f"""
    SELECT CAST(date AS DATE) AS date,
           {", ".join(f"COUNT(*) FILTER (WHERE label = '{x}') AS {x.lower()}" for x in TO.LABELS)},
           CAST(SUM(score) AS DOUBLE) / COUNT(score) AS avg_score
    FROM (SELECT date, {_EV_LBL} AS label,
                 CAST(CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 3) ELSE 0 END AS DECIMAL(10,3)) AS score
          FROM (SELECT date, summary,
                       len(list_intersect(list_distinct(w), {list(EVENT_POS)})) AS p,
                       len(list_intersect(list_distinct(w), {list(EVENT_NEG)})) AS n
                FROM (SELECT date, summary, regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{N}}_]+') AS w
                      FROM interactions)))
    GROUP BY CAST(date AS DATE)""", "interactions"))
def q_a10(spark, sf):
    i = V.interactions(Tables(spark, sf))
    s = TX.sentiment_label("summary", EVENT_POS, EVENT_NEG)
    scored = i.select("date", s["label"].alias("label"),
                      TX.lexicon_score("summary", EVENT_POS, EVENT_NEG).alias("score"))
    return TO.daily_trend(scored, "date", "score")


@query("k6_top_tokens", sql=f"""
    SELECT token, COUNT(*) AS freq FROM (SELECT unnest({sql_tokens('text')}) AS token FROM documents)
    GROUP BY token ORDER BY freq DESC, token LIMIT 20""")
def q_k6(spark, sf):
    """Top-20 tokens by (−frequency, token): a top-k sort (each task keeps 20)."""
    return TO.build_vocab(Tables(spark, sf).documents, "text", 20).select("token", "freq")
