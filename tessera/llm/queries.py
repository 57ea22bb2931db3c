"""Registered queries of the numbered operators, with DuckDB SQL where it can
express them. Each applies its operator to the whole table with the production
parameters and derives the contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (bpe, collocations, decontaminate, jaccard_join, langid, license_scan, multi_index, pii, prefix_trie,
                         quality, repeats, sharding, toxicity)
from tessera.llm.common import held_out, table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids and decoded text of every document, as digests."""
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; prototypes from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.fit_prototypes(docs.where(~held_out("doc_id", 3, 1)))
    found = langid.predict(docs.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "margin")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of repeated 400-byte strings."""
    got = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256",
                      (F.col("n_removed") > 0).alias("has_repeats"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values pseudonymised."""
    got = pii.pseudonymise_table(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), "pii")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases in every document."""
    got = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(got)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    got = jaccard_join.similar_documents(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_shingles", "class_id", "n_links", "set_rows")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition figures and verdicts of every document."""
    got = quality.quality_rules(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted", "evidence")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document; counts per shard at most one apart."""
    got = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return got.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                      F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every vector."""
    got = multi_index.similar_vectors(table(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    got = collocations.collocations(table(spark, sf_dir, "documents"))
    return got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    nodes, ends = prefix_trie.trie(table(spark, sf_dir, "conversations"))
    got = nodes.join(prefix_trie.ends_digest(ends), ["d", "key1", "key2"], "left")
    return got.select("conv_id", F.col("d").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
                      "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
post AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
cf AS (SELECT t, count(*) AS n FROM post GROUP BY t),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[s:s + 9] AS ws FROM (
    SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
wid AS (SELECT row_number() OVER () AS k, ws FROM (SELECT DISTINCT ws FROM win)),
wt AS (SELECT k, unnest(ws) AS t, generate_subscripts(ws, 1) AS o FROM wid),
ranked AS (SELECT k, wt.t, o, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY k ORDER BY coalesce(n, 0), o) AS j
           FROM wt LEFT JOIN cf ON wt.t = cf.t),
live AS (SELECT k FROM ranked GROUP BY k HAVING min(n) > 0),
r1 AS (SELECT k, t, o FROM ranked WHERE j = 1 AND k IN (SELECT k FROM live)),
cand AS (SELECT r1.k, r1.o, post.r, post.p FROM r1 JOIN post ON r1.t = post.t),
exact AS (SELECT c.k, c.r, c.p - c.o + 1 AS s, len(wid.ws) AS l FROM cand c JOIN wid ON wid.k = c.k JOIN d ON d.r = c.r
          WHERE c.p - c.o >= 0 AND d.w[c.p - c.o + 1:c.p - c.o + len(wid.ws)] = wid.ws),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS q FROM exact) GROUP BY r),
near1 AS (SELECT DISTINCT c.k, c.r, c.p FROM cand c LEFT JOIN ranked x ON x.k = c.k AND x.j = 2
          LEFT JOIN post ON post.r = c.r AND post.t = x.t AND post.p BETWEEN c.p - 20 AND c.p + 20
          WHERE x.t IS NULL OR post.p IS NOT NULL),
near2 AS (SELECT DISTINCT c.k, c.r FROM near1 c LEFT JOIN ranked x ON x.k = c.k AND x.j = 3
          LEFT JOIN post ON post.r = c.r AND post.t = x.t AND post.p BETWEEN c.p - 20 AND c.p + 20
          WHERE x.t IS NULL OR post.p IS NOT NULL),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
    SELECT DISTINCT r, item FROM exact JOIN wid USING (k) JOIN win USING (ws)) GROUP BY r),
nit AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, item FROM near2 JOIN wid USING (k) JOIN win USING (ws)) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(nit.n, 0) AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN nit USING (r)
"""

OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT r, w[s:s + 4] AS g FROM (
    SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pair AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT a, b, i = x.n AND i = y.n AS same FROM pair JOIN n x ON x.r = a JOIN n y ON y.r = b
         WHERE i >= 0.8 * (x.n + y.n - i)),
reach AS (SELECT r, r AS m FROM d UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.m),
cls AS (SELECT reach.r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = reach.m GROUP BY reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, class_id, coalesce(l.k, 0) AS n_links, coalesce(l.s, 0) + 1 AS set_rows
FROM d JOIN cls USING (r) LEFT JOIN n USING (r)
LEFT JOIN (SELECT a, count(*) AS k, count(*) FILTER (WHERE same) AS s FROM link GROUP BY a) l ON l.a = d.r
"""


def _op8_sql() -> str:
    def rep(k: int) -> str:
        return f"""g{k} AS (SELECT r, g, count(*) AS n, min(c) AS c, list(s) AS places FROM (
    SELECT r, s, w[s:s + {k - 1}] AS g, list_sum([len(x) FOR x IN w[s:s + {k - 1}]]) AS c FROM (
        SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS s FROM d WHERE len(w) >= {k})) GROUP BY r, g HAVING count(*) > 1)"""

    def cover(k: int) -> str:
        return f"""c{k} AS (SELECT r, count(*) AS n, sum(len(w[q])) AS c FROM (
    SELECT DISTINCT r, unnest(range(s, s + {k})) AS q FROM (SELECT r, unnest(places) AS s FROM g{k})) JOIN d USING (r) GROUP BY r)"""

    def top(k: int) -> str:
        return f"t{k} AS (SELECT r, arg_max(n * c, (n, n * c)) AS c FROM g{k} GROUP BY r)"

    lengths = sorted({*quality.TOP_NGRAM, 3, *quality.DUP_NGRAM})
    parts = [rep(k) for k in lengths] + [cover(k) for k in (3, *quality.DUP_NGRAM)] + [top(k) for k in quality.TOP_NGRAM]
    bad = [f"coalesce(t{k}.c, 0) / greatest(wc, 1) > {v}" for k, v in quality.TOP_NGRAM.items()]
    bad += [f"coalesce(c{k}.c, 0) / greatest(wc, 1) > {v}" for k, v in quality.DUP_NGRAM.items()]
    bad += [f"coalesce(l.dup, 0) / greatest(l.n, 1) > {quality.DUP_LINES}",
            f"coalesce(l.dup_chars, 0) / greatest(l.chars, 1) > {quality.DUP_LINE_CHARS}"]
    joins = " ".join(f"LEFT JOIN {t} USING (r)" for t in [*(f"c{k}" for k in (3, *quality.DUP_NGRAM)), *(f"t{k}" for k in quality.TOP_NGRAM), "l"])
    failed = "n_words < 50 OR 100 * coalesce(c3.n, 0) > 50 * n_words"
    return rf"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d0),
e AS (SELECT r, doc_id, w, len(w) AS n_words, coalesce(list_sum([len(x) FOR x IN w]), 0) AS wc,
      len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS sym FROM d),
lines AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS nth FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE nth > 1) AS dup, sum(len(line)) AS chars,
      sum(len(line)) FILTER (WHERE nth > 1) AS dup_chars FROM lines GROUP BY r),
{', '.join(parts)}
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(sym AS BIGINT) AS n_symbols,
       CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c3.n, 0) AS BIGINT) AS n_repeat_words,
       ({failed}) AS base_failed, NOT (({failed}) OR {' OR '.join(bad)}) AS kept
FROM e {joins}
"""


OP11_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT r, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT r, r AS m FROM v UNION SELECT reach.r, link.b FROM reach JOIN link ON link.a = reach.m),
cls AS (SELECT reach.r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = m GROUP BY reach.r)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN cls USING (r) LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) l ON l.a = v.r
"""

OP12_SQL = rf"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({_LOWER}, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents)),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS ph, count(*) AS f FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
    GROUP BY 1, 2, 3 HAVING count(*) >= 30 OR k = 1),
tot AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, ph, string_split(ph, ' ') AS ws, f FROM g WHERE k > 1),
ask AS MATERIALIZED (SELECT lang, ph, f AS a, x, array_to_string(ws[1:x], ' ') AS lp, array_to_string(ws[x + 1:], ' ') AS rp
        FROM (SELECT *, unnest(range(1, k)) AS x FROM c)),
cut AS (SELECT ask.lang, ask.ph, a, x, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
        FROM ask JOIN g l ON l.lang = ask.lang AND l.ph = lp JOIN g r ON r.lang = ask.lang AND r.ph = rp),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, x) = 1),
cov AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS ph, max(f) AS f FROM (
    SELECT lang, ws, f, j, unnest(range(1, k - j + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS j) WHERE j < k) GROUP BY 1, 2)
SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.ph) AS rank,
       low.ph AS phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM low JOIN tot USING (lang) LEFT JOIN cov ON cov.lang = low.lang AND cov.ph = low.ph
WHERE cov.f IS NULL OR 100::HUGEINT * cov.f < 80::HUGEINT * a
QUALIFY rank <= 2000
"""

OP13_SQL = """
WITH tab AS (SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS v FROM range(256) t(i)),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, [CAST(unicode(x) AS BIGINT) FOR x IN string_split(CAST(c AS VARCHAR), '')]),
      lambda a, x: xor(a >> 8, v[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h FROM ids, tab),
seq AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
full_ AS (SELECT h.c, list_concat(coalesce(b.s, [])[1:h], seq.s[h + 1:]) AS s
          FROM h JOIN seq USING (c) LEFT JOIN seq b ON b.c = h.c - h.c % 100),
pre AS (SELECT c, len(s) AS n, d, s[1:d] AS k FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM full_)),
node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256 FROM pre GROUP BY d, k),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2),
flat AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
below AS (SELECT d2 AS d, k[1:d2] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
          sum((n_convs - 1) * coalesce(len(k[d].t), 0)) AS saved_tokens
          FROM (SELECT *, unnest(range(0, d + 1)) AS d2 FROM flat) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM flat f JOIN below USING (d, k) LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.k[1:f.d - 1]
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_license, op3_langid, op4_repeats, op5_pii, op6_decontaminate, op7_jaccard,
                            op8_quality, op9_toxicity, op10_sharding, op11_near_vectors, op12_collocations, op13_prefix_trie)}
SQL: dict[str, str] = {"op6_decontaminate": OP6_SQL, "op7_jaccard": OP7_SQL, "op8_quality": _op8_sql(),
                       "op11_near_vectors": OP11_SQL, "op12_collocations": OP12_SQL, "op13_prefix_trie": OP13_SQL}
