"""Text rules as native Column expressions (no Python UDFs).

Everything here compiles to JVM expressions (regex, higher-order array
functions, ``when`` chains), so it runs inside Spark's generated code on
whole documents of any length.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, functions as F

from tessera.functions import lexicons as L

# Unicode word characters: letters, digits, underscore. Same set in Spark
# (Java regex) and DuckDB (RE2), unlike ``\w`` whose meaning differs.
WORD_RE = r"[\p{L}\p{N}_]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _arr(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_tokens(col) -> Column:
    """All Unicode words of the lower-cased text (with repeats)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD_RE), 0)


def lexicon_hits(tokens: Column, words: Sequence[str]) -> Column:
    """Number of distinct lexicon words present in ``tokens``."""
    return F.size(F.array_intersect(tokens, _arr(words)))


def lexicon_score(col, positive: Sequence[str] = L.MART_POSITIVE,
                  negative: Sequence[str] = L.MART_NEGATIVE) -> Column:
    """(pos − neg) / (pos + neg) over distinct words, 3 decimals, 0 if none.

    Returned as DECIMAL(6,3) so that later sums are exact in any engine.
    """
    toks = word_tokens(col)
    pos, neg = lexicon_hits(toks, positive), lexicon_hits(toks, negative)
    tot = pos + neg
    return (F.when(tot > 0, F.round((pos - neg).cast("double") / tot, 3))
            .otherwise(F.lit(0.0)).cast("decimal(6,3)"))


def substring_count(lower_text: Column, words: Sequence[str]) -> Column:
    """How many lexicon entries occur anywhere in the (lower-cased) text."""
    acc = F.lit(0)
    for w in words:
        acc = acc + F.when(lower_text.contains(w.lower()), 1).otherwise(0)
    return acc


def _low(col, lowered: bool) -> Column:
    return _c(col) if lowered else F.lower(_c(col))


def sentiment_label(col, positive=L.RULE_POSITIVE, negative=L.RULE_NEGATIVE,
                    lowered: bool = False) -> Column:
    """struct(label, confidence, pos_count, neg_count) by substring rules.

    ``lowered=True`` when ``col`` is already lower case (callers materialise
    ``lower(text)`` once per row and share it between rules)."""
    low = _low(col, lowered)
    pos, neg = substring_count(low, positive), substring_count(low, negative)
    conf_pos = F.least(F.lit(0.95).cast("decimal(4,2)"),
                       (F.lit(0.65).cast("decimal(4,2)") + pos * F.lit(0.1).cast("decimal(4,2)")))
    conf_neg = F.least(F.lit(0.95).cast("decimal(4,2)"),
                       (F.lit(0.65).cast("decimal(4,2)") + neg * F.lit(0.1).cast("decimal(4,2)")))
    label = (F.when(pos > neg, "POSITIVE").when(neg > pos, "NEGATIVE")
             .when((pos > 0) & (neg > 0), "MIXED").otherwise("NEUTRAL"))
    conf = (F.when(pos > neg, conf_pos).when(neg > pos, conf_neg)
            .when((pos > 0) & (neg > 0), F.lit(0.72)).otherwise(F.lit(0.60)))
    return F.struct(label.alias("label"), conf.cast("double").alias("confidence"),
                    pos.alias("pos_count"), neg.alias("neg_count"))


def aspects(col, groups=L.ASPECT_GROUPS, positive=L.RULE_POSITIVE,
            negative=L.RULE_NEGATIVE, lowered: bool = False) -> Column:
    """array<struct<aspect, sentiment, score>> in group order.

    Positive-only text: min(.95, base + .05); negative-only: max(.15, base − .30);
    otherwise MIXED at base. No group matched → one 'overall experience' entry
    carrying the T2 label and its confidence (2 decimals).
    """
    low = _low(col, lowered)
    any_pos = substring_count(low, positive) > 0
    any_neg = substring_count(low, negative) > 0
    label = (F.when(any_pos & ~any_neg, "POSITIVE")
             .when(any_neg & ~any_pos, "NEGATIVE").otherwise("MIXED"))
    entries = []
    for name, keywords, base in groups:
        hit = F.lit(False)
        for kw in keywords:
            hit = hit | low.contains(kw)
        score = (F.when(any_pos & ~any_neg, min(0.95, round(base + 0.05, 2)))
                 .when(any_neg & ~any_pos, max(0.15, round(base - 0.30, 2)))
                 .otherwise(base))
        entries.append(F.when(hit, F.struct(F.lit(name).alias("aspect"),
                                            label.alias("sentiment"),
                                            F.round(score, 2).cast("double").alias("score"))))
    found = F.filter(F.array(*entries), lambda x: x.isNotNull())
    overall = sentiment_label(low, positive, negative, lowered=True)
    fallback = F.array(F.struct(F.lit("overall experience").alias("aspect"),
                                overall["label"].alias("sentiment"),
                                F.round(overall["confidence"], 2).alias("score")))
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def entities(col, names: Sequence[str] = L.PRODUCT_ENTITIES, lowered: bool = False) -> Column:
    """T4: dictionary names found case-insensitively (all typed PRODUCT)."""
    low = _low(col, lowered)
    return F.filter(_arr(names), lambda n: low.contains(F.lower(n)))


def urgency(col, negative=L.RULE_NEGATIVE, lowered: bool = False) -> Column:
    """T5: CRITICAL / HIGH / MEDIUM / LOW from negative hits and escalation terms."""
    low = _low(col, lowered)
    neg = substring_count(low, negative)
    crit = F.lit(False)
    for t in L.CRITICAL_TERMS:
        crit = crit | low.contains(t)
    high = F.lit(False)
    for t in L.HIGH_TERMS:
        high = high | low.contains(t)
    return (F.when((neg >= 3) | crit, "CRITICAL").when((neg >= 2) | high, "HIGH")
            .when(neg >= 1, "MEDIUM").otherwise("LOW"))


def whitespace_words(col) -> Column:
    """Python ``str.split()`` semantics: runs of whitespace, no empty items."""
    return F.array_remove(F.split(_c(col), r"\s+"), "")


def key_phrases(col, strip: str = L.PHRASE_STRIP, words: Column | None = None) -> Column:
    """3-word shingles at word 0, 2, 4 (start < min(n−2, 6)), end
    punctuation stripped, kept when longer than 5 characters (≤ 5 phrases).

    Pass ``words`` (a materialised ``whitespace_words`` column) to split each
    document once instead of once per use inside the array lambdas."""
    words = whitespace_words(col) if words is None else words
    n = F.size(words)
    cls = "[" + "".join("\\" + ch for ch in strip) + "]+"
    strip_re = f"^{cls}|{cls}$"
    last = F.least(n - 2, F.lit(6)) - 1  # inclusive upper start
    starts = F.when(n > 3, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(2)))
    starts = F.filter(starts, lambda i: i <= last)
    phrases = F.transform(starts, lambda i: F.regexp_replace(
        F.array_join(F.slice(words, i + 1, 3), " "), strip_re, ""))
    kept = F.filter(phrases, lambda p: F.length(p) > 5)
    return F.coalesce(F.slice(kept, 1, 5), F.array().cast("array<string>"))


def tokenize(col, punctuation: str = L.TOKEN_PUNCTUATION) -> Column:
    """Punctuation → space, lower case, whitespace split, drop empties."""
    spaced = F.translate(_c(col), punctuation, " " * len(punctuation))
    return whitespace_words(F.lower(spaced))


def summary_text(label: Column, confidence: Column, n_aspects: Column) -> Column:
    """T16: '<Label> sentiment detected with NN% confidence across K aspect(s).'"""
    title = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 100)))
    pct = F.round(confidence * 100, 0).cast("int").cast("string")
    return F.concat(title, F.lit(" sentiment detected with "), pct,
                    F.lit("% confidence across "), n_aspects.cast("string"),
                    F.lit(" aspect(s)."))


def source_text(col, n: int = 200) -> Column:
    """Stored copy of the scored text, first ``n`` characters."""
    return F.substring(_c(col), 1, n)


def index_text(name, description, category, tags) -> Column:
    """T15: '<name> - <description> Category: <c> Tags: a, b'."""
    return F.concat(_c(name), F.lit(" - "), _c(description), F.lit(" Category: "),
                    _c(category), F.lit(" Tags: "), F.array_join(_c(tags), ", "))


def strip_code_fence(col) -> Column:
    """Drop a leading ``` line and a trailing ``` line, after trimming."""
    t = F.regexp_replace(_c(col), r"^\s+|\s+$", "")
    body = F.regexp_replace(t, r"^```[^\n]*(\n|$)", "")
    body = F.regexp_replace(body, r"\n[ \t]*```[ \t]*$", "")
    return F.when(t.startswith("```"), body).otherwise(t)


def route(label: Column, confidence: Column, threshold: float = 0.95) -> Column:
    """Confident pure positives stay local, the rest go to the premium model."""
    return F.when((label == "POSITIVE") & (confidence > threshold), "local").otherwise("premium")
