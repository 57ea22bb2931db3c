"""Hand-computed fixtures for the text rules."""

from pyspark.sql import functions as F

from tessera.functions import text as TX
from tessera.operators import text_ops as TO


def _one(spark, text, col):
    return spark.createDataFrame([(text,)], "t string").select(col.alias("x")).first()["x"]


def test_lexicon_score_word_sets(spark):
    # distinct words: love, great (pos) and bad (neg) → (2 − 1) / 3 = 0.333
    assert float(_one(spark, "I love it, love it! Great but bad", TX.lexicon_score("t"))) == 0.333
    assert float(_one(spark, "nothing here", TX.lexicon_score("t"))) == 0.0
    # substring 'lovely' is not the word 'love'
    assert float(_one(spark, "lovely", TX.lexicon_score("t"))) == 0.0


def test_sentiment_label_rules(spark):
    s = _one(spark, "Love it, amazing and the best", TX.sentiment_label("t"))
    assert s["label"] == "POSITIVE" and abs(s["confidence"] - 0.95) < 1e-12   # 3 hits → min(.95, .95)
    s = _one(spark, "terrible and slow", TX.sentiment_label("t"))
    assert s["label"] == "NEGATIVE" and abs(s["confidence"] - 0.85) < 1e-12
    s = _one(spark, "great but broken", TX.sentiment_label("t"))
    assert s["label"] == "MIXED" and s["confidence"] == 0.72
    s = _one(spark, "plain words", TX.sentiment_label("t"))
    assert s["label"] == "NEUTRAL" and s["confidence"] == 0.60


def test_substring_vs_word(spark):
    # 'thin' is a substring of 'thing': substring count sees it, word score does not
    pos, neg = ("thing",), ("thin",)
    lab = _one(spark, "a thing", TX.sentiment_label("t", pos, neg))
    assert (lab["pos_count"], lab["neg_count"]) == (1, 1)
    assert float(_one(spark, "a thing", TX.lexicon_score("t", pos, neg))) == 1.0


def test_aspects(spark):
    a = _one(spark, "Great quality, fast shipping", TX.aspects("t"))
    # 'fast' hits shipping; 'great' positive only → POSITIVE, base + .05
    assert [(x["aspect"], x["sentiment"], x["score"]) for x in a] == [
        ("product quality", "POSITIVE", 0.9), ("shipping speed", "POSITIVE", 0.83)]
    a = _one(spark, "broken box", TX.aspects("t"))
    assert [(x["aspect"], x["sentiment"], x["score"]) for x in a] == [("packaging", "NEGATIVE", 0.4)]
    a = _one(spark, "nothing to see", TX.aspects("t"))
    assert [(x["aspect"], x["sentiment"], x["score"]) for x in a] == [("overall experience", "NEUTRAL", 0.6)]


def test_urgency(spark):
    assert _one(spark, "I want a refund", TX.urgency("t")) == "CRITICAL"
    assert _one(spark, "terrible awful horrible", TX.urgency("t")) == "CRITICAL"
    assert _one(spark, "terrible awful", TX.urgency("t")) == "HIGH"
    assert _one(spark, "formal complaint", TX.urgency("t")) == "HIGH"
    assert _one(spark, "slow", TX.urgency("t")) == "MEDIUM"
    assert _one(spark, "fine", TX.urgency("t")) == "LOW"


def test_key_phrases(spark):
    text = "The delivery was late, but the support team fixed it!"
    # words: 10 → starts 0,2,4 (< min(8,6)); strip end punctuation; keep > 5 chars
    assert _one(spark, text, TX.key_phrases("t")) == ["The delivery was", "was late, but", "but the support"]
    assert _one(spark, "too short", TX.key_phrases("t")) == []
    assert _one(spark, "a b c d", TX.key_phrases("t")) == []        # 'a b c' has 5 chars


def test_tokenize(spark):
    assert _one(spark, 'Hello, "World"! (x) [y]', TX.tokenize("t")) == ["hello", "world", "x", "y"]


def test_strip_fence_and_parse(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    df = spark.createDataFrame([("```json\n{\"k\": 5}\n```",), ('{"k": 7}',), ('{"k": 7',)], "t string")
    got = df.select(TO.parse_reply("t", schema).alias("r")).collect()
    assert [(r.r.k, r.r.error) for r in got] == [(5, None), (7, None), (None, "Failed to parse response")]


def test_summary_and_route(spark):
    s = _one(spark, "x", TX.summary_text(F.lit("POSITIVE"), F.lit(0.85), F.lit(2)))
    assert s == "Positive sentiment detected with 85% confidence across 2 aspect(s)."
    assert _one(spark, "x", TX.route(F.lit("POSITIVE"), F.lit(0.96))) == "local"
    assert _one(spark, "x", TX.route(F.lit("POSITIVE"), F.lit(0.95))) == "premium"


def test_stats_zero_filled_and_mode(spark):
    df = spark.createDataFrame([(1, "love it"), (2, "love it great quality"), (3, "terrible quality")],
                               "id long, text string").withColumn("b", F.lit(1))
    scored = TO.score_texts(df, "text")
    st = TO.sentiment_stats(scored, ["b"]).first()
    assert (st["n_positive"], st["n_negative"], st["n_neutral"], st["n_mixed"]) == (2, 1, 0, 0)
    asp = {r["aspect"]: r for r in TO.aspect_stats(scored, ["b"]).collect()}
    q = asp["product quality"]
    assert q["mentions"] == 2 and q["dominant_sentiment"] == "NEGATIVE"   # tie 1–1 → alphabetical


def test_replies_and_named_scorer(spark):
    from tessera.functions import scorers
    scorers.register_scorer("loud", lambda c: F.struct(F.when(F.upper(c) == c, "POSITIVE").otherwise("NEGATIVE").alias("label"),
                                                       F.lit(0.8).alias("confidence")))
    df = spark.createDataFrame([
        (1, "LOVE IT", '\n```json\n{"sentiment": "MIXED", "confidence": 0.4}\n```'), (2, "LOVE IT", "{}"),
        (3, "LOVE IT", '{"sentiment": "GLAD"}'), (4, "awful", "[1]"), (5, "awful", '{"confidence": "high"}'), (6, None, None)],
        "id long, t string, reply string")

    def rows(scorer):
        return {r["id"]: (r["label"], r["confidence"], r["scored_by"]) for r in TO.analyse_replies(df, "reply", "t", scorer=scorer).collect()}
    got = rows(None)
    assert got[1] == ("MIXED", 0.4, "model") and got[2] == ("NEUTRAL", 0.5, "model")
    assert got[3] == ("POSITIVE", 0.75, "rules")
    assert got[4][0] == got[5][0] == "NEGATIVE" and got[4][2] == got[5][2] == got[6][2] == "rules"
    assert rows("loud")[4][:2] == ("NEGATIVE", 0.8)
    assert rows("unheard of")[3][:2] == ("POSITIVE", 0.75)
    scored = {r["id"]: r["label"] for r in TO.score_texts(df.where("id in (3, 4)"), "t", scorer="loud").collect()}
    assert scored == {3: "POSITIVE", 4: "NEGATIVE"}


def test_template_needs_known_names(spark):
    import pytest
    row = _one(spark, None, TO.fill_template("a {x}{y} b", x=F.col("t"), y=F.lit(2)))
    assert row == "a 2 b"
    with pytest.raises(KeyError):
        TO.fill_template("{z}")
