"""Stages against brute-force decisions, and the queries that have SQL."""
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.conftest import SF
from tests.llm import test_decontaminate, test_jaccard_join
from tessera.llm import pii
from tessera.llm.common import table
from tessera.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_stages_on_the_table(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "duplicates", "decontamination", "pii", "bpe"]
    a = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert a.columns == docs.columns and 0 < a.count() <= docs.count() and a.subtract(docs).isEmpty()
    b = corpus_pipeline.drop_near_duplicates(spark, a, SF)
    rows = [(r.doc_id, r.text) for r in a.collect()]
    _, classes = test_jaccard_join.brute(rows)
    assert b.columns == docs.columns and b.count() == classes and b.subtract(a).isEmpty()
    c = corpus_pipeline.drop_contaminated(spark, b, SF)
    left = [(r.doc_id, r.text) for r in b.collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    clean = {r[0] for r in test_decontaminate.brute(left, items) if not r[3]}
    assert c.columns == docs.columns and {str(r.doc_id) for r in c.collect()} == clean
    d = corpus_pipeline.hide_personal(spark, c, SF)
    text = {r.doc_id: r.text for r in c.collect()}
    net = pii.Feistel(pii.DEMO_KEY)
    for r in d.collect():
        want, found = pii.pseudonymise(text[r.doc_id], net.permute)
        assert r.text == want and (not found or r.n_chars == len(want))
    e = corpus_pipeline.encode(spark, d, SF)
    assert e.count() == d.count() and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(e.columns)


def test_run_and_entry(spark):
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark, odd, nothing):
    for df in (odd, nothing):
        cur = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            nxt = stage(spark, cur, SF)
            assert nxt.count() <= cur.count()
            if k + 1 < len(corpus_pipeline.STAGES):
                assert nxt.columns == cur.columns
            cur = nxt


def test_columns_named_like_the_stages_own_survive(spark, docs):
    own = ("__text_in", "__k1", "__K2", "__pii")
    df = docs.limit(60).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in own})
    for stage in (corpus_pipeline.drop_contaminated, corpus_pipeline.hide_personal):
        got = stage(spark, df, SF)
        assert got.columns == df.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in got.collect() for c in own)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    at = [names.index(c) for c in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
