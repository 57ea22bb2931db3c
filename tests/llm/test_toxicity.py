import numpy as np
import pyarrow as pa

from tests.llm.conftest import SF
from pyspark.sql import functions as F
from corpus_pipeline import drop_toxic
from tessera.llm import bytescan as B
from tessera.llm import toxicity
from tessera.llm.common import held_out, table


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    x = np.where(rng.random((500, 40)) < 0.1, rng.random((500, 40)), 0).astype(np.float32)
    x = x[x.any(1)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.where(rng.random((60, 40)) < 0.15, rng.random((60, 40)), 0).astype(np.float32)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    sim, who = toxicity.BlockMaxIndex(x).nearest(q, 7)
    want = np.sort(np.maximum(np.round((q @ x.T).astype(float), 5), 0), axis=1)[:, ::-1][:, :7]
    assert np.allclose(sim, want, atol=2e-5)
    for i in range(len(q)):
        ok = who[i] >= 0
        assert np.allclose((q[i] @ x[who[i][ok]].T), sim[i][ok], atol=2e-5)


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert (np.diff(y) >= 0).all() and np.interp(0.25, x, y) == 0.5 and np.interp(0.4, x, y) == 1


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where(held_out("doc_id", 4, 2))
    r = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("acc"), F.min("score"), F.max("score")).first()
    assert r["acc"] > 0.9 and 0 <= r[1] <= r[2] <= 1


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 1, 9), (5, 1, 0, 9), (8, None, None, 9), (None, 1, 1, 9)], "doc_id long, quality int, toxic int, text int")
    model = toxicity.fit(odd, labels, min_rows=1, min_z=0.0)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    empty = toxicity.fit(nothing, labels)
    assert {r.score for r in toxicity.score(odd, empty).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0


def test_index_of_common_and_rare_terms_is_exact():
    rng = np.random.default_rng(3)
    p = np.concatenate([np.full(30, 0.3), np.full(1500, 0.004)])        # rare ones in two of 500 examples
    x, q = (np.where(rng.random((n, 1530)) < p, rng.random((n, 1530)), 0).astype(np.float32) for n in (500, 90))
    x, q = (a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9) for a in (x, q))
    index = toxicity.BlockMaxIndex(x)
    assert 0 < index.x.shape[1] < 100 and len(index.who)
    sim, who = index.nearest(q, 16)
    want = np.sort((q @ x.T).astype(float), axis=1)[:, ::-1][:, :16]
    assert np.allclose(sim, want, atol=2e-5) and np.allclose((q[:, None] * x[who]).sum(2), sim, atol=2e-5)


def test_every_term_is_in_the_vectors(spark):
    docs = spark.createDataFrame([(i, f"plain{i % 7} river{i} hill") for i in range(40)] + [(50, "an awful word")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, 0) for i in range(40)] + [(50, 1)], "doc_id long, toxic int"))
    ids = {int(i): k for k, i in enumerate(model.ids)}
    words = [f"river{i}" for i in ids if i < 40] + ["hill", "awful"] * (50 in ids)
    ptr, _, n = toxicity.term_rows(*B.flat(pa.array(words)))
    rows = toxicity.weighted(*toxicity.term_rows(*B.flat(pa.array(words))), model.vocab, model.term_weight)
    assert (np.diff(rows.ptr) == np.diff(ptr)).all() and (rows.val > 0).all() and len(words) > 25


def test_stage_drops_toxic_rows_of_a_small_table(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = {r.doc_id for r in drop_toxic(spark, docs, SF).select("doc_id").collect()}
    lab = {r.doc_id: r.toxic for r in labels.collect()}
    gone = [lab[r.doc_id] for r in docs.select("doc_id").collect() if r.doc_id not in kept and r.doc_id in lab]
    assert sum(gone) >= 6 and sum(gone) >= 0.6 * len(gone)


def test_sample_is_bounded_in_bytes(spark):
    rows = spark.createDataFrame([(i, i % 2, "x" * (100 if i % 5 else 2000)) for i in range(200)] + [(None, 1, None)],
                                 "__id long, __y int, __text string")
    got = toxicity.within_bytes(rows, {1: 3200, 0: 10_000}).collect()
    size = {y: sum(len(r["__text"] or "") for r in got if r["__y"] == y) for y in (0, 1)}
    assert size[1] == 3200 and size[0] == 8000 and {len(r["__text"]) for r in got if r["__text"]} == {100}
    assert toxicity.within_bytes(rows, {1: 1 << 30, 0: 1 << 30}).count() == 201
    docs = spark.createDataFrame([(i, f"good words {i} " * 20) for i in range(60)] + [(99, "awful " * 5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(60)] + [(99, 1)], "doc_id long, toxic int")
    assert len(toxicity.fit(docs, labels, sample_bytes=0).ids) == 0
    assert 0 < len(toxicity.fit(docs, labels, sample_bytes=9000).ids) < len(toxicity.fit(docs, labels).ids)
