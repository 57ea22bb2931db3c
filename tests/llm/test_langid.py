import re
from collections import Counter

import numpy as np

from tests.llm.conftest import SF
from tessera.llm import langid
from tessera.llm.common import held_out, table
from pyspark.sql import functions as F


def test_grams_against_brute_force():
    texts = ["Ab c.d", "", "  ", "x", "été 12 É", "a" * 50, "one two  three!!four"]
    row, code, count = langid.grams(texts)
    s = langid.SYMBOLS
    for i, t in enumerate(texts):
        x = " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
        want = Counter(x[k:k + 3] for k in range(len(x) - 2) if x[k + 1] != " ")
        got = {"".join(" " if k == 0 else chr(k) for k in (c // s**2, c // s % s, c % s)): n
               for c, n in zip(code[row == i].tolist(), count[row == i].tolist())}
        assert got == dict(want)


def test_bundle_is_the_sum_of_bound_vectors():
    _, v = langid._tables()
    got = langid.bundle(["ab"])[0]
    want = sum(np.roll(v[a], 2) * np.roll(v[b], 1).astype(int) * v[c] for a, b, c in ((0, 97, 98), (97, 98, 0)))
    assert (got == want).all()


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    model = langid.fit_prototypes(docs.where(~held_out("doc_id", 3, 1)))
    got = langid.predict(docs, model, keep=("doc_id", "lang")).where(held_out("doc_id", 3, 1))
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_odd_rows(spark, odd, nothing):
    model = langid.fit_prototypes(odd)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[3].lang_pred == "und" and got[0].score == 0
    assert got[8].lang_pred == "en" and 0 < got[8].score <= 1
    assert langid.fit_prototypes(nothing) == {} and langid.predict(nothing, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}
