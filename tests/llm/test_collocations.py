import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import collocations as C


def brute(rows, least, covered=80, top=2000):
    count = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    count[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, f in count.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        hidden = set()
        for p, v in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    if 100 * v >= covered * f[p[i:i + k]]:
                        hidden.add(p[i:i + k])
        got = []
        for p, a in found.items():
            if p not in hidden:
                s, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                got.append((-s, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(got)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in C.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def data():
    rng = random.Random(4)
    vocab = [*"abcdefghij", "Über", "日本", "x" * 300, "#!", "Z'"]
    rows = []
    for i in range(120):
        words = [rng.choice(vocab[:8] if rng.random() < 0.7 else vocab) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n"]) for w in words)
        rows.append((rng.choice(["en", "de", None]), text + rng.choice(["", " the long passage that many of them share ."])))
    return rows + [("en", None), (None, None), ("fr", "...,\n"), rows[0], rows[0]]


@pytest.mark.parametrize("options", [{}, {"bucket": 40}, {"bucket": 5}])
def test_against_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(C, "STRETCH", 3)
    rows = data()
    df = spark.createDataFrame([(*r, 1, 2, "clash", 4) for r in rows], "lang string, text string, id long, size int, word string, w1 int")
    want = brute(rows, 4)
    assert len(want) > 100 and found(df, least=4, **options) == want


def test_first_of_each_language(spark):
    rows = data()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(df, least=3, top=7) == brute(rows, 3, top=7)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert found(odd, least=2) == brute(rows, 2)
    assert found(nothing) == [] and found(odd.where("text is null")) == []


def test_trees_round_trip():
    rng = np.random.default_rng(1)
    g = rng.integers(1, 4, (500, 4)).astype(np.uint64)
    for k in (1, 2, 3):
        g[rng.random(500) < 0.2, k:] = 0
    edges, count, _ = C._merge(g, np.ones(500, np.int64))
    back, n = C.unpack(C.pack(edges, count))
    assert (back == edges).all() and (n == count).all() and count.sum() == 500 and len(edges) < 150


def test_paths_are_the_long_repeats(spark):
    rows = [("en", "one two three four five six seven"), ("en", "zero one two three four five six seven eight")] * 3
    phrases, words = C.graph(spark.createDataFrame(rows, "lang string, text string"), least=3)
    name = {r.key: r.word for r in words.collect()}
    paths = sorted((" ".join(name[w] for w in r.words), list(r.flow)) for r in C.compact(phrases).collect())
    assert paths == [("zero one two three four five six seven eight", [3, 6, 6, 6, 6, 3])]


def test_a_task_holds_one_small_bucket():
    """Four full buckets of one task: memory is that of one, and below 100 MB."""
    import tracemalloc

    import pyarrow as pa

    class Trees:
        def __getattr__(self, name):
            return lambda *a, **k: a[0] if name == "mapInArrow" else self

    g = np.random.default_rng(1).integers(1, 2**63, (C.BUCKET, C.ORDER)).astype(np.uint64)
    blob = C.pack(*C._merge(g, np.ones(len(g), np.int64))[:2])
    hot = np.zeros(C.SLOTS, bool)
    batches = [pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "tree"]) for k in range(4)]
    del g
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in C._flows(Trees(), hot, hot, 4, 1)(iter(batches)))
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
    finally:
        tracemalloc.stop()
    assert rows == 4 * 3 * C.BUCKET
