import collections
import itertools
import random
import re

import pytest

from tessera.llm import jaccard_join

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = W.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets, n = [shingles(t) for _, t in rows], len(rows)
    up, deg = list(range(n)), [0] * n

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            deg[i] += 1
            deg[j] += 1
            up[top(i)] = top(j)
    cls = collections.defaultdict(list)
    for i in range(n):
        cls[top(i)].append(rows[i][0])
    low = {c: min(v, key=lambda x: (x is not None, x or 0)) for c, v in cls.items()}
    return sorted((str(rows[i][0]), str(low[top(i)]), deg[i]) for i in range(n)), len(cls)


def data():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(rng.randint(1, 12)):
            d = list(base)
            for _ in range(rng.randint(0, 4)):
                d[rng.randrange(len(d))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(d)))
    return rows + [(1000, None), (1001, ""), (1002, "..."), (5, rows[5][1]), (5, rows[5][1]), (None, rows[7][1])]


@pytest.mark.parametrize("small", [256, 4])
def test_against_brute_force(spark, small):
    rows = data()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, nth int")
    want, classes = brute(rows)
    got = jaccard_join.similar_documents(df, small=small).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == want
    kept = jaccard_join.keep_one(df, small=small)
    assert kept.columns == df.columns and kept.count() == classes


def test_large_group_in_blocks(spark):
    rng = random.Random(8)
    base = [f"t{i}" for i in range(150)]
    rows = []
    for i in range(600):
        d = list(base)
        d[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(d)))
    want, classes = brute(rows)
    got = jaccard_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), small=32)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got.collect()) == want and classes == 1


def test_runs_reach_the_recall():
    assert jaccard_join.runs_needed(0.9) < jaccard_join.runs_needed(0.995) < 20


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want, classes = brute(rows)
    got = jaccard_join.similar_documents(odd).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == want
    assert jaccard_join.keep_one(odd).count() == classes
    assert jaccard_join.similar_documents(nothing).count() == 0 and jaccard_join.keep_one(nothing).count() == 0
