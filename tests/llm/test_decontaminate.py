import random
import re

import pytest

from tessera.llm import decontaminate

from tests.llm.conftest import SF

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[s:s + 10]), set()).add(str(i) if i is not None else "null")
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit |= set(range(s, s + n))
                    got |= wins[tuple(w[s:s + n])]
        out.append((str(d), len(w), len(hit), sorted(got)))
    return sorted(out)


def data():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for i in range(15)]
    items += [(99, None), (98, "..."), (3, items[3][1]), (97, items[4][1]), (None, "ZZ Üb yy"), (96, "absent words only here")]
    docs = []
    for d in range(60):
        t = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            w = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 10))
            t += w[a:a + rng.randint(5, 25)] + [rng.choice(vocab)]
        docs.append((d, " ".join(t).upper() if d % 3 == 0 else ", ".join(t)))
    docs += [(100, None), (101, ""), (5, docs[5][1]), (5, docs[5][1]), (None, "zz Üb YY")]
    return docs, items


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_against_brute_force(spark, block_words):
    docs, items = data()
    got = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    rows = decontaminate.report(got.select("*")).count()
    found = sorted((str(r.doc_id), r.n_words, sum(h.e - h.s for h in r.hits), sorted(r["items"])) for r in got.collect())
    assert rows == len(docs) and found == brute(docs, items)


def test_proximity(spark):
    items = [(1, "one two three four five six seven eight nine ten")]
    docs = [(1, "ten nine eight seven six five four three two one"), (2, "one " + "x " * 60 + "two three four five six seven eight nine ten"),
            (3, "one two three four five six seven eight nine ten"), (4, "one two")]
    got = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    near = {r.doc_id: (r["items"], r.near_items) for r in got.collect()}
    assert near[1] == ([], ["1"]) and near[3] == (["1"], ["1"]) and near[4] == ([], [])


def brute_near(docs, items, near=20):
    """Items with the three rarest terms of a window (all present in the
    corpus) within reach of the rarest one, in one document."""
    all_words = [words(t) for _, t in docs]
    count = {}
    for w in all_words:
        for x in w:
            count[x] = count.get(x, 0) + 1
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[s:s + 10]), set()).add(str(i) if i is not None else "null")
    out = []
    for (d, _), w in zip(docs, all_words):
        at, got = {}, set()
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        for win, who in wins.items():
            rare = [x for _, _, x in sorted((count.get(x, 0), o, x) for o, x in enumerate(win))][:3]
            if all(count.get(x, 0) for x in win) and any(
                    all(any(abs(p - r) <= near for p in at.get(x, [])) for x in rare[1:]) for r in at.get(rare[0], [])):
                got |= who
        out.append((str(d), sorted(got)))
    return sorted(out)


def test_proximity_ends_with_the_document(spark):
    items = [(1, "one two three four five six seven eight nine ten"), (2, "red blue green")]
    docs = [(1, "x y z one"), (2, "two three x x x"), (3, "four five six seven eight nine ten x red"), (4, "blue green"), (5, "green x red x blue")]
    frames = (spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted((str(r.doc_id), sorted(r.near_items)) for r in decontaminate.find_matches(*frames).collect())
    assert got == brute_near(docs, items) == [("1", []), ("2", []), ("3", []), ("4", []), ("5", ["2"])]


@pytest.mark.parametrize("block_words", [1_000_000, 20])
def test_proximity_against_brute_force(spark, block_words):
    docs, items = data()
    got = decontaminate.find_matches(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1),
                                     spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert sorted((str(r.doc_id), sorted(r.near_items)) for r in got.collect()) == brute_near(docs, items)


def test_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.report(decontaminate.find_matches(odd, bench)).collect()}
    assert got[5] == 3 and got[0] == 0
    assert decontaminate.find_matches(nothing, bench).count() == 0
    assert decontaminate.find_matches(odd, bench.where("false")).count() == odd.count()


def test_odd_rows_by_joins(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "a b c"), (None, None), (2, "a b c"), (2, "word " * 12)], "item_id long, text string")
    few, many = (decontaminate.report(decontaminate.find_matches(odd, bench, block_rows=n)).collect() for n in (9, 1))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(few, key=key) == sorted(many, key=key) and {r.n_hit for r in many if r.doc_id == 8} == {400}
    assert decontaminate.find_matches(nothing, bench, block_rows=1).count() == 0


def test_joins_equal_broadcast_on_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    few, many = (sorted(decontaminate.report(decontaminate.find_matches(docs, bench, block_rows=n)).collect()) for n in (20_000, 1))
    assert few == many and any(r.contaminated for r in many)
