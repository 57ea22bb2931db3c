import zlib
from collections import Counter, defaultdict

from tessera.llm import sharding


def check(df, shards):
    got = sharding.shard_documents(df, shards).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    n = Counter(r.shard for r in got)
    assert set(n) <= set(range(shards)) and max(n.values()) - min(n.get(s, 0) for s in range(shards)) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((str(r.id), r.size, r.crc) for r in got) == want
    return got


def test_groups_stay_together_as_far_as_they_fit(spark):
    rows, d = [], 0
    for g in range(40):
        for _ in range(2 + g % 7):
            rows.append((d, f"group {g}"))
            d += 1
    rows += [(1000 + i, f"single {i}") for i in range(300)] + [(5000 + i, "hot") for i in range(200)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 16)
    text = dict(rows)
    where = defaultdict(set)
    for r in got:
        where[text[r.id]].add(r.shard)
    together = sum(len(s) == 1 for t, s in where.items() if t.startswith("group"))
    assert together >= 38 and len(where["hot"]) <= 8


def cut_pairs(parts):
    return sum((sum(p) ** 2 - sum(x * x for x in p)) // 2 for p in parts)


def test_a_table_made_of_copies_is_cut_like_a_greedy_packing(spark):
    sizes = [900] + [60] * 39 + [1] * 60
    rows = [(g * 1000 + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 16)
    parts = defaultdict(Counter)
    for r in got:
        parts[r.id // 1000][r.shard] += 1
    free, greedy = [sum(sizes) // 16] * 16, []
    for n in sizes:                              # largest first, whole where it fits, else into the roomiest
        p = []
        while n:
            fits = [s for s in range(16) if free[s] >= n]
            s = min(fits, key=lambda s: free[s]) if fits else max(range(16), key=lambda s: free[s])
            take = max(1, min(n, free[s]))
            p.append(take)
            free[s] -= take
            n -= take
        greedy.append(p)
    assert cut_pairs(p.values() for p in parts.values()) <= 1.1 * cut_pairs(greedy)
    assert sum(len(parts[g]) == 1 for g in range(1, 40)) >= 33


def test_a_large_refused_group_does_not_hold_up_smaller_ones(spark):
    sizes = [70, 70, 50] + [6] * 8
    rows = [(g * 1000 + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    parts = defaultdict(set)
    for r in got:
        parts[r.id // 1000].add(r.shard)
    # 79 places a shard: 70 + 6, 70 + 6 and 50 + 4 x 6 fit, two groups of 6 do not
    assert sum(len(p) == 1 for p in parts.values()) >= 9


def test_no_python_on_executors(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    plan = sharding.shard_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_odd_rows(odd, nothing):
    check(odd, 16)
    check(odd, 3)
    assert sharding.shard_documents(nothing).count() == 0
