import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import listrank, prefix_trie

COLS = "conv_id long, turn long, role string, text string, d int, key1 long, n string"


def brute(rows):
    seq = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            seq[c].append((t is not None, t or 0, role or "", text or ""))
    seq = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in seq.items()}
    full = {}
    for c, own in seq.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        full[c] = tuple(seq.get(base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    out = []
    for k, m in members.items():
        kids = [x for x in members if len(x) == len(k) + 1 and x[:len(k)] == k]
        below = [x for x in members if x[:len(k)] == k]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:len(x)] == x for y in below)]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(full[c]) == len(k)))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids), len(leaves),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    nodes, ends = prefix_trie.trie(df)
    got = nodes.join(prefix_trie.ends_digest(ends), ["d", "key1", "key2"], "left").select(
        "conv_id", "d", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
    return sorted((tuple(r) for r in got.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], COLS)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 40), *range(200, 215), -7, -100, -105, 305, 2**62]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "hello ü", "", "why?"])))
    assert found(frame(spark, rows)) == brute(rows)


def test_one_conversation_and_one_parent_hold_most_rows(spark):
    rows = [(1, t, "user", f"t{t % 3}") for t in range(400)] + [(c, 0, "user", f"start {c}") for c in range(1000, 1300)]
    assert found(frame(spark, rows)) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None, None, None), (5, None, None, None), (5, 0, "b", "x" * 5000), (5, 0, "a", "z"), (None, 1, "user", "lost"),
            (0, 2, "user", "日本"), (0, 1, None, "first"), (7, 3, "user", None), (105, 1, "user", "no base")]
    assert found(frame(spark, rows)) == brute(rows)
    assert found(frame(spark, [])) == []


@pytest.mark.parametrize("local", [listrank.LOCAL, 20])
def test_prefix_sums(spark, monkeypatch, local):
    monkeypatch.setattr(listrank, "LOCAL", local)
    monkeypatch.setattr(listrank, "RULER", 4)
    ids = random.Random(1).sample(range(10_000), 300)
    rows = [(a, b, a % 7) for a, b in zip(ids, [None, *ids])]
    got = {r.id: r.w for r in listrank.prefix_sums(spark.createDataFrame(rows, "id long, prev long, w long"), ["w"]).collect()}
    want, total = {}, 0
    for a in ids:
        total += a % 7
        want[a] = total
    assert got == want


def test_chains_and_rings(spark):
    rows = [(1, None), (2, 1), (3, 2), (10, None), (20, 23), (21, 20), (22, 21), (23, 22), (30, 30), (41, 40), (40, 42), (42, 41)]
    rows += [(100 + i, 99 + i if i else None) for i in range(40)]
    got = {r.id: (r.head, r.rank) for r in listrank.chains(spark.createDataFrame(rows, "id long, prev long")).collect()}
    want = {1: (1, 0), 2: (1, 1), 3: (1, 2), 10: (10, 0), 20: (20, 0), 21: (20, 1), 22: (20, 2), 23: (20, 3), 30: (30, 0),
            40: (40, 0), 41: (40, 1), 42: (40, 2 - 0)}
    want.update({100 + i: (100, i) for i in range(40)})
    assert got == want
