"""Removed bytes against a brute-force count of all windows."""
import collections
import hashlib
import random

import pytest

from tessera.llm import repeats


def brute(rows, w):
    data = [(t or "").encode() for _, t in rows]
    c = collections.Counter(b[i:i + w] for b in data for i in range(len(b) - w + 1))
    out = []
    for (d, _), b in zip(rows, data):
        m = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if c[b[i:i + w]] > 1:
                m[i:i + w] = b"\1" * w
        runs = sum(1 for i in range(len(b)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((str(d), len(b), sum(m), runs, hashlib.sha256(bytes(x for x, f in zip(b, m) if not f)).hexdigest()))
    return sorted(out)


def cases():
    rng = random.Random(9)

    def rnd(n, al="abcdefgh é\n"):
        return "".join(rng.choice(al) for _ in range(n))

    shared = [rnd(rng.choice([399, 400, 401, 420, 700, 1500])) for _ in range(10)]
    rows = []
    for i in range(50):
        t = rnd(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            p, a = rng.choice(shared), rng.randint(0, 200)
            t += p[a if rng.random() < 0.5 else 0:] + rnd(rng.randint(0, 100))
        rows.append((i, t))
    edge = [(200, "a" * 1000), (201, "ab" * 700), (202, None), (203, ""), (204, rows[3][1]), (204, rows[3][1]), (None, rows[4][1]),
            (205, "x" * 399), (206, "x" * 400), (207, "x" * 400)]
    u = rnd(900)
    return [rows + edge, [(1, u), (1, u), (2, None)], [(1, u), (2, u[:399])], [(1, u[:450] + u[:450])]]


@pytest.mark.parametrize("rows", cases())
def test_against_brute_force(spark, rows):
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute(rows, 400)


def test_other_window_and_long_row(spark, monkeypatch):
    rng = random.Random(4)
    p = "".join(rng.choice("abcd") for _ in range(300))
    rows = [(i, "".join(rng.choice("abcd") for _ in range(50)) + p[i:] * (1 + i % 2)) for i in range(12)]
    monkeypatch.setattr(repeats.B, "PIECE", 200)     # driver-side helpers only: texts longer than a piece
    import numpy as np
    import pyarrow as pa
    for _, t in rows:
        data, off = repeats.B.flat(pa.array([t]))
        _, a, first, last, _ = repeats.anchors(data, off, 64, 16)
        starts = np.concatenate([np.arange(x, y + 1) for x, y in zip(first, last)])
        assert sorted(starts.tolist()) == list(range(len(t) - 63))
        assert all(x <= q <= x + 48 for q, x in zip(a, last))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=64, gram=16, sizes=(16, 4)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute(rows, 64)


def test_odd_rows(odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = repeats.remove_repeats(odd).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got) == brute(rows, 400)
    assert repeats.remove_repeats(nothing).count() == 0
