import numpy as np
import pytest

from tessera.llm import multi_index as M

SCHEMA = "vec_id long, embedding array<float>, node long, docs int, v string"


def brute(rows, threshold=0.95):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    size = max((len(v) for (_, v), k in zip(rows, ok) if k), default=0)
    x = np.zeros((n, max(size, 1)))
    for i, (_, v) in enumerate(rows):
        if ok[i]:
            w = np.array(v, np.float32).astype(np.float64)
            x[i] = w / np.linalg.norm(w)
    link = x @ x.T >= threshold
    np.fill_diagonal(link, False)
    comp = np.arange(n)
    while True:
        new = np.array([min(comp[i], *comp[link[i]]) if link[i].any() else comp[i] for i in range(n)])
        if (new == comp).all():
            break
        comp = new
    ids = [[rows[j][0] for j in range(n) if comp[j] == comp[i] and rows[j][0] is not None] for i in range(n)]
    return sorted(((rows[i][0], int(link[i].sum()), min(ids[i], default=None)) for i in range(n)), key=str), link


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "clash") for i, v in rows], SCHEMA)


def found(df, **options):
    return sorted((tuple(r) for r in M.similar_vectors(df, **options).collect()), key=str)


def groups(rng, n_groups, low, high, dims, spread):
    out = []
    for _ in range(n_groups):
        c = rng.standard_normal(dims)
        for _ in range(rng.integers(low, high)):
            v = c / np.linalg.norm(c) + spread * rng.standard_normal(dims) / np.sqrt(dims)
            out.append(v * rng.uniform(0.1, 9))
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]


@pytest.mark.parametrize("dims", [32, 7])
def test_against_brute_force(spark, dims):
    rows = groups(np.random.default_rng(dims), 500, 1, 5, dims, 0.15)
    want, link = brute(rows)
    got = found(frame(spark, rows))
    assert len(got) == len(want) and link.sum() > 500
    assert all(g[1] <= w[1] for g, w in zip(sorted(got), sorted(want)))                # no link below the threshold
    assert sum(g[1] for g in got) >= 0.98 * link.sum()


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    x = M.unit(rng.standard_normal((3000, 64)))
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * M.unit(noise)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.concatenate([x, y]))]
    got = found(frame(spark, rows))
    assert 0.9 * 6000 <= sum(g[1] for g in got) <= 6000


def test_one_crowded_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 32)
    rng = np.random.default_rng(9)
    rows = groups(rng, 1, 400, 401, 16, 0.2) + [(1000 + i, v) for i, v in groups(rng, 200, 1, 2, 16, 0.1)]
    want, link = brute(rows)
    got = found(frame(spark, rows))
    assert sum(g[1] for g in got) >= 0.98 * link.sum() and {g[2] for g in got if g[0] < 400 and g[1]} == {0}


def test_odd_rows(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [-4.0, 1.0, 0.0, 0.5]
    rows = [(5, a), (5, a), (3, [2.0, 4.0, 6.0, 8.1]), (None, a), (None, b), (7, None), (8, []), (9, [0.0] * 4), (10, [1.0, None, 2.0, 3.0]),
            (11, [float("nan"), 1.0, 1.0, 1.0]), (12, [float("inf"), 1.0, 1.0, 1.0]), (13, [1.0, 2.0]), (14, [0.0, -0.0, 1.0, 0.0]), (15, [0.0, 0.0, 2.0, -0.0])]
    plain = [(i, v if v is None or len(v) == 4 else None) for i, v in rows]
    assert found(frame(spark, rows)) == brute(plain)[0]
    assert found(frame(spark, [])) == [] and found(frame(spark, [(1, None), (2, [0.0])])) == [(1, 0, 1), (2, 0, 2)]


def test_first_cells_of_the_order():
    rng = np.random.default_rng(4)
    grid = M.Grid(rng.standard_normal((9, 3)), rng.standard_normal((11, 4)), 13)
    x = rng.standard_normal((40, 7))
    d1, d2 = grid.distances(x)
    every = (d1[:, :, None] + d2[:, None, :]).reshape(40, -1)
    assert (np.sort(grid.visited(x), 1) == np.sort(every.argsort(1)[:, :13], 1)).all()
    assert (grid.rank(x, every.argsort(1)[:, 5]) == 5).all()
