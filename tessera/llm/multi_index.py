"""Near-duplicate vectors from an inverted multi-index.

Each half of the (unit) vectors has a codebook of its own; the pair of nearest
centroids is a vector's cell in the product grid. A vector asks the cells that
the multi-sequence order visits first, nearest sum of half distances first. How
many it asks is set before, on the sample the codebooks come from: so many that
``recall`` of vectors moved to a cosine of just ``threshold`` are met. Of two
vectors in different cells the one of the smaller cell asks, so a pair is met
once at most. What meets is verified by cosine in double precision.

Codebooks (``SAMPLE`` vectors) and the number of visits (``PROBES`` of them) are
fitted on a bounded sample; every vector is indexed and asks. Equal vectors are
one entry. A cell's members and visitors are compared in blocks of ``BLOCK``, a
task per pair of blocks, so a crowded cell is many small tasks; tasks give link
counts and a spanning forest, never pairs. Counting the links of k different
near copies takes k * k / 2 products.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and vectors of another length than most, link with nothing. Equal
rows link with each other. The smallest id of a class ignores null ids; a class
of null ids alone has a null component. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, staged
from tessera.llm.jaccard_join import _forest, _groups

THRESHOLD = 0.95
RECALL = 0.99
SAMPLE = 1 << 14
PROBES = 1 << 11
CELL = 24              # vectors in a cell, on average
MOST = 512             # centroids of a codebook at most
BLOCK = 512


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one (by their largest component first, so that
    no square overflows)."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def rows_of(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Grid:
    """The two codebooks, and the cells that a vector visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.books, self.visits = (first, second), visits

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        h = self.books[0].shape[1]
        return [(p * p).sum(1)[:, None] - 2 * p @ c.T + (c * c).sum(1) for p, c in zip((x[:, :h], x[:, h:]), self.books)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(1) for d in self.distances(x))
        return a * len(self.books[1]) + b

    def visited(self, x: np.ndarray) -> np.ndarray:
        """The first ``visits`` cells of the multi-sequence order of each row. A
        cell of ranks (a, b) comes after the (a + 1) * (b + 1) - 1 cells of
        smaller ranks, so only cells with (a + 1) * (b + 1) <= visits can be
        among them."""
        d1, d2 = self.distances(x)
        t = min(self.visits, d1.shape[1] * d2.shape[1])
        a, b = (g.ravel() for g in np.mgrid[:min(t, d1.shape[1]), :min(t, d2.shape[1])])
        near = (a + 1) * (b + 1) <= t
        a, b = a[near], b[near]
        o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
        total = np.take_along_axis(d1, o1, 1)[:, a] + np.take_along_axis(d2, o2, 1)[:, b]
        first = total.argsort(1, kind="stable")[:, :t]
        return np.take_along_axis(o1, a[first], 1) * len(self.books[1]) + np.take_along_axis(o2, b[first], 1)

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells come before ``cell`` in the order of each row."""
        d1, d2 = self.distances(x)
        i, j = cell // len(self.books[1]), cell % len(self.books[1])
        at = np.arange(len(x))
        total = d1[at, i] + d2[at, j]
        d2 = np.sort(d2, 1)
        return np.array([np.searchsorted(d2[k], total[k] - d1[k] - 1e-9).sum() for k in at])


def fit(nodes: DataFrame, n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Grid:
    """Codebooks and number of visits, on a sample. ``nodes``: node, v."""
    some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(max(1, -(-n // SAMPLE)))) == 0).limit(2 * SAMPLE)
    dims = nodes.select(F.size("v")).first()[0]
    half = dims // 2
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    some = staged(some.select("v", F.transform("v", lambda x: x.cast("double") / size).alias("u")).where(size > 0).coalesce(2), "sample")
    k = int(min(MOST, max(2, math.isqrt(n // CELL))))
    books = []
    for part in ((F.slice("u", 1, half), half), (F.slice("u", half + 1, dims - half), dims - half)):
        if part[1] == 0:
            books.append(np.zeros((1, 0)))
            continue
        model = KMeans(k=k, seed=7, maxIter=8, initSteps=1, featuresCol="h").fit(some.select(array_to_vector(part[0]).alias("h")))
        books.append(np.array(model.clusterCenters()))
    grid = Grid(*books)
    x = unit(rows_of(some.limit(PROBES).select("u").toArrow().column(0)))
    noise = np.random.default_rng(5).standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    moved = threshold * x + math.sqrt(1 - threshold**2) * noise
    grid.visits = int(np.quantile(grid.rank(x, grid.cells(moved)), recall, method="higher")) + 1
    return grid


def _visits(nodes: DataFrame, grid: Grid, vectors: bool) -> DataFrame:
    """cell, member, and node, docs, v of every visit; or their counts."""
    kind = nodes.schema["v"].dataType.simpleString()
    schema = f"cell int, member boolean, node long, docs long, v {kind}" if vectors else "cell int, members long, visitors long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_cells = len(grid.books[0]) * len(grid.books[1])
        count = np.zeros((2, n_cells), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = unit(rows_of(part.column(2)))
                own, cells = grid.cells(x), grid.visited(x)
                row, at = np.nonzero(cells > own[:, None])
                asked = cells[row, at]
                if not vectors:
                    count[0] += np.bincount(own, minlength=n_cells)
                    count[1] += np.bincount(asked, minlength=n_cells)
                    continue
                take = pa.array(np.concatenate([np.arange(len(x)), row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([own, asked]).astype(np.int32)), pa.array(np.arange(len(take)) < len(x)),
                     *(part.column(c).take(take) for c in range(3))], ["cell", "member", "node", "docs", "v"])
        if not vectors:
            at = np.flatnonzero(count.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[0, at]), pa.array(count[1, at])], ["cell", "members", "visitors"])

    return nodes.select("node", "docs", "v").mapInArrow(run, schema)


def compare(nodes: DataFrame, grid: Grid, threshold: float) -> DataFrame:
    """node, links (rows linked with it) and b (its forest edge), per task."""
    cells = _visits(nodes, grid, False).groupBy("cell").agg(F.sum("members").alias("members"), F.sum("visitors").alias("visitors"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    cells = staged(cells.where("members > 0 and members + visitors > 1").select("cell", blocks("members").alias("nb"), blocks("visitors").alias("qb")), "cells")
    # at most MOST * MOST cells
    rows = _visits(nodes, grid, True).join(F.broadcast(cells), "cell")
    own = F.when(F.col("member"), F.pmod(F.xxhash64("node"), "nb")).otherwise(F.col("nb") + F.pmod(F.xxhash64("node"), "qb")).cast("int")
    rows = rows.withColumn("own", own).withColumn("o", F.explode(F.when(
        F.col("member"), F.sequence(F.lit(0), F.col("nb") + F.col("qb") - 1)).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))))
    rows = rows.select("cell", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), F.col("own").alias("side"), "node", "docs", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(batches, 3):
            i_, j_, side, node, docs = (t.column(c).to_numpy() for c in (1, 2, 3, 4, 5))
            x = unit(rows_of(t.column(6)))
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                if i_[a] == j_[a]:
                    p = q = np.arange(a, b)
                else:
                    p, q = a + np.flatnonzero(side[a:b] == i_[a]), a + np.flatnonzero(side[a:b] == j_[a])
                link = x[p] @ x[q].T >= threshold
                if i_[a] == j_[a]:
                    np.fill_diagonal(link, False)
                if not link.any():
                    continue
                r, c = np.nonzero(link)
                label = _forest(p[r] - a, q[c] - a, int(b - a))
                links = np.zeros(b - a, np.int64)
                links[p - a] = link @ docs[q]
                if i_[a] != j_[a]:
                    links[q - a] = docs[p] @ link
                at = np.flatnonzero(links)
                out.append((node[a:b][at], links[at], node[a:b][label[at]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links", "b"])

    return rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "node").mapInArrow(run, "node long, links long, b long")


def _usable(dims: int) -> Column:
    return (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """One row per vector: id, n_links, component (smallest id of its class)."""
    base = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v"))
    most = base.where("size(v) > 0").groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    alone = base.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if most is None:
        return alone
    ok = F.coalesce(_usable(most.dims), F.lit(False))
    plus = F.transform("v", lambda x: x + 0)                        # no negative zeros
    keyed = base.where(ok).select("id", F.xxhash64(plus).alias("k1"), F.xxhash64(F.lit("second"), plus).alias("k2"), "v")
    nodes = keyed.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.min("id").alias("low"), F.first("v").alias("v"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")
    n = nodes.count()
    if not n:
        return alone
    grid = fit(nodes, n, threshold, recall)
    found = staged(compare(nodes, grid, threshold), "vector_links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("node <> b").select(F.col("node").alias("a"), "b"))
    info = nodes.select("node", "k1", "k2", "docs", "low").join(links, "node", "left").join(classes, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    info = staged(info, "vector_info")
    info = info.join(info.groupBy("root").agg(F.min("low").alias("component")), "root").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"), "component")
    return keyed.join(info, ["k1", "k2"]).select("id", "n_links", "component").unionAll(
        base.where(~ok).select("id", F.lit(0).cast("long"), "id"))
