"""V4: inverted-file index with product codes, stored as tables.

``build_index`` learns two things from a bounded sample: coarse cells (spherical
k-means) and, per group of dimensions, a small codebook. Every item is then
written once, filed under its nearest cell, with its product code (one byte per
group) and its vector. A cell with more than ``CELL_ROWS`` items is split into
blocks of about that size.

``search`` sends a query to its nearest cells only. There, items are scored by
table look-ups on their codes; the vectors of the best ``rerank`` items per query
are read and compared exactly. The number of cells asked is learned with the
index: so many that ``target`` of the sample's true neighbours lie in them.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tessera.operators.vectors import cosine

SAMPLE = 1 << 14       # vectors that codebooks are learned from, about
TRIALS = 256           # of them used as queries to learn the number of probes
CODES = 64             # centroids per group of dimensions
GROUP_DIMS = 2         # dimensions per group
CELL_ROWS = 4096       # items in a block of a cell
MAX_CELLS = 1024
STRIP = 1 << 21        # code look-ups held at a time


@dataclasses.dataclass(frozen=True)
class VectorIndex:
    """Handle of a stored index. ``cells`` and ``books`` are bounded (at most
    ``MAX_CELLS`` centroids, ``CODES`` per group) and travel to the tasks."""
    path: str
    probes: int
    cells: np.ndarray
    books: np.ndarray      # group, code, dimension

    def items(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/items")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _lloyd(x: np.ndarray, k: int, spherical: bool, rounds: int = 12, seed: int = 3) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if spherical:
            c = _unit(c)
    return c


def _subvectors(x: np.ndarray, groups: int) -> np.ndarray:
    """(rows, groups, GROUP_DIMS), the last group filled up with zeros."""
    pad = groups * GROUP_DIMS - x.shape[1]
    return np.pad(x, ((0, 0), (0, pad))).reshape(len(x), groups, GROUP_DIMS)


def _codes(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    sub, out = _subvectors(x, len(books)), np.zeros((len(x), len(books)), np.uint8)
    for g, book in enumerate(books):
        out[:, g] = ((book * book).sum(1) - 2 * sub[:, g] @ book.T).argmin(1)
    return out


def build_index(items: DataFrame, path: str, item_id: str = "item_id", vec: str = "vec", k: int = 10,
                target: float = 0.97) -> VectorIndex:
    """Learn codebooks and write the index under ``path`` (a shared folder).
    Null and zero vectors are not indexed."""
    spark = items.sparkSession
    v = items.select(F.col(item_id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    v = v.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    n, dims = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_cells, groups = int(min(MAX_CELLS, max(1, math.isqrt(n)))), max(1, -(-(dims or 1) // GROUP_DIMS))
    some = v.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // SAMPLE)))) == 0)
    # group -1 learns the cells and the probes, every other group one codebook: a task each, of one bounded sample
    parts = some.select("v", F.explode(F.sequence(F.lit(-1), F.lit(groups - 1))).alias("g"))
    schema = "g int, c int, centroid array<double>, probes int"

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = _unit(_matrix(rows["v"]))
        g, probes = int(key[0]), 0
        if g >= 0:
            book = _lloyd(_subvectors(x, groups)[:, g], CODES, False)
        else:
            book = _lloyd(x, n_cells, True)
            q = x[:: max(1, len(x) // TRIALS)]
            near = (q @ x.T).argsort(1)[:, ::-1][:, : k + 1]
            place = (q @ book.T).argsort(1)[:, ::-1].argsort(1)           # rank of each cell for each query
            cell = (x @ book.T).argmax(1)
            probes = int(np.quantile(np.take_along_axis(place, cell[near], 1), target, method="higher")) + 1
        return pd.DataFrame({"g": g, "c": range(len(book)), "centroid": list(book), "probes": probes})

    learned = parts.groupBy("g").applyInPandas(learn, schema)
    learned.write.mode("overwrite").parquet(f"{path}/books")
    got = spark.read.parquet(f"{path}/books").toPandas().sort_values(["g", "c"])      # at most MAX_CELLS + groups * CODES rows
    if got.empty:
        index = VectorIndex(path, 0, np.zeros((0, 0)), np.zeros((0, 0, GROUP_DIMS)))
    else:
        width = got[got.g == 0].c.max() + 1
        index = VectorIndex(path, int(got.probes.max()), _matrix(got[got.g < 0].centroid),
                            _matrix(got[got.g >= 0].centroid).reshape(groups, width, GROUP_DIMS))
    cells, books = index.cells, index.books
    filed_schema = T.StructType([T.StructField("id", items.schema[item_id].dataType), T.StructField("cell", T.IntegerType()),
                                 T.StructField("code", T.BinaryType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def file(batches):
        for b in batches:
            if len(b):
                x = _unit(_matrix(b["v"]))
                yield pd.DataFrame({"id": b["id"], "cell": (x @ cells.T).argmax(1).astype("int32"),
                                    "code": [r.tobytes() for r in _codes(x, books)], "v": list(x)})

    filed = v.mapInPandas(file, filed_schema)
    filed.write.mode("overwrite").parquet(f"{path}/filed")
    filed = spark.read.schema(filed_schema).parquet(f"{path}/filed")
    size = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("blocks"))   # at most MAX_CELLS rows
    size.write.mode("overwrite").parquet(f"{path}/cells")
    size = spark.read.parquet(f"{path}/cells")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    (filed.join(F.broadcast(size), "cell").withColumn("block", block).select("id", "cell", "block", "code", "v")
     .repartition("cell", "block").sortWithinPartitions("cell", "block").write.mode("overwrite").parquet(f"{path}/items"))
    return index


def search(index: VectorIndex, queries: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "vec",
           item_id: str = "item_id", rerank: int | None = None, probes: int | None = None) -> DataFrame:
    """Top ``k`` items per query by cosine: query id, item id, similarity (6
    decimals), rank, n_coded (items scored by code) and n_compared (items whose
    vector was compared). ``rerank`` defaults to 5 * k."""
    spark = queries.sparkSession
    rerank, probes = rerank or 5 * k, min(probes or index.probes, len(index.cells))
    cells, books = index.cells, index.books
    items = index.items(spark)
    idt, qt = items.schema["id"].dataType, queries.schema[query_id].dataType
    q = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v"))
    q = q.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))
    ask_schema = T.StructType([T.StructField("q", qt), T.StructField("cell", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def ask(batches):
        for b in batches:
            if len(b) and probes:
                x = _unit(_matrix(b["v"]))
                near = (x @ cells.T).argsort(1)[:, ::-1][:, :probes]
                row = np.repeat(np.arange(len(x)), probes)
                yield pd.DataFrame({"q": b["q"].to_numpy()[row], "cell": near.ravel().astype("int32"), "v": list(x[row])})

    size = spark.read.parquet(f"{index.path}/cells")
    asked = q.mapInPandas(ask, ask_schema).join(F.broadcast(size), "cell").select(
        "q", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    found_schema = T.StructType([T.StructField("q", qt), T.StructField("id", idt), T.StructField("near", T.DoubleType()), T.StructField("n", T.LongType())])

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(a) and len(b):
            code = np.frombuffer(b"".join(b["code"]), np.uint8).reshape(len(b), -1).astype(np.int64)
            code += np.arange(len(books)) * books.shape[1]
            ids, x, step = b["id"].to_numpy(), _subvectors(_matrix(a["v"]), len(books)), max(1, STRIP // code.size)
            for at in range(0, len(a), step):
                table = np.einsum("qgd,gcd->qgc", x[at:at + step], books).reshape(-1, books.shape[0] * books.shape[1])
                s = table[:, code].sum(2)
                best = np.argpartition(-s, min(rerank, len(b)) - 1, axis=1)[:, :rerank]
                row = np.repeat(np.arange(len(s)), best.shape[1])
                got.append(pd.DataFrame({"q": a["q"].to_numpy()[at + row], "id": ids[best.ravel()], "near": s[row, best.ravel()], "n": len(b)}))
        return pd.concat(got, ignore_index=True) if got else pd.DataFrame({"q": a["q"].iloc[:0], "id": b["id"].iloc[:0], "near": [], "n": []})

    scored = asked.groupBy("cell", "block").cogroup(items.select("cell", "block", "id", "code").groupBy("cell", "block")).applyInPandas(score, found_schema)
    first = Window.partitionBy("q").orderBy(F.col("near").desc(), F.col("id"))
    # a block's size stands in each of its rows: count it once per (query, block)
    some = scored.withColumn("place", F.row_number().over(first)).where(F.col("place") <= rerank)
    coded = asked.groupBy("q", "cell", "block").agg(F.lit(1)).join(items.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n")), ["cell", "block"])
    coded = coded.groupBy("q").agg(F.sum("n").alias("n_coded"))
    exact = (some.select("q", "id").join(items.select("id", F.col("v").alias("iv")), "id").join(q, "q")
             .select("q", "id", F.round(cosine("v", "iv"), 6).alias("similarity")))
    w = Window.partitionBy("q").orderBy(F.col("similarity").desc(), F.col("id"))
    compared = some.groupBy("q").agg(F.count(F.lit(1)).alias("n_compared"))
    return (exact.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            .join(coded, "q").join(compared, "q")
            .select(F.col("q").alias(query_id), F.col("id").alias(item_id), "similarity", "rank", "n_coded", "n_compared"))
