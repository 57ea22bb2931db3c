"""A baseline kept as a small mergeable summary of its distribution.

A summary of size ``m`` holds, per feature, at most ``m`` + 2 values with the exact
number of baseline rows up to each: wherever the running count passes another
``n / m`` rows, and both ends. The number of rows up to any value is then known to
within ``n / m``; if there are no more than ``m`` different values, exactly. Drift
of a batch against the summary costs the batch's own rows, however large the
baseline is. Summaries of two baselines add up (``merge``): their errors do, too,
so that the bound stays one m-th of all rows per merge.
"""

from __future__ import annotations

import dataclasses
import math
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.drift import EPS, _bin_edges, _running

SIZE = 1 << 14


@dataclasses.dataclass(frozen=True)
class Summary:
    """Ascending values and the number of rows up to (and with) each."""
    values: np.ndarray
    upto: np.ndarray

    @property
    def n(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def rank(self, x, below: bool = False) -> np.ndarray:
        """Rows up to x, or below x; never more than the truth."""
        at = np.searchsorted(self.values, x, "left" if below else "right")
        return np.concatenate([[0], self.upto])[at]

    def thin(self, size: int = SIZE) -> Summary:
        if len(self.values) <= size + 2:
            return self
        step = np.asarray(self.upto, dtype=object) * size // max(self.n, 1)
        keep = np.append(True, np.array(step[1:] > step[:-1], bool))
        keep[-1] = True
        return Summary(self.values[keep], self.upto[keep])


def merge(a: Summary, b: Summary, size: int = SIZE) -> Summary:
    """Summary of both baselines."""
    values = np.union1d(a.values, b.values)
    return Summary(values, a.rank(values) + b.rank(values)).thin(size)


def build(base: DataFrame, cols: Sequence[str], path: str, size: int = SIZE) -> None:
    """Store the summaries of ``cols`` under ``path``: one pass over the
    baseline, then work on its different values only."""
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("fi"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]))
    seen = base.select(x.alias("x")).select("x.*").where("v is not null and not isnan(v)").groupBy("fi", "v").agg(F.count(F.lit(1)).alias("k"))
    run = _running(seen, ["fi"], "v", "k", "upto")
    total = run.groupBy("fi").agg(F.max("upto").alias("n"), F.min("v").alias("first"), F.count(F.lit(1)).alias("different"))     # a row per feature
    run = run.join(F.broadcast(total), "fi")
    passed = F.expr(f"CAST(upto AS DECIMAL(38,0)) * {size} div n") > F.expr(f"CAST(upto - k AS DECIMAL(38,0)) * {size} div n")
    keep = (F.col("different") <= size) | passed | (F.col("v") == F.col("first"))
    run.where(keep).select("fi", "v", "upto").repartition(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, n_cols: int) -> list[Summary]:
    """The stored summaries: at most ``size`` + 2 rows per feature."""
    rows = spark.read.parquet(path).toPandas().sort_values(["fi", "v"])
    return [Summary(g["v"].to_numpy(), g["upto"].to_numpy()) for g in (rows[rows.fi == i] for i in range(n_cols))]


def psi(base: list[Summary], batch: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """R1 against summaries: fi, feature, psi. Equal-width bins over the joint
    range, as in ``drift.psi``; a bin's baseline share is off by 2 / m at most."""
    spark = batch.sparkSession
    v = [F.col(c).cast("double") for c in cols]
    ends = batch.agg(*[f for i, x in enumerate(v) for f in (F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"), F.count(x).alias(f"n{i}"))]).first()
    grid = []
    for i, s in enumerate(base):
        mn, mx = ends[f"mn{i}"], ends[f"mx{i}"]
        if mn is None or not s.n or min(mn, s.values[0]) == max(mx, s.values[-1]):
            grid.append(None)
        else:
            grid.append(_bin_edges(min(mn, float(s.values[0])), max(mx, float(s.values[-1])), bins))
    counts = batch.agg(F.lit(0), *[F.count_if(x < e).alias(f"c{i}_{k}") for i, (x, g) in enumerate(zip(v, grid)) for k, e in enumerate(g or [])]).first()
    rows = []
    for i, (s, g) in enumerate(zip(base, grid)):
        value = 0.0
        if g:
            b = np.diff([0, *s.rank(np.array(g), below=True), s.n]) / s.n + EPS
            c = np.diff([0, *(counts[f"c{i}_{k}"] for k in range(bins - 1)), ends[f"n{i}"]]) / ends[f"n{i}"] + EPS
            for p, q in zip(b, c):
                value += (q - p) * math.log(q / p)
        rows.append((i, cols[i], float(value)))
    return spark.createDataFrame(rows, "fi int, feature string, psi double").withColumn("psi", F.round("psi", 9))


def ks(base: Summary, batch: DataFrame, col: str) -> DataFrame:
    """R2 against a summary: ks, off by 1 / m at most. Only the batch is ordered."""
    v = batch.select(F.col(col).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    run = _running(v, [], "v", "k", "upto")
    total = run.agg(F.sum("k")).scalar()

    def look(parts):
        for p in parts:
            x = p["v"].to_numpy()
            yield pd.DataFrame({"k": p["k"], "upto": p["upto"], "le": base.rank(x), "lt": base.rank(x, below=True)})

    at = run.select("v", "k", "upto").mapInPandas(look, "k long, upto long, le long, lt long").withColumn("n", total)
    nb = max(base.n, 1)
    gap = F.greatest(F.abs(F.col("le") / nb - F.col("upto") / F.col("n")),
                     F.abs(F.col("lt") / nb - (F.col("upto") - F.col("k")) / F.col("n")))
    return at.agg(F.round(F.coalesce(F.max(gap), F.lit(0.0)) if base.n else F.lit(0.0), 9).alias("ks"))
