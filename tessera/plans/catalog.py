"""Registry of named queries: Spark builder + optional DuckDB oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` over the driver tables.
Registering it with ``sql=`` gives it an independent SQL twin; queries whose
semantics are not SQL-expressible (model fits, streams) register without one
and are checked by invariants in ``tests/`` instead.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    bench: bool


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, bench: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, bench)
        return fn
    return deco


_MEMO: dict = {}


def _listing(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of every file under ``folder``, in any store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def memo(fn):
    """Reuse one fitted model / intermediate per (Spark application, files in
    the data folder) across the queries that report on it (e.g. one k-means
    fit for both the segment counts and the segment statistics). Changed files
    (name, size or time) make a new one."""
    def wrapped(spark: SparkSession, sf: str):
        key = (fn.__module__, fn.__name__, spark.sparkContext.applicationId, sf, _listing(spark, sf))
        if key not in _MEMO:
            _MEMO[key] = fn(spark, sf)
        return _MEMO[key]
    wrapped.__name__ = fn.__name__
    wrapped.__doc__ = fn.__doc__
    return wrapped


def load_all() -> dict[str, Entry]:
    # importing the modules registers their queries
    from tessera.plans import (q_marts, q_quality, q_text, q_graph, q_c360,  # noqa: F401
                               q_recsys, q_drift, q_models, q_streaming)
    return REGISTRY
