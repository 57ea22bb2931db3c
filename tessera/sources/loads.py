"""Append loads that can be repeated.

A load has an id. Its rows go to a folder of their own; the load counts only
from the moment its manifest, a small file named after the id, is renamed into
place. Readers take the folders that manifests name. A load that runs again
after it was published changes nothing; one that failed half-way, or whose task
was retried, leaves at most a folder that no manifest names (``sweep`` removes
those).
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.operators.quality import require_columns

_ID = re.compile(r"[A-Za-z0-9._=-]+")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifest(path: str, load_id: str) -> str:
    if not _ID.fullmatch(load_id) or load_id.startswith((".", "_")):
        raise ValueError(f"load id {load_id!r}: use letters, digits, dot, underscore, equals sign and hyphen")
    return f"{path}/_loads/{load_id}"


def published(spark: SparkSession, path: str) -> dict[str, dict]:
    """Manifests by load id: folder, rows, format and schema of every published load."""
    fs, folder = _fs(spark, f"{path}/_loads")
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    names = [n for n in names if not n.startswith((".", "_"))]
    if not names:
        return {}
    # manifests may be many: read by Spark, one short line each
    lines = spark.read.text([f"{path}/_loads/{n}" for n in names]).collect()
    return {m["load_id"]: m for m in (json.loads(r["value"]) for r in lines)}


def write_load(df: DataFrame, path: str, load_id: str, partition_by: Sequence[str] = (), required: Sequence[str] = (),
               fmt: str = "parquet") -> bool:
    """Add ``df`` to the table at ``path`` as the load ``load_id``. False, and
    nothing written, if that load has been published before. One writer per load
    id at a time; different loads may run side by side."""
    spark = df.sparkSession
    require_columns(df, required)
    name = _manifest(path, load_id)
    fs, target = _fs(spark, name)
    if fs.exists(target):
        return False
    folder = f"data/{load_id}-{uuid.uuid4().hex}"
    w = df.write.format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(f"{path}/{folder}")
    publish(spark, path, load_id, folder, fmt, df.schema)
    return True


def publish(spark: SparkSession, path: str, load_id: str, folder: str, fmt: str, schema: T.StructType) -> None:
    """Write the manifest aside, then rename it into place (one atomic step)."""
    fs, target = _fs(spark, _manifest(path, load_id))
    _, aside = _fs(spark, f"{path}/_loads/.{uuid.uuid4().hex}")
    line = json.dumps({"load_id": load_id, "folder": folder, "format": fmt, "schema": schema.jsonValue()}) + "\n"
    out = fs.create(aside)
    out.write(bytearray(line.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(aside, target):
        fs.delete(aside, False)
        raise FileExistsError(f"load {load_id} was published by another writer")


def read_loads(spark: SparkSession, path: str, load_col: str | None = None) -> DataFrame:
    """Rows of all published loads, united by column name; with ``load_col``,
    the id of the load each row came with."""
    loads = published(spark, path)
    if not loads:
        raise FileNotFoundError(f"no published load under {path}")
    frames = []
    # loads of one format and schema are one scan
    for key in sorted({(m["format"], json.dumps(m["schema"])) for m in loads.values()}):
        own = [m for m in loads.values() if (m["format"], json.dumps(m["schema"])) == key]
        schema = T.StructType.fromJson(json.loads(key[1]))
        scan = spark.read.format(key[0]).schema(schema)
        parts = [scan.option("basePath", f"{path}/{m['folder']}").load(f"{path}/{m['folder']}") for m in own] if _partitioned(spark, path, own[0]) \
            else [scan.load([f"{path}/{m['folder']}" for m in own])]
        frames += parts
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if load_col:
        out = out.withColumn(load_col, F.regexp_extract(F.input_file_name(), r"/data/([^/]+)-[0-9a-f]{32}/", 1))
    return out


def _partitioned(spark: SparkSession, path: str, manifest: dict) -> bool:
    fs, folder = _fs(spark, f"{path}/{manifest['folder']}")
    return any(s.isDirectory() and "=" in s.getPath().getName() for s in fs.listStatus(folder))


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Remove folders that no manifest names (run it while no load is running)."""
    keep = {m["folder"] for m in published(spark, path).values()}
    fs, data = _fs(spark, f"{path}/data")
    gone = []
    for s in fs.listStatus(data) if fs.exists(data) else []:
        folder = f"data/{s.getPath().getName()}"
        if folder not in keep:
            fs.delete(s.getPath(), True)
            gone.append(folder)
    return gone
