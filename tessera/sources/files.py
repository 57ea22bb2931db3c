"""File sources and sinks: JSON-array files, CSV with drifting headers, JSONL,
append / overwrite loads and an audit sink.

Readers take an explicit schema (no inference pass over the data). Writers
use Spark's committers, so a retried or lost task never leaves partial files.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.operators.quality import require_columns, union_frames

# Microsecond timestamps in text formats (Spark's default keeps milliseconds).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def read_json_arrays(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every file under ``path`` holds one JSON array of records.

    ``multiLine`` parses each file as one document (a file is the unit of
    parallelism, as a top-level array cannot be split); elements become rows.
    """
    return (spark.read.schema(schema).option("multiLine", True)
            .option("timestampNTZFormat", TS_FORMAT).json(path))


def read_csvs(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV groups whose headers differ, unioned by column name.

    Each group (a folder or glob of files sharing one header) is read with
    the header and the part of ``schema`` it carries; columns absent from a
    group come back as nulls.
    """
    frames = []
    for p in paths:
        header = spark.read.option("header", True).csv(p).columns  # header row only
        # CSV columns bind by position: the read schema follows this header
        sub = T.StructType([schema[h] for h in header if h in schema.fieldNames()])
        frames.append(spark.read.option("header", True).option("timestampNTZFormat", TS_FORMAT)
                      .schema(sub).csv(p))
    out = union_frames(*frames)
    return out.select(*[F.col(f.name).cast(f.dataType) if f.name in out.columns
                        else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType,
               list_cols: Sequence[str] = ()) -> DataFrame:
    """S3: JSON lines; missing list fields become empty arrays."""
    df = spark.read.schema(schema).json(path)
    for c in list_cols:
        dtype = schema[c].dataType
        df = df.withColumn(c, F.coalesce(F.col(c), F.array().cast(dtype)))
    return df


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: JSON lines writer."""
    df.write.mode(mode).json(path)


def pick_text_column(df: DataFrame) -> str:
    """First column whose name contains text/body/review/content, else the first."""
    for c in df.columns:
        if any(k in c.lower() for k in ("text", "body", "review", "content")):
            return c
    return df.columns[0]


def text_intake(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The chosen text column, nulls dropped; optional cap (the cap is the
    feature of the interactive intake; batch jobs pass ``None``)."""
    c = pick_text_column(df)
    out = df.where(F.col(c).isNotNull()).select(F.col(c).alias("text"))
    return out.limit(limit) if limit else out


def append_raw(df: DataFrame, path: str, partition_by: Sequence[str] = (),
               required: Sequence[str] = ()) -> None:
    """Plain append load (blocks until committed); run twice, it adds its
    rows twice. Loads that may be repeated: ``loads.write_load`` (any rows) or
    ``overwrite_partitions`` (whole partitions)."""
    require_columns(df, required)
    w = df.write.mode("append").format("parquet")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """S5 (idempotent variant): replace only the partitions present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*partition_by).format("parquet").save(path))


def overwrite_table(df: DataFrame, path: str) -> None:
    """Full rebuild of a derived table."""
    df.write.mode("overwrite").format("parquet").save(path)


def write_audit(df: DataFrame, path: str, load_id: str | None = None) -> None:
    """Append drift reports / retrain decisions as JSON lines. With a
    ``load_id`` a report that is written again (a retried job) counts once; read
    such a sink with ``loads.read_loads``."""
    df = df.withColumn("written_at", F.current_timestamp())
    if load_id is None:
        df.write.mode("append").json(path)
    else:
        from tessera.sources.loads import write_load
        write_load(df, path, load_id, fmt="json")
