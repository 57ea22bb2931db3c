"""Shared helpers: reading tables, staged tables on the shared folder, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's scan. Arrow batches of this session are bounded to
    ``BATCH_BYTES`` of text, which bounds what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts lineage, survives lost executors, compressed on disk."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove staged tables from the shared folder. Only for tables whose
    readers have themselves been staged: nothing may be computed from them
    again, not even to replace a lost executor's work."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_ranges(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """``df`` staged with ``_b``, the number of a row's range in the order of
    ``cols``. Spark samples the bounds, so that ranges have about as many rows
    each, however many rows one group has."""
    return staged(df.repartitionByRange(*cols).withColumn("_b", F.spark_partition_id()), name)


def row_key(*cols: str) -> list[Column]:
    """Two 64-bit hashes of the given columns (``k1``, ``k2``): equal rows get
    equal keys, and 128 bits keep different rows apart at any realistic size."""
    return [F.xxhash64(*[F.col(c) for c in cols]).alias("k1"),
            F.xxhash64(F.lit("second"), *[F.col(c) for c in reversed(cols)]).alias("k2")]


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo: the fixed split of labelled rows.
    A null id counts as the text ''."""
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return (crc % modulus) == remainder


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, root) with the smallest
    node id as root, by alternating large-star and small-star joins. Each round
    groups edges by node with map-side minima; rounds end when nothing moves.
    """
    def norm(d):
        return d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    cur = staged(norm(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "cc")
    for _ in range(max_rounds):
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = norm(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = norm(joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .unionAll(low2.select("a", F.col("m").alias("b"))))
        nxt = staged(small, "cc")
        chk = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        same = nxt.agg(chk).first()[0] == cur.agg(chk).first()[0]
        cur = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
