"""Structured Streaming jobs: incremental file ingest, windowed trends,
sliding demand, stream dedup, per-batch drift checks, sessions, counters.

Every job is checkpointed in the shared checkpoint folder, so a restarted
driver or a lost executor resumes from the last committed batch. Sinks use
``foreachBatch`` with batch-keyed, idempotent writes: a replayed batch
overwrites its own output instead of appending twice.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.session import checkpoint_dir, materialize

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType,
                 max_files: int | None = None) -> DataFrame:
    """Stream the parquet file(s) of one table from a folder of tables."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): reinterpret in UTC."""
    return df.withColumn(col, F.to_utc_timestamp(F.col(col).cast("timestamp"), "UTC"))


def run_available(stream: DataFrame, out: str, ckpt: str, mode: str = "append") -> str:
    """Process everything available now and stop (``Trigger.AvailableNow``).

    append, update → each batch's new or changed rows land in
    ``out/batch_id=<id>`` (overwrite: replay-safe; ``latest_updates`` reads
    updated rows back); complete → ``out/complete`` holds the whole result,
    written anew per batch.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/complete" if mode == "complete" else f"{out}/batch_id={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{out}/complete" if mode == "complete" else out


def latest_updates(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """What a stream in update mode holds: each key's row from its last batch."""
    rows = spark.read.parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return last.select(*keys, "_r.*")


def ingest_stream(spark: SparkSession, folder: str, table: str, schema: T.StructType,
                  out: str, ckpt: str, max_files: int | None = None) -> DataFrame:
    """Every new file under ``folder`` is ingested exactly once (the
    checkpoint remembers processed files); returns the ingested table."""
    run_available(table_stream(spark, folder, table, schema, max_files), out, ckpt, "append")
    return spark.read.parquet(out).drop("batch_id")


def trend_stream(stream: DataFrame, label: str, score: str, delay: str = "1 day") -> DataFrame:
    """Daily tumbling label counts and mean score with a watermark;
    late rows inside the delay update their day, later ones are dropped."""
    s = event_time(stream).withWatermark("ts", delay)
    return s.groupBy(F.window("ts", "1 day")).agg(
        *[F.count(F.when(F.col(label) == x, 1)).alias(x.lower())
          for x in ("POSITIVE", "NEGATIVE", "NEUTRAL", "MIXED")],
        F.sum(F.col(score).cast("decimal(10,3)")).alias("score_sum"), F.count(F.lit(1)).alias("n"))


def sliding_demand(stream: DataFrame, key: str, ts: str, delay: str = "7 days") -> DataFrame:
    """7-day windows sliding by 1 day of units per ``key``."""
    s = event_time(stream, ts).withWatermark(ts, delay)
    return s.groupBy(key, F.window(ts, "7 days", "1 day")).agg(F.count(F.lit(1)).alias("units"))


def dedup_stream(stream: DataFrame, key: str, delay: str = "7 days") -> DataFrame:
    """Drop keys that arrived before, within ``delay`` of arrival. The
    watermark follows the arrival time, which only grows: rows with old event
    times are never late, and state is bounded by what arrives in ``delay``."""
    s = stream.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", delay)
    return s.dropDuplicatesWithinWatermark([key]).drop("_arrival")


def session_stream(stream: DataFrame, key: str, ts: str, gap: str = "30 minutes",
                   delay: str = "1 hour") -> DataFrame:
    """Per-key session windows (gap-based). Append mode writes a session
    once it is closed and drops its state (rows later than ``delay`` are lost);
    complete mode also gives open ones and keeps all."""
    s = event_time(stream, ts).withWatermark(ts, delay)
    return s.groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n_events"))


def counter_stream(stream: DataFrame, key: str) -> DataFrame:
    """Running interaction count per key. The counts are the state: one
    number per key, for good; run it in update mode, which writes changed keys."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("new_interactions"))


def drift_stream(spark: SparkSession, stream: DataFrame, baseline: DataFrame, cols, audit: str,
                 ckpt: str) -> None:
    """Each micro-batch is compared with the baseline (PSI per feature, KS
    on the first feature) and the report is appended to the audit sink, keyed by
    batch id (replay-safe). The baseline is read once, into a bounded summary
    (``operators.baseline``) next to the checkpoint; a restarted stream goes on
    with the stored one. A batch costs its own rows."""
    from tessera.operators import baseline as B
    path = f"{ckpt.rstrip('/')}-baseline"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        B.build(baseline, cols, path)
    stored = B.load(spark, path, len(cols))

    def check(batch: DataFrame, batch_id: int) -> None:
        batch = batch.select(*cols).persist()
        n = batch.count()
        if n:
            rep = B.psi(stored, batch, cols)
            ks = B.ks(stored[0], batch, cols[0]).select("ks").scalar()
            (rep.withColumn("ks", ks).withColumn("batch_id", F.lit(batch_id)).withColumn("n_rows", F.lit(n))
                .write.mode("overwrite").json(f"{audit}/batch_id={batch_id}"))
        batch.unpersist()

    q = (stream.writeStream.foreachBatch(check).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# ---- X6: sessions in append mode, late rows kept aside -----------------------------

def _last_state(spark: SparkSession, out: str, batch_id: int) -> int | None:
    """The last batch before ``batch_id`` whose state is complete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/state")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "clock/_SUCCESS"))]
    return max((d for d in done if d < batch_id), default=None)


def session_append(stream: DataFrame, key: str, ts: str, out: str, ckpt: str, gap_seconds: int = 1800,
                   delay_seconds: int = 3600) -> None:
    """X6 in append mode. Under ``out``:

    * closed/batch_id=n — sessions that no further row can change, each written
      once: key, session_start, session_end (last event), n_events;
    * late/batch_id=n — rows behind the watermark (newest time of all earlier
      batches less the delay), whole, instead of being lost;
    * state/batch_id=n/open and clock — sessions still open and the newest time.

    Every row is in one closed or open session or in ``late``. State holds open
    sessions only: one row per session younger than gap + delay. A batch reads
    the state of the batch before and overwrites its own folders, so a replayed
    batch gives the same again. Open sessions join new rows as session windows
    as long as they already are, plus the gap.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_t", F.to_utc_timestamp(F.col(ts).cast("timestamp"), "UTC")).persist()
        newest = rows.agg(F.unix_micros(F.max("_t"))).first()[0]
        prev, old = _last_state(spark, out, batch_id), None
        if prev is not None:
            old = spark.read.parquet(f"{out}/state/batch_id={prev}/clock").first()["newest"]
        mark = None if old is None else old - delay_seconds * 1_000_000
        here = F.unix_micros("_t")
        late = F.lit(False) if mark is None else F.coalesce(here < mark, F.lit(False))
        rows.where(late | F.col("_t").isNull()).drop("_t").write.mode("overwrite").parquet(f"{out}/late/batch_id={batch_id}")
        fresh = rows.where(~late & F.col("_t").isNotNull()).select(F.col(key), F.col("_t").alias("s"), F.lit(0).cast("long").alias("d"), F.lit(1).cast("long").alias("n"))
        if prev is not None:
            kept = spark.read.parquet(f"{out}/state/batch_id={prev}/open")
            fresh = fresh.unionByName(kept.select(key, F.col("session_start").alias("s"), (F.unix_micros("session_end") - F.unix_micros("session_start")).alias("d"),
                                                  F.col("n_events").alias("n")))
        # windows that touch are merged: a microsecond less keeps "at least the gap" apart
        gap = gap_seconds * 1_000_000 - 1
        length = F.concat((F.col("d") + gap).cast("string"), F.lit(" microseconds"))
        found = fresh.groupBy(key, F.session_window("s", length).alias("w")).agg(F.sum("n").alias("n_events")).select(
            key, F.col("w.start").alias("session_start"), F.timestamp_micros(F.unix_micros("w.end") - gap).alias("session_end"), "n_events")
        found = found.persist()
        clock = max(x for x in (newest, old, -2**62) if x is not None)
        closed = F.unix_micros("session_end") + gap_seconds * 1_000_000 <= clock - delay_seconds * 1_000_000
        found.where(closed).write.mode("overwrite").parquet(f"{out}/closed/batch_id={batch_id}")
        found.where(~closed).write.mode("overwrite").parquet(f"{out}/state/batch_id={batch_id}/open")
        spark.createDataFrame([(clock,)], "newest long").write.mode("overwrite").parquet(f"{out}/state/batch_id={batch_id}/clock")
        found.unpersist()
        rows.unpersist()

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def open_sessions(spark: SparkSession, out: str) -> DataFrame:
    """Sessions still open after the last batch."""
    return spark.read.parquet(f"{out}/state/batch_id={_last_state(spark, out, 2**62)}/open")
