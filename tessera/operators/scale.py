"""Plan shapes that keep ordered computations distributed.

Spark windows need every row of a partition key in one task. When the key is
a user, a day or "the whole table", one hot key becomes one huge task. The
helpers here split such scans into (key, time-bucket) pieces whose size is
bounded by the bucket, then stitch the pieces together with small per-bucket
summary tables (one row per bucket), which are cheap to order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.session import materialize

_BUCKETS = {"minute", "hour", "day"}


def _bucket(ts: Column, unit: str) -> Column:
    if unit not in _BUCKETS:
        raise ValueError(f"bucket must be one of {_BUCKETS}")
    return F.date_trunc(unit, ts)


def sessionize(df: DataFrame, key: str, ts: str, gap_seconds: int,
               tiebreak: str, bucket: str = "hour") -> DataFrame:
    """Add ``is_new_session`` (0/1) and ``session_id`` (1-based per key).

    A session starts when the time since the previous event of the same key
    is at least ``gap_seconds`` (the same rule as ``session_window``). Rows are ordered within (key, bucket) pieces; the
    link between consecutive pieces comes from a per-(key, bucket) summary,
    so no task ever holds all events of one key.
    """
    b = "_bucket"
    d = df.withColumn(b, _bucket(F.col(ts), bucket))
    w_piece = Window.partitionBy(key, b).orderBy(ts, tiebreak)
    d = d.withColumn("_prev", F.lag(ts).over(w_piece))

    # one row per (key, bucket): last timestamp of the previous non-empty bucket
    pieces = d.groupBy(key, b).agg(F.max(ts).alias("_last"))
    w_key = Window.partitionBy(key).orderBy(b)
    pieces = pieces.withColumn("_prev_last", F.lag("_last").over(w_key))

    d = d.join(pieces.select(key, b, "_prev_last"), [key, b], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_prev_last"))
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))
    d = d.withColumn("is_new_session",
                     F.when(prev.isNull() | (gap >= gap_seconds * 1_000_000), 1).otherwise(0))
    d = d.withColumn("_cum", F.sum("is_new_session").over(
        w_piece.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    # sessions started in earlier buckets of the same key
    starts = d.groupBy(key, b).agg(F.sum("is_new_session").alias("_n"))
    starts = starts.withColumn("_offset", F.coalesce(F.sum("_n").over(
        w_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    d = d.join(starts.select(key, b, "_offset"), [key, b], "left")
    d = d.withColumn("session_id", (F.col("_offset") + F.col("_cum")).cast("long"))
    return d.drop(b, "_prev", "_prev_last", "_cum", "_offset")


def session_table(events: DataFrame, key: str, ts: str, gap_seconds: int,
                  tiebreak: str, bucket: str = "hour") -> DataFrame:
    """One row per (key, session): start, end, duration (s), events."""
    s = sessionize(events, key, ts, gap_seconds, tiebreak, bucket)
    return (s.groupBy(key, "session_id")
            .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"),
                 F.count(F.lit(1)).alias("n_events"))
            .withColumn("duration_us",
                        F.unix_micros(F.col("session_end").cast("timestamp"))
                        - F.unix_micros(F.col("session_start").cast("timestamp"))))


def ordered_positions(df: DataFrame, ts: str, tiebreak: str, bucket: str = "minute",
                      key: str | None = None) -> DataFrame:
    """Exact 0-based position of every row in (ts, tiebreak) order — over the
    whole table, or within ``key`` when given.

    Counts per (key, time bucket) — a small table — give each bucket its
    starting offset; rows are numbered only inside their bucket. Equivalent
    to ``row_number()`` over the whole table / whole key without moving all
    of its rows into one partition.
    """
    b = "_pbucket"
    keys = [key] if key else []
    d = df.withColumn(b, _bucket(F.col(ts), bucket)).withColumn("_pday", F.date_trunc("day", F.col(ts)))
    counts = d.groupBy(*keys, "_pday", b).agg(F.count(F.lit(1)).alias("_n"))
    # two small ordered passes instead of one over every bucket: day totals
    # (one row per key and day) give each day its offset; buckets are then
    # cumulated inside their day only
    days = counts.groupBy(*keys, "_pday").agg(F.sum("_n").alias("_dn"))
    w_day = (Window.partitionBy(*keys) if keys else Window).orderBy("_pday") \
        .rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_doff", F.coalesce(F.sum("_dn").over(w_day), F.lit(0)))
    w_b = Window.partitionBy(*keys, "_pday").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_boff", F.coalesce(F.sum("_n").over(w_b), F.lit(0)))
              .join(days.select(*keys, "_pday", "_doff"), [*keys, "_pday"])
              .withColumn("_start", F.col("_doff") + F.col("_boff")))
    d = d.join(counts.select(*keys, b, "_start"), [*keys, b], "inner")
    w_in = Window.partitionBy(*keys, b).orderBy(ts, tiebreak)
    d = d.withColumn("position", (F.col("_start") + F.row_number().over(w_in) - 1).cast("long"))
    return d.drop(b, "_start", "_pday")


def in_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with ``_b``: the number of its range in the order of ``cols``.
    Spark samples the bounds, so ranges have about as many rows each whatever
    the values; rows with equal ``cols`` share a range. Checkpointed, as a
    second evaluation could draw other bounds."""
    return materialize(df.repartitionByRange(*cols).withColumn("_b", F.spark_partition_id()))


def dense_ids(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Dense 0-based integer id per distinct value of ``col``, in value order,
    without a global window: distinct values are dealt into equal-sized ranges,
    range sizes are cumulated (one row per range) and values are numbered
    inside their range."""
    name = name or f"{col}_idx"
    vals = in_ranges(df.select(col).where(F.col(col).isNotNull()).distinct(), [col])
    counts = vals.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    w_all = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(w_all), F.lit(0)))
    vals = vals.join(counts.select("_b", "_start"), "_b")
    w_in = Window.partitionBy("_b").orderBy(col)
    return vals.select(col, (F.col("_start") + F.row_number().over(w_in) - 1).cast("long").alias(name))
