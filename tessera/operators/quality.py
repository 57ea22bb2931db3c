"""Data tests, load metrics, validation and deduplication.

Every check is a single aggregate pass (partial aggregation on each task,
one tiny final merge), so checks cost one scan regardless of data size.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


# ---- schema ---------------------------------------------------------------

def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise when required columns are missing (metadata only, no job)."""
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def cast_or_quarantine(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cast columns with ``try_cast``; rows where a non-null input fails
    to cast go to the quarantine frame (with the failing column names)
    instead of failing the load."""
    casted = df
    fails = []
    for c, t in types.items():
        raw = f"_raw_{c}"
        casted = casted.withColumn(raw, F.col(c)).withColumn(c, F.col(raw).try_cast(t))
        fails.append(F.when(F.col(raw).isNotNull() & F.col(c).isNull(), F.lit(c)))
    bad = F.filter(F.array(*fails), lambda x: x.isNotNull())
    tagged = casted.withColumn("_failed", bad)
    ok = tagged.where(F.size("_failed") == 0).drop("_failed", *[f"_raw_{c}" for c in types])
    quarantine = (tagged.where(F.size("_failed") > 0)
                  .select(*[F.col(f"_raw_{c}").alias(c) if c in types else F.col(c)
                            for c in df.columns], F.col("_failed").alias("failed_columns")))
    return ok, quarantine


# ---- data tests -----------------------------------------------------------

def check_not_null(df: DataFrame, col: str) -> DataFrame:
    """Q1: number of rows where ``col`` is null."""
    return df.agg(F.count_if(F.col(col).isNull()).alias("failures"))


def check_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q2: keys occurring more than once, with their counts."""
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") > 1))


def check_range(df: DataFrame, col: str, lo, hi) -> DataFrame:
    """Q3: rows whose value is outside [lo, hi] (nulls are not failures)."""
    return df.agg(F.count_if(~F.col(col).between(lo, hi)).alias("failures"))


def check_allowed(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    """Q5: values outside the allowed set, with row counts."""
    return (df.where(~F.col(col).isin(*values) | F.col(col).isNull())
              .groupBy(col).agg(F.count(F.lit(1)).alias("n")))


def data_tests(tests: Mapping[str, DataFrame]) -> DataFrame:
    """Run many single-row failure counts as one table (test, failures, status)."""
    parts = [df.select(F.lit(name).alias("test"), F.col("failures").cast("long"))
             for name, df in tests.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("status", F.when(F.col("failures") == 0, "PASS").otherwise("FAIL"))


def ingest_checks(df: DataFrame, ts: str, key: Sequence[str], min_rows: int,
                  ts_lo: str, ts_hi: str, required: Sequence[str]) -> DataFrame:
    """Q4: one pass — row count, timestamp range, out-of-range rows,
    duplicate keys, schema completeness; plus an overall verdict."""
    require_ok = len(set(required) - set(df.columns)) == 0
    k = F.struct(*[F.col(c) for c in key])
    stats = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"),
        F.count_if((F.col(ts) < F.lit(ts_lo).cast("timestamp_ntz"))
                   | (F.col(ts) > F.lit(ts_hi).cast("timestamp_ntz"))).alias("ts_out_of_range"),
        (F.count(F.lit(1)) - F.count_distinct(k)).alias("duplicate_rows"),
    )
    return (stats.withColumn("schema_ok", F.lit(require_ok))
            .withColumn("passed", (F.col("n_rows") >= min_rows) & (F.col("ts_out_of_range") == 0)
                        & (F.col("duplicate_rows") == 0) & F.col("schema_ok")))


def valid_rows(df: DataFrame, col: str, lo: int, hi: int, name: str = "is_valid") -> DataFrame:
    """Length-range validity flag (as used for API input bounds)."""
    return df.withColumn(name, F.coalesce(F.length(col).between(lo, hi), F.lit(False)))


# ---- metrics --------------------------------------------------------------

def load_metrics(df: DataFrame, money: str, date: str, distinct: Sequence[str]) -> DataFrame:
    """A5: rows, exact money sum, date range and distinct counts, one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col(money).cast("decimal(18,2)")).cast("double").alias(f"sum_{money}"),
            F.min(date).alias(f"min_{date}"), F.max(date).alias(f"max_{date}")]
    aggs += [F.count_distinct(c).alias(f"distinct_{c}") for c in distinct]
    return df.agg(*aggs)


def distinct_count(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Exact distinct count, or HyperLogLog++ when ``approx``."""
    f = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.agg(f.alias(f"distinct_{col}"))


def daily_sketches(df: DataFrame, day: Column, col: str, lg_k: int = 14) -> DataFrame:
    """One HyperLogLog sketch of ``col`` per day (2^``lg_k`` registers, 16 KB
    at most), to be stored and merged for any set of days later on."""
    return df.where(F.col(col).isNotNull()).groupBy(day.alias("day")).agg(F.hll_sketch_agg(col, F.lit(lg_k)).alias("sketch"))


def merged_distinct(sketches: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct values over all sketches (of a group): the sketches
    are merged, the data is not read again. Standard error about 1.04 / sqrt(2^lg_k),
    0.8 % at the default size."""
    return sketches.groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


# ---- dedup / union --------------------------------------------------------

def union_frames(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name; a column missing on one side is null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def _pick(df: DataFrame, key: Sequence[str], order: Sequence[Column], latest: bool) -> DataFrame:
    # max_by / min_by aggregate: partial aggregation runs before the shuffle,
    # so a key holding a large share of rows is reduced on every map task and
    # never gathered whole in one task.
    rest = [c for c in df.columns if c not in key]
    payload = F.struct(*[F.col(c) for c in rest])
    ordering = F.struct(*order)
    pick = F.max_by(payload, ordering) if latest else F.min_by(payload, ordering)
    return df.groupBy(*key).agg(pick.alias("_row")).select(*key, *[F.col(f"_row.{c}") for c in rest])


def dedup_latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """U4: one row per key — the one with the greatest ``order`` tuple."""
    return _pick(df, key, [F.col(c) for c in order], latest=True)


def first_per_id(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key — the one with the smallest ``order`` tuple."""
    return _pick(df, key, [F.col(c) for c in order], latest=False)
