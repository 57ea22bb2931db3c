"""Exact numeric helpers shared by operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def money_sum(col) -> Column:
    """Exact sum of a DECIMAL money column, returned as DOUBLE."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def money_avg_2dp(col) -> Column:
    """Mean of a 2-decimal money column, rounded half-up to cents, exactly.

    Works in integer cents so every engine gets the same answer:
    floor((2·Σcents + n) / (2·n)) / 100 (prices are non-negative).
    """
    c = F.col(col) if isinstance(col, str) else col
    cents = F.sum((c.cast("decimal(18,2)") * 100).cast("bigint"))
    n = F.count(c)
    return (F.floor((cents * 2 + n) / (n * 2)) / 100).cast("double")


MONEY_AVG_2DP_SQL = ("CAST(floor((SUM(CAST(CAST({c} AS DECIMAL(18,2)) * 100 AS BIGINT)) * 2 + COUNT({c}))"
                     " / (COUNT({c}) * 2)) / 100 AS DOUBLE)")


def dec_avg(col, scale: int = 3) -> Column:
    """Mean of a fixed-scale decimal as DOUBLE: exact sum / count."""
    c = F.col(col) if isinstance(col, str) else col
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double") / F.count(c)
