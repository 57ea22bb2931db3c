"""F2: pluggable text scorers chosen by name, with the rule scorer as fallback.

A scorer maps a text Column to a struct<label, confidence> Column. Native
Column builders stay in the JVM; a user model can be plugged in as a
``pandas_udf`` returning the same struct.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column

from tessera.functions import text as TX

Scorer = Callable[[Column], Column]
_SCORERS: dict[str, Scorer] = {"rules": lambda c: TX.sentiment_label(c)}


def register_scorer(name: str, fn: Scorer) -> None:
    _SCORERS[name] = fn


def has_scorer(name: str) -> bool:
    return name in _SCORERS


def get_scorer(name: str | None) -> Scorer:
    """Named scorer, or the rule-based one when the name is unknown / None."""
    return _SCORERS.get(name or "rules", _SCORERS["rules"])
