"""Operators of a training-data pipeline (corpus in, corpus or report out).

Nothing outside this subpackage imports it. Queries are in ``queries.py``.
"""
