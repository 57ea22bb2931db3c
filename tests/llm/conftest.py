import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
TRICKY = [None, "", " ", "...", "a", "a b c", "\n\n", "x" * 3000, "word " * 400, "Ünï cödé 日本 ½ ΣΑΣ İ", "tab\tand\x0bodd\x1c space"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and
    columns whose names clash with the operators' own."""
    rows = [(i, t, "en", i) for i, t in enumerate(TRICKY)]
    rows += [(3, TRICKY[3], None, None), (8, TRICKY[8], "en", 8), (8, TRICKY[8], "en", 8), (None, "a b c", None, None), (None, None, None, None)]
    return spark.createDataFrame(
        [(*r, 7, "clash", 1) for r in rows],
        "doc_id long, text string, lang string, n_chars long, k1 long, shard string, score int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long, k1 long, shard string, score int")
