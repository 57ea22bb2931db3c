"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (drawn from its code point, so
executors agree without sharing a table). A letter n-gram is the product of its
letters' vectors, each rolled by its place (binding by permutation); a text is
the sum of its n-grams (bundling). A language's prototype is the sum over the
labelled texts; a text goes to the language with the largest cosine.

Bundles are sums, so training is one narrow pass that leaves one vector per
language and partition, added up by Spark: what reaches the driver is
languages x dimensions numbers, whatever the input.

Defined cases: a text without a letter, or null, is ``und`` with score 0. With
no labelled text every text is ``und``. Ties go to the language first in
alphabetical order. Texts are used whole, in pieces when long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 1024
N = 3
SYMBOLS = 1 << 12           # letters beyond share places by code point modulo
UNKNOWN = "und"


def _letters() -> np.ndarray:
    """Place of each code point: 0 for what is not a letter, else a number
    below SYMBOLS (exact below U+0800, by remainder above)."""
    import sys
    table = np.zeros(sys.maxunicode + 1, np.int16)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            o = ord(low) if len(low) == 1 else c
            table[c] = o if o < 0x800 else 0x800 + o % 0x7FF
    return table


_state: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _state:
        _state["letters"] = _letters()
        rng = np.random.default_rng(7)
        _state["vectors"] = rng.integers(0, 2, (SYMBOLS, DIMS), dtype=np.int8) * 2 - 1
    return _state["letters"], _state["vectors"]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram code and count of every distinct n-gram of every text. A run
    of non-letters is one blank, also before the first and after the last
    letter; a text without letters has no n-gram."""
    letters, _ = _tables()
    # two separators between texts, so that no n-gram lies in two
    joined = "\0\0" + "\0\0".join(texts) + "\0\0"
    sym = letters[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    start = 2 + np.cumsum(lens + 2) - (lens + 2)
    row = np.repeat(np.arange(len(texts)), lens + 2)       # a text and the two separators behind it
    row = np.concatenate([[0, 0], row])[: len(sym)]
    row[start[0] - 2: start[0]] = 0
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (row[1:] != row[:-1])
    sym, row = sym[keep], row[keep]
    # windows that begin before a text's first letter belong to that text
    a, b, c = sym[:-2], sym[1:-1], sym[2:]
    ok = b > 0
    code = ((a * SYMBOLS + b) * SYMBOLS + c)[ok]
    assert len(texts) < 1 << 26                            # row and code share 62 bits
    key = np.sort(row[1:-1][ok] * SYMBOLS**3 + code)
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return key[at] // SYMBOLS**3, key[at] % SYMBOLS**3, np.diff(np.append(at, len(key)))


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of n-gram codes: the letters' vectors, rolled by place."""
    _, v = _tables()
    a, b, c = codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return (np.roll(v[a], 2, axis=1) * np.roll(v[b], 1, axis=1) * v[c]).astype(np.float32)


def bundle(texts: list[str], piece: int = 4000) -> np.ndarray:
    """One vector for each text: the sum of its n-gram vectors."""
    out = np.zeros((len(texts), DIMS), np.float32)
    row, code, count = grams(texts)
    codes, at = np.unique(code, return_inverse=True)
    for lo in range(0, len(codes), piece):                 # n-gram vectors of some MB at a time
        v = gram_vectors(codes[lo: lo + piece])
        m = (at >= lo) & (at < lo + piece)
        counts = np.zeros((len(texts), len(v)), np.float32)
        counts[row[m], at[m] - lo] = count[m]
        out += counts @ v
    return out


def _chunks(texts: list, rows: int = 256, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and b - a < rows and (b == a or n < chars):
            n += len(texts[b])
            b += 1
        yield a, b
        a = b


def fit_prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language from all labelled rows (null labels are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                total = sums.setdefault(lang, np.zeros(DIMS))
                for i, j in _chunks(texts, rows=100_000):
                    _, code, count = grams(texts[i:j])
                    codes, at = np.unique(code, return_inverse=True)
                    n = np.bincount(at, count)
                    for lo in range(0, len(codes), 4000):
                        total += n[lo: lo + 4000].astype(np.float32) @ gram_vectors(codes[lo: lo + 4000])
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * DIMS), pa.array(np.arange(DIMS, dtype=np.int32)), pa.array(v)], ["lang", "d", "v"])

    parts = (labelled.where(F.col(lang_col).isNotNull())
             .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
             .mapInArrow(run, "lang string, d int, v double"))
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "d").agg(F.sum("v").alias("v")).collect():    # languages x DIMS rows
        out.setdefault(r["lang"], np.zeros(DIMS))[r["d"]] = r["v"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred``, ``score`` (the cosine, 0 to 1) and
    ``margin`` (its lead over the second language)."""
    names = sorted(prototypes)
    shared = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[n] for n in names]).reshape(-1, DIMS))
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("margin", T.DoubleType())])
    nk = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(nk).to_pylist()]
            lang, score, margin = [], [], []
            for i, j in _chunks(texts):
                v = bundle(texts[i:j]).astype(np.float64)
                norm = np.linalg.norm(v, axis=1)
                # rounding keeps ties between equal profiles in name order
                cos = np.round(v @ p.T / np.where(norm > 0, norm, 1)[:, None], 12) if len(p) else np.zeros((j - i, 0))
                best = cos.argmax(1) if len(p) else np.zeros(j - i, int)
                top = np.sort(cos, 1)[:, ::-1]
                for r in range(j - i):
                    known = norm[r] > 0 and len(p)
                    lang.append(names[best[r]] if known else UNKNOWN)
                    score.append(min(1.0, max(0.0, top[r, 0])) if known else 0.0)
                    margin.append(float(top[r, 0] - (top[r, 1] if len(p) > 1 else 0)) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in range(nk)), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(margin, pa.float64())], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)


def split(id_col: str = "doc_id") -> Column:
    from tessera.llm.common import held_out
    return held_out(id_col, 3, 1)
