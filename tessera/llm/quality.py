"""Quality rules from repetition coverage.

Rolling hashes of n-grams of several lengths (numpy, one flat byte array per
Arrow batch) tell which n-grams of a text occur in it twice or more; the
coverage of a length is the share of word characters inside such n-grams, each
character once. Duplicate lines are measured in the same way. Short n-grams
(2 to 4 words) are judged by the single most frequent one.

Narrow: no shuffle; a task holds one Arrow batch and a few MB of hashes.

Defined cases: null is empty and has no words; a text without words has zero
everywhere and fails the base rule (fewer than 50 words). Ties between most
frequent n-grams go to the one that covers more characters. Whole texts count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytescan as B

#: Published limits of repetition filters for web text.
TOP_NGRAM = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_NGRAM = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
DUP_LINE_CHARS = 0.20
DUP_LINES = 0.30
MIN_WORDS = 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_M = np.uint64(0xD6E8FEB86659FD93)


def _groups(row: np.ndarray, h: np.ndarray, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order that brings equal (row, hash) together; group start flags in it."""
    key = B.mix(h + row.astype(np.uint64) * _M)           # one key for row and hash
    order = np.argsort(key, kind=kind)
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    return order, new


def _cover(inside: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """Mark ``n`` words from each start."""
    d = np.zeros(len(inside) + n, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + n, -1)
    return np.cumsum(d)[: len(inside)] > 0


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of the rows of a flat byte array."""
    n = len(off) - 1
    s, e = B.runs(B.VISIBLE[data], off)
    row = B.rows_of(s, off)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])       # code points so far
    chars = lead[e] - lead[s]
    words, word_chars = B.per_row(row, n), B.per_row(row, n, chars)
    sym = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out = {"n_words": words, "word_chars": word_chars, "n_symbols": sym[off[1:]] - sym[off[:-1]]}
    h = B.span_hashes(data, s, e)
    whole = np.maximum(word_chars, 1)
    g, ok = h, np.arange(len(h))
    for k in range(2, 11):                                # rolling: the k-gram from the (k-1)-gram
        # a k-gram can repeat only where the (k-1)-gram at its start does
        fits = ok + k <= len(h)
        ok, g = ok[fits], g[fits]
        fits = row[ok] == row[ok + k - 1]
        ok = ok[fits]
        g = B.mix(g[fits] * _M + h[ok + k - 1])
        order, new = _groups(row[ok], g)
        size = np.diff(np.append(np.flatnonzero(new), len(ok)))
        rep = np.repeat(size, size) > 1
        if k == 3 or k in DUP_NGRAM:
            inside = _cover(np.zeros(len(h), bool), k, ok[order[rep]])
            if k == 3:
                out["n_repeat_words"] = B.per_row(row[inside], n)
            if k in DUP_NGRAM:
                out[f"dup_{k}gram"] = B.per_row(row[inside], n, chars[inside]) / whole
        if k in TOP_NGRAM:                                # count x length of the most frequent
            at = np.flatnonzero(new)
            first = ok[order[at]]
            total = np.concatenate([[0], np.cumsum(chars)])
            weight = np.where(size > 1, size * (total[first + k] - total[first]), 0)
            best = np.zeros(n, np.int64)
            rank = np.lexsort((weight, size, row[first]))
            best[row[first][rank]] = weight[rank]         # the last of each row wins
            out[f"top_{k}gram"] = best / whole
        again = np.sort(order[rep])
        ok, g = ok[again], g[again]
    # lines with a word
    ls, le = B.runs(data != 10, off)
    has = np.concatenate([[0], np.cumsum(B.VISIBLE[data])])
    keep = has[le] > has[ls]
    ls, le = ls[keep], le[keep]
    lrow = B.rows_of(ls, off)
    order, new = _groups(lrow, B.span_hashes(data, ls, le), "stable")
    again = np.zeros(len(ls), bool)
    again[order[~new]] = True                             # stable order: the first one is the earliest
    lines, length = B.per_row(lrow, n), lead[le] - lead[ls]
    out["n_dup_lines"] = B.per_row(lrow[again], n)
    out["dup_lines"] = out["n_dup_lines"] / np.maximum(lines, 1)
    out["dup_line_chars"] = B.per_row(lrow[again], n, length[again]) / np.maximum(B.per_row(lrow, n, length), 1)
    out["base_failed"] = (words < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * words)
    bad = out["base_failed"] | (out["dup_lines"] > DUP_LINES) | (out["dup_line_chars"] > DUP_LINE_CHARS)
    for k, most in TOP_NGRAM.items():
        bad = bad | (out[f"top_{k}gram"] > most)
    for k, most in DUP_NGRAM.items():
        bad = bad | (out[f"dup_{k}gram"] > most)
    out["kept"] = ~bad
    return out


LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FLAGS = ("base_failed", "kept")
SHARES = ("dup_lines", "dup_line_chars", *(f"top_{k}gram" for k in TOP_NGRAM), *(f"dup_{k}gram" for k in DUP_NGRAM))


def quality_rules(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the counts, the verdicts and the coverage shares."""
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType(kept + [T.StructField(c, T.LongType()) for c in LONGS]
                          + [T.StructField(c, T.BooleanType()) for c in FLAGS]
                          + [T.StructField(c, T.DoubleType()) for c in SHARES])
    nk = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = B.flat(b.column(nk))
            for i, j in B.pieces(off):
                m = measure(data[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in range(nk)),
                     *(pa.array(m[c]) for c in (*LONGS, *FLAGS, *SHARES))], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
