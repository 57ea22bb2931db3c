"""Benchmark decontamination with a distributed positional inverted index.

The benchmark's words (lower-case runs of letters, digits and non-ASCII
characters) form the test vocabulary. One pass over the documents stores, per
document, the positions of the words of that vocabulary: the positional index,
sharded by document, in the shared folder. Searching reads the index only. In
a shard the postings of a term are its sorted positions; a window of ten item
words starts from the postings of its rarest term (by counts over the whole
corpus), less the term's offset in the window, and intersects the
offset-adjusted postings of the others from rare to frequent. What is left are
the exact phrase matches. Proximity matches take the window's three rarest
terms and ask for all of them within ``near`` words, in any order.

The benchmark is a stated query set. Up to ``block_words`` words its vocabulary
and windows are broadcast. A larger one never passes the driver: its windows are
a table that meets the postings in joins (``phrase_join``).

Defined cases: null or wordless texts and items have no words and never match;
an item of fewer than ten words is one window; repeated items and rows count
as often as they stand there; a null item_id counts as 'null'.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytescan as B
from tessera.llm import phrase_join
from tessera.llm.common import row_key, staged

WINDOW = 10


class TestSet:
    """Vocabulary and windows of a benchmark of bounded size."""

    __test__ = False

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.ids = sorted({i for i, _ in items})
        place = {i: k for k, i in enumerate(self.ids)}
        data, off = B.flat(pa.array([t for _, t in items], pa.string()))
        h, row = B.word_hashes(data, off)
        self.vocab, term = np.unique(h, return_inverse=True)
        bounds = np.searchsorted(row, np.arange(len(items) + 1))
        wins: dict[tuple, set] = {}
        for k, (item, _) in enumerate(items):
            w = term[bounds[k]: bounds[k + 1]].tolist()
            for j in range(max(1, len(w) - window + 1) if w else 0):
                wins.setdefault(tuple(w[j: j + window]), set()).add(place[item])
        self.window = window
        self.length = np.array([len(w) for w in wins], np.int64)
        self.terms = np.full((len(wins), window), -1, np.int64)
        for k, w in enumerate(wins):
            self.terms[k, : len(w)] = w
        self.item_of = np.array([i for s in wins.values() for i in sorted(s)], np.int64)
        self.item_bounds = np.cumsum([0, *(len(s) for s in wins.values())])

    def rank(self, counts: np.ndarray) -> None:
        """Order each window's places from rare to frequent; drop the windows
        with a term that the corpus does not have."""
        c = np.where(self.terms >= 0, np.append(counts, 0)[self.terms], np.iinfo(np.int64).max)
        self.order = np.argsort(c, axis=1, kind="stable")
        self.alive = np.flatnonzero((c > 0).all(1)) if len(c) else np.zeros(0, np.int64)

    def search(self, tok: np.ndarray, at: np.ndarray, near: int | None):
        """Matches in a shard: ``tok`` is the term at each place (-1: none),
        ``at`` the places that have a term, ascending. Returns the window and
        start of every exact match, and the window and place of every
        proximity match."""
        by = np.argsort(tok[at], kind="stable")
        posts, term = at[by], tok[at][by]
        bounds = np.searchsorted(term, np.arange(len(self.vocab) + 1))
        w = self.alive
        t0 = self.terms[w, self.order[w, 0]]
        n = bounds[t0 + 1] - bounds[t0]
        win = np.repeat(w, n)
        start = posts[B.ranges(bounds[t0], n)] - self.order[win, 0]
        rare = start + self.order[win, 0]
        near_win, near_at = win, rare
        for j in range(1, self.window):
            off = self.order[win, j]
            want = self.terms[win, off]
            ok = (want < 0) | (tok[start + off] == want)
            win, start = win[ok], start[ok]
        if near is None:
            return win, start, None, None
        for j in (1, 2):                     # a posting of the next rare terms within reach
            want = self.terms[near_win, self.order[near_win, j]] if self.window > j else np.full(len(near_win), -1)
            key = term.astype(np.int64) << 40 | posts
            lo = np.searchsorted(key, want << 40 | np.maximum(near_at - near, 0))
            hi = np.searchsorted(key, want << 40 | (near_at + near), "right")
            ok = (want < 0) | (hi > lo)
            near_win, near_at = near_win[ok], near_at[ok]
        return win, start, near_win, near_at


def build_index(docs: DataFrame, vocab: np.ndarray, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Positional index of the vocabulary's words: one row per document with
    its word count, the term numbers and their positions (int32 arrays)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    keyed = docs.select(*keep, F.col(text_col).cast("string").alias("__text")).withColumns(
        dict(zip(("k1", "k2"), row_key(*keep, "__text"))))
    schema = T.StructType([keyed.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in ("k1", "k2", "n_words")]
                          + [T.StructField(c, T.BinaryType()) for c in ("terms", "places")])
    cols = [*keep, "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            data, off = B.flat(b.column(len(cols)))
            for i, j in B.pieces(off):
                h, row = B.word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n = B.per_row(row, j - i)
                first = np.cumsum(n) - n
                t = np.minimum(np.searchsorted(v, h), max(len(v) - 1, 0))
                ok = np.flatnonzero(v[t] == h) if len(v) else np.zeros(0, np.int64)
                place = (ok - first[row[ok]]).astype(np.int32)
                cut = np.searchsorted(row[ok], np.arange(j - i + 1)) * 4
                term = t[ok].astype(np.int32)
                arrays = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                          for x in (term, place)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in range(len(cols))), pa.array(n), *arrays], names=schema.names)

    return keyed.select(*cols, "__text").mapInArrow(run, schema)


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """How often each term occurs in the corpus (one number per term reaches
    the driver)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            data, _ = B.flat(b.column(0))
            n += np.bincount(np.frombuffer(data.tobytes(), np.int32), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for r in index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def search_index(index: DataFrame, tests: TestSet, keep: tuple[str, ...], near: int | None) -> DataFrame:
    """For every document: n_words, the hit runs [from, to) in words, the items
    with exact matches, and those with proximity matches."""
    shared = index.sparkSession.sparkContext.broadcast(tests)
    runs_t = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
    schema = T.StructType([index.schema[c] for c in (*keep, "k1", "k2", "n_words")] + [
        T.StructField("hits", runs_t), T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("near_items", T.ArrayType(T.StringType()))])
    nk = len(keep) + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: TestSet = shared.value
        gap = max(q.window, near or 0) + 1      # no match reaches into the next document
        for b in batches:
            words = b.column(nk - 1).to_numpy(zero_copy_only=False)
            size = np.concatenate([[0], np.cumsum(words)])
            for i, j in B.pieces(size, 1 << 21):
                part = b.slice(i, j - i)
                n = words[i:j]
                base = gap + np.cumsum(n + gap) - (n + gap)    # blank places between documents
                tok = np.full(int(gap + (n + gap).sum()), -1, np.int32)
                terms, cut = B.flat(part.column(nk))
                places, _ = B.flat(part.column(nk + 1))
                terms, places = (np.frombuffer(x.tobytes(), np.int32) for x in (terms, places))
                at = np.repeat(base, np.diff(cut) // 4) + places
                tok[at] = terms
                win, start, nwin, nat = q.search(tok, at, near)
                mark = np.zeros(len(tok) + 1, np.int64)
                np.add.at(mark, start, 1)
                np.add.at(mark, start + q.length[win], -1)
                s, e = B.runs(np.cumsum(mark[:-1]) > 0, np.concatenate([[0], base[1:], [len(tok)]]))
                doc = np.searchsorted(base, s, "right") - 1
                hits: list[list] = [[] for _ in range(j - i)]
                for d, x, y in zip(doc.tolist(), (s - base[doc]).tolist(), (e - base[doc]).tolist()):
                    hits[d].append({"s": x, "e": y})
                found = []
                for w, p in ((win, start), (nwin, nat)):
                    got: list[list] = [[] for _ in range(j - i)]
                    if w is not None and len(w):
                        c = np.diff(q.item_bounds)[w]
                        item = q.item_of[B.ranges(q.item_bounds[w], c)]
                        d = np.repeat(np.searchsorted(base, p, "right") - 1, c)
                        for key in np.unique(d * len(q.ids) + item).tolist():
                            got[key // len(q.ids)].append(q.ids[key % len(q.ids)])
                    found.append(got)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in range(nk)), pa.array(hits, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                     *(pa.array(g, pa.list_(pa.string())) for g in found)], names=schema.names)

    return index.select(*keep, "k1", "k2", "n_words", "terms", "places").mapInArrow(run, schema)


def _small(benchmark: DataFrame, id_col: str, text_col: str, most_words: int, most_rows: int) -> list[tuple[str, str]] | None:
    """The benchmark's items, or None if there are more than the bounds allow."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("i"),
                             F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("i") + F.octet_length("t")), F.lit(0)).alias("b")).first()
    if size["n"] > most_rows or size["b"] > 6 * most_words:
        return None
    return [(r["i"], r["t"]) for r in items.collect()]


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 id_col: str = "item_id", item_text: str = "text", window: int = WINDOW, near: int | None = 20,
                 block_words: int = 1_000_000, block_rows: int = 20_000) -> DataFrame:
    """For every document: ``keep``, ``n_words``, ``hits`` (runs of hit words),
    ``items`` and ``near_items`` (item ids with exact and proximity matches).
    A benchmark of more than ``block_words`` words (six bytes each) or
    ``block_rows`` items is searched by joins (``phrase_join``), with the same
    results."""
    items = _small(benchmark, id_col, item_text, block_words, block_rows)
    if items is None:
        return phrase_join.find_matches(docs, benchmark, text_col, keep, id_col, item_text, window, near)
    tests = TestSet(items, window)
    index = staged(build_index(docs, tests.vocab, text_col, keep), "postings")
    tests.rank(term_counts(index, len(tests.vocab)))
    return search_index(index, tests, keep, near).select(*keep, "n_words", "hits", "items", "near_items")


def report(matches: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return matches.select(
        *keep, F.col("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))
