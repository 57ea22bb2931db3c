"""Toxicity from the nearest labelled examples.

Terms are words and word beginnings of 4, 5 and 6 bytes (inflected forms share
them). Fitting takes a bounded sample of labelled rows (``toxic_rows`` and
``clean_rows``, in the order of a hash of the id) and stores the examples' whole
TF-IDF vectors in an inverted index. Every term takes part; its weight grows
with its leaning to either label (``evidence_weight``), which holds for few and
many rows alike. Rare terms have postings of (example, weight); the postings of
common terms stand in blocks of examples with, for each term, the block's
largest weight. A text's nearest examples by exact cosine are found in the
blocks whose upper bound (the rare terms' sum, the text's weights times the block
maxima) exceeds the k-th similarity of the block of the largest bound. Votes are
weighted by similarity and by the sampling rate of the label, and calibrated
by a monotone fit (pool adjacent violators) on the examples' own
leave-one-out votes.

All texts are scored, whole. The index grows with the sample's texts, not with
the table, so it is broadcast; scoring is narrow.

Defined cases: a text without any known term (empty and null ones too) gets
the smoothed rate of such texts among the examples; with no examples at all
every score is 0. Equal similarities are taken in index order. Labels that are
null are left out; an id with several labels counts for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytescan as B
from tessera.llm.common import held_out, staged

PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
BLOCK = 64
COMMON, DENSE = 50, 1024
NEIGHBOURS = 16


def term_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term occurrence: words and their beginnings."""
    low = B.LOWER[data]
    s, e = B.runs(B.ALNUM[low], off)
    ends = [e] + [np.minimum(s + k, e) for k in PREFIXES]
    hs = B.spans_hashes(low, s, ends)
    row = B.rows_of(s, off)
    out_h, out_r = [hs[0]], [row]
    for k, h in zip(PREFIXES, hs[1:]):
        longer = e - s > k                     # else the beginning is the word itself
        out_h.append(B.mix(h[longer] + np.uint64(k)))
        out_r.append(row[longer])
    return np.concatenate(out_h), np.concatenate(out_r)


class Rows:
    """Sparse rows: row i has the terms ``term[ptr[i]:ptr[i + 1]]`` (ascending)
    with the weights ``val``."""

    def __init__(self, ptr: np.ndarray, term: np.ndarray, val: np.ndarray, width: int):
        self.ptr, self.term, self.val, self.width = ptr, term, val, width

    def __len__(self) -> int:
        return len(self.ptr) - 1

    @classmethod
    def of(cls, x: Rows | np.ndarray) -> Rows:
        if isinstance(x, Rows):
            return x
        row, term = np.nonzero(x)
        return cls(np.searchsorted(row, np.arange(len(x) + 1)), term, x[row, term].astype(np.float32), x.shape[1])

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def take(self, rows: np.ndarray) -> Rows:
        n = np.diff(self.ptr)[rows]
        at = B.ranges(self.ptr[rows], n)
        return Rows(np.concatenate([[0], np.cumsum(n)]), self.term[at], self.val[at], self.width)


def term_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, distinct terms (48 bits of the hash, ascending in each row)
    and their counts."""
    h, row = term_hashes(data, off)
    h >>= np.uint64(16)
    if len(off) <= 1 << 16:                       # row and term in one number
        h |= row.astype(np.uint64) << np.uint64(48)
        h.sort()
        row = (h >> np.uint64(48)).astype(np.int64)
        h &= np.uint64((1 << 48) - 1)
    else:
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return np.searchsorted(row[at], np.arange(len(off))), h[at], np.diff(np.append(at, len(h)))


def weighted(ptr: np.ndarray, h: np.ndarray, n: np.ndarray, vocab: np.ndarray, weight: np.ndarray) -> Rows:
    """Unit vectors over ``vocab`` (no term where a text has none of it)."""
    if not len(vocab):
        return Rows(np.zeros(len(ptr), np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32), 0)
    t = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    ok = np.flatnonzero(vocab[t] == h)
    t, cut = t[ok].astype(np.int32), np.searchsorted(ok, ptr)
    val = np.log1p(n[ok]) * weight[t]
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(cut))
    norm = np.sqrt(np.bincount(row, val * val, len(ptr) - 1))
    return Rows(cut, t, (val / norm[row]).astype(np.float32), len(vocab))


class BlockMaxIndex:
    """Inverted index of the examples: postings (example, weight) of every
    term. Terms in more than ``1 / COMMON`` of the examples, ``DENSE`` at most,
    have their postings laid out by block, with their largest weight per block."""

    def __init__(self, x: Rows | np.ndarray):
        """Rows with like weights stand together, which keeps the bounds tight."""
        x = Rows.of(x)
        n = len(x)
        top = np.full((n, 3), -1, np.int64)
        for i, (a, b) in enumerate(zip(x.ptr, x.ptr[1:])):
            some = x.term[a:b][np.argsort(-x.val[a:b], kind="stable")[:3]]
            top[i, :len(some)] = some
        self.order = np.lexsort(top.T[::-1])
        self.n, self.cuts = n, np.arange(0, n, BLOCK)
        df = np.zeros(x.width, np.int64)
        for a in range(0, n, 512):               # small pieces: the driver holds one copy of the examples
            df += np.bincount(x.term[x.ptr[a]:x.ptr[min(a + 512, n)]], minlength=x.width)
        often = np.lexsort((np.arange(x.width), -df))[:DENSE]
        often = np.sort(often[df[often] * COMMON > n])
        self.column = np.full(x.width, -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.start = np.concatenate([[0], np.cumsum(np.where(self.column < 0, df, 0))])
        self.x = np.zeros((n, len(often)), np.float32)
        self.who, self.weight = np.empty(self.start[-1], np.int32), np.empty(self.start[-1], np.float32)
        free = self.start[:-1].copy()
        for a in range(0, n, 512):
            part = x.take(self.order[a:a + 512])
            row, col = part.row() + a, self.column[part.term]
            at = col >= 0
            self.x[row[at], col[at]] = part.val[at]
            rest = np.flatnonzero(~at)
            rest = rest[np.argsort(part.term[rest], kind="stable")]
            t, first, some = np.unique(part.term[rest], return_index=True, return_counts=True)
            to = np.repeat(free[t] - first, some) + np.arange(len(rest))
            self.who[to], self.weight[to] = row[rest], part.val[rest]
            free[t] += some
        self.maxima = np.maximum.reduceat(self.x, self.cuts) if n else self.x

    def nearest(self, q: Rows | np.ndarray, k: int, rows_each: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """The k largest cosines of each query and their rows (-1: fewer)."""
        q = Rows.of(q)
        sim, who = np.zeros((len(q), k)), np.full((len(q), k), -1, np.int64)
        if self.n:
            for a in range(0, len(q), rows_each):
                b = min(a + rows_each, len(q))
                sim[a:b], who[a:b] = self._nearest(q.take(np.arange(a, b)), k)
        return sim, who

    def _nearest(self, q: Rows, k: int) -> tuple[np.ndarray, np.ndarray]:
        m, row, col = len(q), q.row(), self.column[q.term]
        common = np.zeros((m, self.x.shape[1]), np.float32)
        common[row[col >= 0], col[col >= 0]] = q.val[col >= 0]
        s = np.empty((m, self.n), np.float32)
        for i in range(m):                       # one query's postings stay in the cache
            t, v = (z[q.ptr[i]:q.ptr[i + 1]][col[q.ptr[i]:q.ptr[i + 1]] < 0] for z in (q.term, q.val))
            n = self.start[t + 1] - self.start[t]
            at = B.ranges(self.start[t], n)
            s[i] = np.bincount(self.who[at], self.weight[at] * np.repeat(v, n), self.n)
        # the postings by block: the best block of each query first, then all
        # whose bound exceeds the k-th similarity found there
        bound = common @ self.maxima.T + np.maximum.reduceat(s, self.cuts, axis=1) + 2e-5
        done = np.zeros(bound.shape, bool)
        done[np.arange(m), bound.argmax(1)] = True
        self._add(s, common, done)
        least = np.zeros(m)
        if k <= min(BLOCK, self.n):
            place = self.cuts[bound.argmax(1)][:, None] + np.arange(BLOCK)
            inside = np.where(place < self.n, s[np.arange(m)[:, None], np.minimum(place, self.n - 1)], 0)
            least = np.partition(inside, -k, axis=1)[:, -k]
        more = ~done & (bound > np.maximum(least, 5e-6)[:, None])
        self._add(s, common, more)
        s[~np.repeat(done | more, BLOCK, axis=1)[:, :self.n]] = 0
        key = np.rint(s * np.float32(1e5)).astype(np.int64) * self.n + np.arange(self.n - 1, -1, -1)    # equal ones in index order
        if k < self.n:
            key = np.partition(key, -k, axis=1)[:, -k:]
        key = np.sort(key, axis=1)[:, ::-1]
        sim, who = np.zeros((m, k)), np.full((m, k), -1, np.int64)
        sim[:, :key.shape[1]] = key // self.n / 1e5
        who[:, :key.shape[1]] = self.order[self.n - 1 - key % self.n]
        who[sim <= 0] = -1
        return sim, who

    def _add(self, s: np.ndarray, common: np.ndarray, where: np.ndarray) -> None:
        for block in np.flatnonzero(where.any(0)):
            rows, a = np.flatnonzero(where[:, block]), self.cuts[block]
            whole = 2 * len(rows) > len(common)       # then a product with all rows is cheaper than a copy of most
            got = (common if whole else common[rows]) @ self.x[a:a + BLOCK].T
            s[rows, a:a + BLOCK] += got[rows] if whole else got


def _votes(sim: np.ndarray, who: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    weight = np.where(who >= 0, sim * w[who], 0)
    return (weight * y[who]).sum(1) / np.maximum(weight.sum(1), 1e-12)


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the monotone fit of y over x as knots."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []            # [sum wy, sum w, first x, last x]
    for i in order:
        if blocks and blocks[-1][3] == x[i]:
            blocks[-1][0] += w[i] * y[i]
            blocks[-1][1] += w[i]
        else:
            blocks.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    return (np.array([v for b in blocks for v in (b[2], b[3])]),
            np.array([b[0] / b[1] for b in blocks for _ in (0, 1)]))


class Model:
    """Vocabulary, index and calibration; scores batches of texts."""

    def __init__(self, vocab, term_weight, x: Rows, y, ids, weight, k: int = NEIGHBOURS):
        self.vocab, self.term_weight, self.k = vocab, term_weight, k
        some = np.diff(x.ptr) > 0
        known, none = np.flatnonzero(some), np.flatnonzero(~some)
        self.none = float((weight[none] * y[none]).sum() / (weight[none].sum() + 1)) if len(x) else 0.0
        self.y, self.w, self.ids = y[known].astype(float), weight[known], [ids[i] for i in known]
        x = x if some.all() else x.take(known)
        self.index = BlockMaxIndex(x)
        self.knots = None
        if len(known):
            sim, who = self.index.nearest(x, k + 1)
            own = who == np.arange(len(known))[:, None]       # leave one out: itself, else the last
            own[~own.any(1), -1] = True
            sim, who = (a[~own].reshape(-1, k) for a in (sim, who))
            v = np.round(_votes(sim, who, self.y, self.w), 9)
            self.knots = monotone(v, self.y, self.w)

    def score(self, data: np.ndarray, off: np.ndarray):
        """Score of each text, and its nearest examples (similarity, row)."""
        ptr, h, n = term_rows(data, off)
        q = weighted(ptr, h, n, self.vocab, self.term_weight)
        score = np.full(len(q), self.none)
        sim, who = np.zeros((len(q), self.k)), np.full((len(q), self.k), -1, np.int64)
        some = np.flatnonzero(np.diff(q.ptr) > 0)
        if len(some) and self.knots is not None:
            # equal rows once, by the sum of their (term, weight) hashes
            pair = B.mix(q.term.astype(np.uint64) << np.uint64(32) | q.val.view(np.uint32))
            ends = np.concatenate([np.zeros(1, np.uint64), np.cumsum(pair)])
            digest = ends[q.ptr[some + 1]] - ends[q.ptr[some]]
            _, one, back = np.unique(digest, return_index=True, return_inverse=True)
            s, w = self.index.nearest(q.take(some[one]), self.k)
            v = np.round(_votes(s, w, self.y, self.w), 9)
            got = np.interp(v, *self.knots)
            score[some], sim[some], who[some] = got[back], s[back], w[back]
        return np.clip(score, 0, 1), sim, who


def evidence_weight(pos: np.ndarray, neg: np.ndarray, q: float) -> np.ndarray:
    """1 + z^2 of each term, z being its leaning to either label in standard
    deviations, with one row less of the label it leans to (no row vouches for
    itself). No term is left out, whatever the number of rows."""
    n = pos + neg
    z = np.maximum(np.abs(pos - n * q) - 1, 0) / np.sqrt(np.maximum(n * q * (1 - q), 1e-12))
    return 1 + z * z


def within_bytes(rows: DataFrame, bound: dict[int, int]) -> DataFrame:
    """``rows`` (__id, __y, __text) of as many ids of each label as ``bound``
    bytes hold, in the order of the id's hash. The ids are those of the sample."""
    h = F.xxhash64(F.col("__id").cast("string"))
    sizes = (rows.groupBy("__y", h.alias("h")).agg(F.sum(F.coalesce(F.octet_length("__text"), F.lit(0)).cast("long")).alias("n"))
             .toArrow().to_pylist())
    keep = F.lit(True)
    for y, most in bound.items():
        left, out = most, []
        for r in sorted((r for r in sizes if r["__y"] == y), key=lambda r: r["h"]):
            if r["n"] > min(left, most // 16):
                out.append(r["h"])
            else:
                left -= r["n"]
        if out:
            keep = keep & ~((F.col("__y") == y) & h.isin(out))
    return rows.where(keep)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
        toxic_rows: int = 3000, clean_rows: int = 6000, min_z: float = 0.0, min_rows: int = 1, sample_bytes: int = 48 << 20) -> Model:
    """Model from a bounded sample of ``labels`` (rows with crc32(id) mod 4 = 2
    never take part). Sampling touches ids only; the sample's texts are staged
    once, terms are counted by Spark. ``min_z`` and ``min_rows`` leave no term out unless they are set."""
    lab = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col, 4, 2)).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    size = {r["__y"]: r["n"] for r in lab.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    picked = [lab.where(F.col("__y") == y).orderBy(F.xxhash64(F.col("__id").cast("string")), "__id").limit(m)
              for y, m in ((1, toxic_rows), (0, clean_rows))]
    rows = staged(docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
                  .join(F.broadcast(picked[0].unionAll(picked[1])), "__id"), "labelled")

    rows = within_bytes(rows, {1: sample_bytes // 3, 0: sample_bytes - sample_bytes // 3})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy()
            data, off = B.flat(b.column(1))
            for i, j in B.pieces(off):
                ptr, h, _ = term_rows(data[off[i]:off[j]], off[i:j + 1] - off[i])
                t, at = np.unique(h, return_inverse=True)
                pos = np.bincount(at, np.repeat(y[i:j], np.diff(ptr)), len(t)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.view(np.int64)), pa.array(pos), pa.array(np.bincount(at, minlength=len(t)) - pos)],
                    ["term", "pos", "neg"])

    totals = {r["__y"]: r["n"] for r in rows.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    npos, nneg = totals.get(1, 0), totals.get(0, 0)
    wpos, wneg = size.get(1, 0) / max(npos, 1), size.get(0, 0) / max(nneg, 1)
    q = npos / max(npos + nneg, 1)
    vocab, pos, neg = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    if npos and nneg:                       # one row per term of the bounded sample
        found = (rows.select("__y", "__text").mapInArrow(count, "term long, pos long, neg long").groupBy("term")
                 .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") + F.col("neg") >= min_rows).toArrow())
        vocab, pos, neg = (found.column(c).to_numpy() for c in ("term", "pos", "neg"))
        order = np.argsort(vocab)
        vocab, pos, neg = vocab[order].view(np.uint64), pos[order], neg[order]
    strong = evidence_weight(pos, neg, q)
    some = strong >= 1 + min_z ** 2
    vocab, strong, pos, neg = vocab[some], strong[some], pos[some], neg[some]
    idf = np.log((1 + size.get(1, 0) + size.get(0, 0)) / (1 + pos * wpos + neg * wneg))
    term_weight = np.maximum(idf, 0.1) * strong
    shared = docs.sparkSession.sparkContext.broadcast((vocab, term_weight))

    def vectorise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = B.flat(b.column(2))
            for i, j in B.pieces(off):
                x = weighted(*term_rows(data[off[i]:off[j]], off[i:j + 1] - off[i]), *shared.value)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).cast(pa.string()).slice(i, j - i), b.column(1).slice(i, j - i),
                     *(pa.array([v[s:e].tobytes() for s, e in zip(x.ptr, x.ptr[1:])], pa.binary()) for v in (x.term, x.val))],
                    ["id", "y", "t", "w"])

    # sparse vectors of the bounded sample, a partition at a time
    got = staged(rows.select(F.col("__id").cast("string"), "__y", "__text")
                 .mapInArrow(vectorise, "id string, y int, t binary, w binary"), "vectors")
    shared.destroy()
    got = sorted(got.toLocalIterator(), key=lambda r: (r["id"] or "", r["y"], r["t"]))
    y, ids = np.array([r["y"] for r in got], float), [r["id"] for r in got]
    ptr = np.concatenate([[0], np.cumsum([len(r["t"]) // 4 for r in got])]).astype(np.int64)
    t, w = (np.frombuffer(b"".join(r[c] for r in got), d) for c, d in (("t", np.int32), ("w", np.float32)))
    del got
    return Model(vocab, term_weight, Rows(ptr, t, w, len(vocab)), y, ids, np.where(y > 0, wpos, wneg))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
          evidence: int = 3) -> DataFrame:
    """``keep`` columns, ``score``, ``predicted`` and ``evidence``: the nearest
    examples with their similarity and label."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ev = T.StructType([T.StructField("example", T.StringType()), T.StructField("similarity", T.DoubleType()),
                       T.StructField("toxic", T.IntegerType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(ev))])
    ev_arrow = pa.list_(pa.struct([("example", pa.string()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    nk = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for b in batches:
            data, off = B.flat(b.column(nk))
            for i, j in B.pieces(off):
                s, sim, who = m.score(data[off[i]:off[j]], off[i:j + 1] - off[i])
                proof = [[{"example": m.ids[w], "similarity": float(v), "toxic": int(m.y[w])}
                          for v, w in zip(vs[:evidence], ws[:evidence]) if w >= 0] for vs, ws in zip(sim, who)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in range(nk)), pa.array(s),
                     pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(proof, ev_arrow)], names=schema.names)

    return docs.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
