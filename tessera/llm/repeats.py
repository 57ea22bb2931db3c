"""Exact removal of repeated byte windows by a depth-limited radix sort.

A suffix is sorted through its first ``WINDOW`` bytes only; windows that fall
into one group after all digits are exactly the strings that occur twice.
Sorting every suffix of a corpus would shuffle a row per byte, so suffixes
travel together: each window is filed under its anchor, the smallest hashed
32-byte gram in it (equal windows have their anchor at the same offset), and
windows with one anchor and neighbouring offsets form a block. The passes take
the most significant digit first and drop what is alone in its group:

1. the anchor gram;
2. for blocks of 64 offsets, the bytes that all windows of the block share; a
   block whose whole span stands elsewhere too is settled at once;
3. the same for blocks of 8 offsets, in the blocks not settled;
4. the whole window.

Each pass is a grouped count of hashes with map-side combining: no group of
equal suffixes is gathered anywhere, however many copies there are. Settling
needs equal 128-bit hashes of the bytes. Texts travel zstd-compressed.

Defined cases: null is empty; matches never cross documents; a text shorter
than the window loses nothing; equal rows are occurrences of each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytescan as B
from tessera.llm.common import row_key, staged

WINDOW = 400
GRAM = 32
_C = np.random.default_rng(3).integers(0, 2**64, 4, dtype=np.uint64) | np.uint64(1)


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a multiple of 8) from each position."""
    n = len(data)
    raw = np.concatenate([data, np.zeros(gram + 8, np.uint8)]).tobytes()
    v = np.empty(n + gram, np.uint64)
    for r in range(8):
        part = v[r::8]
        part[:] = np.frombuffer(raw, "<u8", len(part), r)
    h = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        h += v[8 * k: 8 * k + n] * _C[k % 4] * np.uint64(2 * k + 1)
    h ^= h >> np.uint64(32)
    h *= _C[0]
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Row, position, first and last window start (all within the row) and
    gram hash of every anchor."""
    out = []
    for lo in range(0, max(len(data), 1), B.PIECE):        # rows longer than a piece: in parts that overlap
        hi = min(len(data), lo + B.PIECE + window - 1)
        part = data[lo:hi]
        w = window - gram + 1
        if len(part) < window:
            continue
        h = _grams(part, gram)
        m = -(-len(part) // w) * w
        packed = np.full(m, np.uint64(2**64 - 1))
        packed[: len(part)] = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(part), dtype=np.uint64)
        grid = packed.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        s = np.arange(min(B.PIECE, len(part) - window + 1))
        row = B.rows_of(s + lo, off)
        s, row = (x[s + lo + window <= off[row + 1]] for x in (s, row))
        if not len(s):
            continue
        at = (np.minimum(back[s], ahead[s + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
        last = np.append(new[1:], len(s)) - 1
        r = row[new]
        out.append((r, at[new] + lo - off[r], s[new] + lo - off[r], s[last] + lo - off[r], h[at[new]]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _list(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(kind.to_pandas_dtype())))


def _digests(data: np.ndarray, s: np.ndarray, e: np.ndarray, both: bool) -> list[np.ndarray]:
    order = np.argsort(s, kind="stable")
    out = []
    for which in ((0, 1) if both else (0,)):
        h = np.empty(len(s), np.uint64)
        h[order] = B.spans_hashes(data, s[order], [e[order]], which)[0]
        out.append(h.view(np.int64))
    return out


def block_digests(data, row, p, first, last, lo, hi, size: int, window: int, gram: int):
    """Blocks of ``size`` offsets that the window starts first..last of anchor
    p reach. Positions are absolute; lo and hi bound the text. Returns the
    index of the anchor, block number, digest of the shared bytes, digests of
    the whole span and whether that lies in the text."""
    b0, b1 = (p - last) // size, (p - first) // size
    i = np.repeat(np.arange(len(p)), b1 - b0 + 1)
    b = B.ranges(b0, b1 - b0 + 1)
    key = np.unique(np.stack([row[i], p[i], b, i], 1), axis=0) if len(i) else np.zeros((0, 4), np.int64)
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:, :3] == key[:-1, :3]).all(1)        # one entry for each anchor and block
    b, i = key[~same, 2], key[~same, 3]
    near, far = b * size, np.minimum(b * size + size - 1, window - gram)
    q = p[i]
    s, e = q - far, q - near + window
    inside = (s >= lo[i]) & (e <= hi[i])
    u1, u2 = _digests(data, np.where(inside, s, q), np.where(inside, e, q + 1), True)
    shared = _digests(data, q - near, q - far + window, False)[0] if size > 1 else u1
    return i, b, shared, u1, u2, inside


_BLOCKS = T.StructType([T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()),
                        T.StructField("p", T.IntegerType()), T.StructField("b", T.IntegerType()),
                        T.StructField("shared", T.LongType()), T.StructField("u1", T.LongType()),
                        T.StructField("u2", T.LongType())])


def _settle(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """One radix pass: the blocks whose whole span repeats, and what the next
    pass has to look at: blocks that share their common bytes with others but
    are not settled, and one settled block of each content that those share
    bytes with (its copies need no further look)."""
    rows = staged(rows, f"digits{size}")
    if size > 1:
        # counts are staged so that the join can split the rows of a hot digest
        shared = staged(rows.groupBy("b", "shared").agg(F.count("*").alias("n")).where("n > 1").select("b", "shared"), f"twice{size}")
        rows = staged(rows.join(shared, ["b", "shared"]), f"shared{size}")
    whole = staged(rows.where("u1 is not null").groupBy("b", "u1", "u2")
                   .agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p")).alias("one")).where("n > 1"), f"whole{size}")
    rows = rows.join(whole, ["b", "u1", "u2"], "left")
    at = ["k1", "k2", "p", "b"]
    if size == 1:
        return rows.where("n is not null").select(*at), None
    rows = staged(rows, f"settled{size}")
    todo = rows.where("n is null")
    ones = (rows.where((F.col("one.k1") == F.col("k1")) & (F.col("one.k2") == F.col("k2")) & (F.col("one.p") == F.col("p")))
            .join(staged(todo.select("b", "shared").distinct(), f"open{size}"), ["b", "shared"]))
    return rows.where("n is not null").select(*at), todo.select(*at).unionAll(ones.select(*at))


def repeated_ranges(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW,
                    gram: int = GRAM, sizes: tuple[int, int] = (64, 8)) -> tuple[DataFrame, DataFrame]:
    """(base, live): all rows with key, byte count and SHA-256 of the text; and
    the rows that have repeated windows with their compressed text (``z``) and
    ``spans``, the byte ranges that repeated windows cover (not merged)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    keyed = keyed.select("id", *row_key("id", "text"), F.col("text").cast("binary").alias("text"))
    top = window - gram

    # pass 1: anchors of every text, by the anchor gram
    schema1 = T.StructType([keyed.schema["id"], *_BLOCKS.fields[:2], T.StructField("n_bytes", T.LongType()),
                            T.StructField("sha", T.StringType()), T.StructField("gram", T.ArrayType(T.LongType())),
                            *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("p", "first", "last"))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = B.flat(b.column(4))
            for i, j in B.pieces(off):
                n = j - i
                o = off[i:j + 1] - off[i]
                r, p, first, last, h = anchors(data[off[i]:off[j]], o, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, n) for c in range(3)), pa.array(np.diff(o)), b.column(3).slice(i, n),
                     _list(h.view(np.int64), r, n, pa.int64()), *(_list(x, r, n, pa.int32()) for x in (p, first, last))],
                    names=schema1.names)

    base = staged(keyed.select("id", "k1", "k2", F.sha2("text", 256), "text").mapInArrow(find, schema1), "anchors")
    one = base.select("k1", "k2", F.explode(F.arrays_zip("gram", "p", "first", "last")).alias("a")).select("k1", "k2", "a.*")
    grams = staged(one.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    kept = (one.join(grams, "gram").groupBy("k1", "k2")
            .agg(F.collect_list(F.struct("p", "first", "last")).alias("a"))
            .select("k1", "k2", *(F.col(f"a.{c}").alias(c) for c in ("p", "first", "last"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([z.compress(t) for t in b.column(2).to_pylist()], pa.binary())], ["k1", "k2", "z"])

    packed = keyed.where(F.octet_length("text") >= window).select("k1", "k2", "text").mapInArrow(
        pack, T.StructType([*_BLOCKS.fields[:2], T.StructField("z", T.BinaryType())]))
    live = staged(packed.join(kept, ["k1", "k2"]), "live")

    # pass 2: blocks of offsets in the texts that have such anchors
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, data, off, lists in _unpacked(b, 3):
                row, (p, first, last) = lists[0], lists[1:]
                i, blk, sh, u1, u2, ok = block_digests(data, row, p + off[row], first + off[row], last + off[row],
                                                       off[row], off[row + 1], sizes[0], window, gram)
                r = row[i]
                yield _block_batch(k1[r], k2[r], p[i], blk, sh, u1, u2, ok)

    done, todo = _settle(live.select("k1", "k2", "z", "p", "first", "last").mapInArrow(blocks, _BLOCKS), sizes[0])
    spans = [_spans(done, sizes[0], top, window)]

    # the bytes around the blocks not settled
    cut = T.StructType([*_BLOCKS.fields[:4], T.StructField("lo", T.IntegerType()), T.StructField("bytes", T.BinaryType())])

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, data, off, (row, p, blk) in _unpacked(b, 2):
                near, far = blk * sizes[0], np.minimum(blk * sizes[0] + sizes[0] - 1, top)
                q = p + off[row]
                s, e = np.maximum(q - far, off[row]), np.minimum(q - near + window, off[row + 1])
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[row]), pa.array(k2[row]), pa.array(p.astype(np.int32)), pa.array(blk.astype(np.int32)),
                     pa.array((s - off[row]).astype(np.int32)), pa.array([raw[x:y] for x, y in zip(s, e)], pa.binary())], names=cut.names)

    wanted = todo.groupBy("k1", "k2").agg(F.collect_set(F.struct("p", "b")).alias("a")).select(
        "k1", "k2", F.col("a.p").alias("p"), F.col("a.b").alias("b"))
    edge = staged(live.select("k1", "k2", "z").join(wanted, ["k1", "k2"]).mapInArrow(context, cut), "edges")

    # passes 3 and 4: within those bytes
    def finer(size: int, parent: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k1, k2, p, blk, lo = (b.column(c).to_numpy().astype(np.int64) for c in range(5))
                data, off = B.flat(b.column(5))
                rows = np.arange(len(p))
                q = p - lo + off[:-1]                      # the anchor in these bytes
                near, far = blk * parent, np.minimum(blk * parent + parent - 1, top)
                first, last = np.maximum(q - far, off[:-1]), np.minimum(q - near, off[1:] - window)
                i, sub, sh, u1, u2, ok = block_digests(data, rows, q, first, last, off[:-1], off[1:], size, window, gram)
                yield _block_batch(k1[i], k2[i], p[i], sub, sh, u1, u2, ok)
        return run

    done, todo = _settle(edge.mapInArrow(finer(sizes[1], sizes[0]), _BLOCKS), sizes[1])
    spans.append(_spans(done, sizes[1], top, window))
    ratio = sizes[0] // sizes[1]
    todo = todo.distinct().withColumn("sub", F.col("b")).withColumn("b", F.floor(F.col("b") / ratio).cast("int"))
    last_edge = edge.dropDuplicates(["k1", "k2", "p", "b"]).join(todo, ["k1", "k2", "p", "b"]).select(
        "k1", "k2", "p", F.col("sub").alias("b"), "lo", "bytes")
    copies = live.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where("copies > 1")
    last_edge = last_edge.join(copies, ["k1", "k2"], "left").withColumn(
        "times", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).select("k1", "k2", "p", "b", "lo", "bytes")
    done, _ = _settle(last_edge.mapInArrow(finer(1, sizes[1]), _BLOCKS), 1)
    spans.append(_spans(done, 1, top, window))
    ranges = spans[0].unionAll(spans[1]).unionAll(spans[2]).groupBy("k1", "k2").agg(
        F.collect_set(F.struct("s", "e")).alias("spans"))
    return base.select("id", "k1", "k2", "n_bytes", "sha"), live.select("k1", "k2", "z").join(ranges, ["k1", "k2"])


def _spans(done: DataFrame, size: int, top: int, window: int) -> DataFrame:
    near = F.col("b") * size
    return done.select("k1", "k2", (F.col("p") - F.least(near + size - 1, F.lit(top))).alias("s"),
                       (F.col("p") - near + window).alias("e"))


def _unpacked(b: pa.RecordBatch, lists: int) -> Iterator:
    """Rows of (k1, k2, z, list columns), some MB of text at a time: keys, flat
    bytes, offsets, and for every list element its row and the values."""
    z = zstandard.ZstdDecompressor()
    texts: list[bytes] = []
    start = 0
    packed = b.column(2)
    for r in range(b.num_rows):
        texts.append(z.decompress(packed[r].as_py()))
        if r + 1 == b.num_rows or sum(map(len, texts[-64:])) > B.PIECE or len(texts) >= 1000:
            part = b.slice(start, r + 1 - start)
            off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            cols = [part.column(3 + c) for c in range(lists)]
            n = np.diff(cols[0].offsets.to_numpy())
            row = np.repeat(np.arange(len(texts)), n)
            yield (part.column(0).to_numpy(), part.column(1).to_numpy(), np.frombuffer(b"".join(texts), np.uint8), off,
                   (row, *(c.flatten().to_numpy().astype(np.int64) for c in cols)))
            texts, start = [], r + 1


def _block_batch(k1, k2, p, b, shared, u1, u2, ok) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k1), pa.array(k2), pa.array(p.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(shared),
         pa.array(u1, mask=~ok), pa.array(u2, mask=~ok)], names=_BLOCKS.names)


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, n_bytes, ``spans`` (the removed runs, merged:
    start and end in bytes), n_removed, kept_sha256."""
    base, live = repeated_ranges(docs, text_col, id_col, **options)
    span = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
    schema = T.StructType([*_BLOCKS.fields[:2], T.StructField("runs", span), T.StructField("removed", T.LongType()),
                           T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            runs, removed, kept = [], [], []
            for r in range(b.num_rows):
                data = z.decompress(b.column(2)[r].as_py())
                got = b.column(3)[r].values                # spans of this row
                s, e = (got.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.concatenate([[True], s[1:] > e[:-1]]))
                s, e = s[new], e[np.append(new[1:], len(e)) - 1]
                h, pos = hashlib.sha256(), 0
                for x, y in zip(s.tolist(), e.tolist()):
                    h.update(data[pos:x])
                    pos = y
                h.update(data[pos:])
                runs.append([{"s": x, "e": y} for x, y in zip(s.tolist(), e.tolist())])
                removed.append(int((e - s).sum()))
                kept.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(runs, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                 pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    got = live.mapInArrow(cut, schema).dropDuplicates(["k1", "k2"])
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    return base.join(got, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_bytes", F.coalesce("runs", none).alias("spans"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))
