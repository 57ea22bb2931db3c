"""Set-similarity join of documents on word shingles by chosen paths.

Every document is its set of five-word shingles; documents with equal sets are
one node. A node has ``TOKENS`` sampled tokens (min-hashes), on which two nodes
of similarity s agree at any place with probability s. A run starts with all
nodes in one bucket and splits buckets recursively: the bucket's path selects
one or two places (1.25 on average, the reciprocal of the threshold), and nodes
that share the token there go on together. Buckets of at most ``small`` nodes
are brute-forced on the sampled tokens; larger ones are split again, until a split
leaves at least ``ALIKE`` of the bucket together or ``depth`` is reached: what
then stays together is one candidate group. Runs are repeated until a pair at
the threshold is met with ``recall``.

Candidate groups (connected candidates) are then compared exactly, set by set,
in blocks of about ``BLOCK`` nodes, so that a huge group is many small tasks.
The result is one row per document: its class (connected documents of
similarity >= threshold) and its number of links (documents linked to it). No
pair is emitted: tasks give counts and a spanning forest. Counting the links of
a group of k different near copies compares k * k / 2 sets inside the blocks.

Paths, bucket sizes and recursion are column expressions; Python runs for
shingling, bucket comparison and exact comparison. Hot buckets are counted with
partial aggregates before anything is gathered.

Defined cases: words are lower-cased runs of letters, digits and non-ASCII
characters; a text of one to four words is one shingle; a text without words
(null, empty) has no set, no link and its own class. Equal rows link to each
other. ``class_id`` is the smallest id in the class (null is smallest).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytescan as B
from tessera.llm.common import components, row_key, staged

SHINGLE = 5
THRESHOLD = 0.8
TOKENS = 64
SMALL = 256
DEPTH = 8
BLOCK = 256
ALIKE = 0.7
_rng = np.random.default_rng(11)
_MULT = _rng.integers(0, 2**64, TOKENS, dtype=np.uint64) | np.uint64(1)
_FOLD = np.uint64(0xA0761D6478BD642F)


def runs_needed(recall: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold was in one bucket with
    probability ``recall``, even if all its buckets were split to ``depth``."""
    lost = 0.0
    for _ in range(depth):
        x = 1 - threshold + threshold * lost
        lost = 0.75 * x + 0.25 * x * x
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingles(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every row, by row: hashes and row bounds."""
    n = len(off) - 1
    low = B.LOWER[data]
    s, e = B.runs(B.ALNUM[low], off)
    row = B.rows_of(s, off)
    h = B.span_hashes(low, s, e)
    words = B.per_row(row, n)
    first = np.cumsum(words) - words
    # short texts: their last words stand in for the missing ones as zeros
    count = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    at = B.ranges(first, count)
    owner = np.repeat(np.arange(n), count)
    end = (first + words)[owner]
    g = np.zeros(len(at), np.uint64)
    padded = np.append(h, np.zeros(size, np.uint64))
    for k in range(size):
        g = B.mix(g * _FOLD + np.where(at + k < end, padded[at + k], np.uint64(k + 1)))
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
    g, owner = g[new], owner[new]
    return g, np.searchsorted(owner, np.arange(n + 1))


def tokens(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sampled tokens (min-hashes) of every non-empty row, as int32."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, TOKENS), np.int32)
    if len(full):
        for k in range(TOKENS):
            v = (B.mix(g ^ _MULT[k]) >> np.uint64(32)).astype(np.uint32)
            out[full, k] = np.minimum.reduceat(v, bounds[full]).view(np.int32)
    return out


def sketches(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Per document: keys, set hash (null for an empty set), its size and its
    sampled tokens."""
    keyed = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    keyed = keyed.select(*keep, *row_key(*keep, "__text"), "__text")
    nk = len(keep) + 2
    schema = T.StructType([*keyed.schema.fields[:nk], T.StructField("node", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("tok", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = B.flat(b.column(nk))
            for i, j in B.pieces(off):
                g, bounds = shingles(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n = np.diff(bounds)
                tot = np.concatenate([[np.uint64(0)], np.cumsum(B.mix(g))])
                node = B.mix(tot[bounds[1:]] - tot[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)
                tok = tokens(g, bounds)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in range(nk)), pa.array(node, mask=n == 0), pa.array(n),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * TOKENS, TOKENS, dtype=np.int32)),
                                              pa.array(tok.ravel()))], names=schema.names)

    return keyed.mapInArrow(run, schema)


def _children(path: Column, tok: str = "tok") -> Column:
    """The paths that a node takes from a bucket: one or two chosen places."""
    def step(k: int) -> Column:
        place = F.pmod(F.xxhash64(path, F.lit(k)), F.lit(TOKENS)).cast("int")
        return F.xxhash64(path, place, F.get(tok, place))
    both = F.pmod(F.xxhash64(path, F.lit("two")), F.lit(4)) == 0
    return F.when(both, F.array(step(1), step(2))).otherwise(F.array(step(1)))


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest place connected to each of n places by the pairs a, b."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            return label


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches cut at the borders of groups of equal keys (sorted input): a
    table of whole groups and the group bounds."""
    rest: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        cut = _bounds(t, n_keys)
        if len(cut) > 2:
            yield t.slice(0, int(cut[-2])).combine_chunks(), cut[:-1]
        rest = t.slice(int(cut[-2])) if len(cut) > 1 else None
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), np.array([0, rest.num_rows])


def _bounds(t: pa.Table, n_keys: int) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    if t.num_rows:
        new[0] = True
    for k in range(n_keys):
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)


def compare_buckets(leaves: DataFrame, cut: float, threshold: float) -> DataFrame:
    """Spanning forest (a, b) of the nodes in a bucket that agree on at least
    ``cut`` of their sampled tokens and whose sizes allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(batches, 1):
            node, size = t.column(1).to_numpy(), t.column(2).to_numpy()
            tok = t.column(3).combine_chunks()
            tok = (tok.chunk(0) if isinstance(tok, pa.ChunkedArray) else tok).flatten().to_numpy().reshape(-1, TOKENS)
            left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(node)) - 1   # later rows of the bucket
            a_all, b_all = [], []
            done = np.cumsum(left)
            i = 0
            while i < len(node):                           # some ten thousand pairs at a time
                j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + 40_000, "right")))
                a = np.repeat(np.arange(i, j), left[i:j])
                b = B.ranges(np.arange(i, j) + 1, left[i:j])
                ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
                a, b = a[ok], b[ok]
                ok = (tok[a] == tok[b]).mean(1) >= cut
                a_all.append(a[ok])
                b_all.append(b[ok])
                i = j
            label = _forest(np.concatenate(a_all), np.concatenate(b_all), len(node))
            at = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])

    return leaves.repartition("path").sortWithinPartitions("path", "node").mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, threshold: float, recall: float, small: int, depth: int) -> DataFrame:
    """Candidate edges (a, b) between nodes: node, n, tok."""
    runs = runs_needed(recall, threshold, depth)
    cut = threshold - 4 * math.sqrt(threshold * (1 - threshold) / TOKENS)
    at = nodes.select("node", "tok", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"))
    rows = at.select("node", F.explode(_children(F.xxhash64(F.lit("run"), "run"))).alias("path"))
    rows = rows.withColumn("parent", F.lit(None).cast("long"))
    edges = None
    for level in range(1, depth + 1):
        rows = staged(rows, f"paths{level}")
        size = staged(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), f"sizes{level}")
        rows = staged(rows.join(size, "path"), f"buckets{level}")
        leaf = rows.where(F.col("size") <= small).join(nodes, "node").select("path", "node", "n", "tok")
        got = compare_buckets(leaf, cut, threshold)
        edges = got if edges is None else edges.unionAll(got)
        big = rows.where(F.col("size") > small)
        if big.isEmpty():
            return edges
        # a bucket that a chosen place hardly split is a group of like nodes: one candidate group
        alike = big.where(F.lit(level == depth) | (F.col("size") >= ALIKE * F.col("parent")))
        low = alike.groupBy("path").agg(F.min("node").alias("b"))
        edges = edges.unionAll(alike.join(staged(low, f"alike{level}"), "path").where("node <> b").select(F.col("node").alias("a"), "b"))
        if level < depth:
            rows = (big.where(F.col("parent").isNull() | (F.col("size") < ALIKE * F.col("parent"))).join(nodes, "node")
                    .select("node", F.explode(_children(F.col("path"))).alias("path"), F.col("size").alias("parent")))
    return edges


def _intersections(g: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 columns that two or more
    sets have, some thousand columns at a time."""
    u, at, count = np.unique(g, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    col, own = at[shared], own[shared]
    place = np.cumsum(count > 1) - 1
    col = place[col]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(col, kind="stable")
    col, own = col[order], own[order]
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        s = slice(*np.searchsorted(col, (lo, lo + 4096)))
        m = np.zeros((n, min(4096, int(col[-1]) + 1 - lo)), np.float32)
        m[own[s], col[s] - lo] = 1
        out += m @ m.T
    return out


def verify(members: DataFrame, threshold: float) -> DataFrame:
    """Exact comparison in blocks. ``members``: root, i, j (block pair), side,
    node, docs (documents with that set), text. Gives, per node and block
    pair, the number of documents linked to it and its forest edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _groups(batches, 3):
            i_, j_, side, node, docs = (t.column(c).to_numpy() for c in (1, 2, 3, 4, 5))
            sets = t.column(6).combine_chunks()
            data, off = B.flat(sets)
            g = np.frombuffer(data.tobytes(), np.uint64)
            off = off // 8
            out = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                n = int(b - a)
                size = np.diff(off[a:b + 1]).astype(np.float32)
                inter = _intersections(g[off[a]:off[b]], np.repeat(np.arange(n), np.diff(off[a:b + 1])), n)
                link = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-4
                np.fill_diagonal(link, False)
                if i_[a] != j_[a]:                         # two blocks: only pairs across
                    link &= side[a:b, None] != side[None, a:b]
                x, y = np.nonzero(np.triu(link))
                label = _forest(x, y, n)
                links = link @ docs[a:b].astype(np.float64)
                at = np.flatnonzero(links > 0)
                out.append((node[a:b][at], links[at].astype(np.int64), node[a:b][label[at]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links", "b"])

    return (members.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
            .mapInArrow(run, "node long, links long, b long"))


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """The last column (text) replaced by the sorted shingle hashes (binary)."""
    names = rows.columns[:-1]
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("sets", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = B.flat(b.column(len(names)))
            for i, j in B.pieces(off):
                g, bounds = shingles(data[off[i]:off[j]], off[i:j + 1] - off[i])
                sets = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), j - i, [None, pa.py_buffer((bounds * 8).astype(np.int64)), pa.py_buffer(g)])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in range(len(names))),
                                                  sets.cast(pa.binary())], names=schema.names)

    return rows.mapInArrow(run, schema)


def similar_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD,
                      recall: float = 0.995, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """One row per document: id, k1, k2 (row key), n_shingles, class_id,
    n_links (other documents of similarity >= threshold), set_rows (documents
    with its very set)."""
    keep = (id_col,)
    base = staged(sketches(docs, text_col, keep), "sketches")
    low = F.min(F.struct(F.col(id_col).alias("id"), "k1", "k2")).alias("low")
    nodes = staged(base.where("node is not null").groupBy("node").agg(
        low, F.count("*").alias("docs"), F.first("n").alias("n"), F.first("tok").alias("tok")), "nodes")
    cand = components(candidates(nodes.select("node", "n", "tok"), threshold, recall, small, depth))
    member = cand.unionAll(cand.select(F.col("root").alias("node"), "root").distinct())
    blocks = member.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    member = member.join(blocks, "root").join(nodes.select("node", "docs", "low"), "node").withColumn(
        "own", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    text = docs.select(id_col, F.col(text_col).cast("string").alias("text")).select(*row_key(id_col, "text"), "text")
    # the text of one document of each set (equal rows: any of them)
    sets = staged(_shingle_sets(
        member.select("root", "nb", "own", "node", "docs", F.col("low.k1").alias("k1"), F.col("low.k2").alias("k2"))
        .join(text, ["k1", "k2"]).select("root", "nb", "own", "node", "docs", "text")).dropDuplicates(["node"]), "sets")
    pairs = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "root", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"),
        F.col("own").alias("side"), "node", "docs", "sets")
    found = staged(verify(pairs, threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("node <> b").select(F.col("node").alias("a"), "b"))
    info = (nodes.select("node", "docs", "low").join(links, "node", "left").join(classes, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))
    info = staged(info, "info")
    top = info.groupBy("root").agg(F.min("low").alias("first"))
    info = info.join(top, "root").select(
        "node", F.col("first.id").alias("class_id"), F.col("first.k1").alias("c1"), F.col("first.k2").alias("c2"),
        (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"), F.col("docs").alias("set_rows"))
    return base.drop("tok").join(info, "node", "left").select(
        id_col, "k1", "k2", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("set_rows", F.lit(1)).cast("long").alias("set_rows"),
        F.coalesce("c1", "k1").alias("c1"), F.coalesce("c2", "k2").alias("c2"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """All columns of one document of each class (the one of smallest id; of
    equal rows, any one). Texts without words all stay."""
    found = similar_documents(docs, text_col, id_col, **options)
    stay = found.select("k1", "k2", (F.col("n_shingles") == 0).alias("empty"),
                        ((F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))).alias("first")).where("first or empty").distinct()
    t = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
                        F.xxhash64(F.col(f"`{id_col}`"), t).alias("k1"),
                        F.xxhash64(F.lit("second"), t, F.col(f"`{id_col}`")).alias("k2"))
    from pyspark.sql import Window as W
    nth = F.row_number().over(W.partitionBy("k1", "k2").orderBy("empty"))
    return keyed.join(stay, ["k1", "k2"]).withColumn("nth", nth).where("nth = 1 or empty").select("d.*")
