"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces at punctuation and pieces into words. Every word
starts exactly one edge: the four words from there, or fewer at the end of its
piece. Edges are the only things counted in the corpus. An edge joins the node
of its first three words to the node of its last three; what a shorter phrase
occurs is the flow through it: the edges that start with it, plus the short
edges of pieces that end in it.

Words travel as 64-bit hashes (of language and word; the table of all words is
checked for equal hashes, and another seed is taken if there are any). A task
sorts its edges as paths of a word tree, merges equal ones and sends each bucket
its part of the tree with every shared beginning written once. Edges go to
buckets by their first word; a first word with more edges than a bucket holds is
dealt out by its first two words, and two such words by the whole edge. Only the
flows of the latter are partial and summed once more. A bucket therefore holds
a bounded number of edges whatever words are frequent.

Of the frequent edges (``min_count``) unary paths are compacted: where a node
has one edge in and one out, both become one path, found by pointer jumping
(``listrank.chains``), in stretches of at most ``STRETCH`` edges. Paths say which
phrases lie inside longer ones and are themselves the longest repeated phrases.

Defined cases: null texts have no words; null languages are ``und``; equal rows
count each; a table without words gives no phrases. Words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytescan as B
from tessera.llm.common import discard, staged
from tessera.llm.listrank import chains

ORDER = 4              # words of an edge
FLUSH = 1 << 20        # edges that a task holds at a time
BUCKET = 1 << 18       # edges that a bucket holds (more, if they are equal in all tasks)
EACH = 4               # buckets of a task, which has one of them in memory at a time
SLOTS = 1 << 16        # counters of first words, and of first two words
STRETCH = 64           # edges in one row of a path
LEAST = 30
COVERED = 80           # per cent
SCALE = 2_000_000
TOP = 2000

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
KEYS = [f"w{k}" for k in range(1, ORDER + 1)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return B.mix(a * np.uint64(0xA0761D6478BD642F) + b)


def _slot(h: np.ndarray) -> np.ndarray:
    return (B.mix(h ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(SLOTS)).astype(np.int64)


def _lang_hash(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed)


def words_of(langs: list, data: np.ndarray, off: np.ndarray, seed: int):
    """Word hashes, starts, ends, rows and the words left in the piece (itself
    included) of all words of some texts (``data`` lower-cased)."""
    cut = _CUT[data]
    s, e = B.runs(~(cut | _GAP[data]), off)
    row = B.rows_of(s, off)
    salt = np.array([_lang_hash(x, seed) for x in langs], np.uint64)
    h = B.mix(B.span_hashes(data, s, e) ^ salt[row]) | np.uint64(1)           # never zero
    n = len(s)
    cuts = np.cumsum(cut)
    new = np.ones(n + 1, bool)                                                # first words of pieces
    new[1:n] = (cuts[s[1:]] != cuts[s[:-1]]) | (row[1:] != row[:-1])
    ends = np.flatnonzero(new[1:]) + 1
    left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)
    return h, s, e, row, left


def edges_of(h: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The edge from each word: ORDER hashes, zeros behind the end of the piece."""
    g = np.zeros((len(h), ORDER), np.uint64)
    for k in range(ORDER):
        g[: len(h) - k, k] = h[k:]
        g[left <= k, k] = 0
    return g


def _texts(batches: Iterator[pa.RecordBatch], seed: int):
    for b in batches:
        langs = b.column(0).to_pylist()
        data, off = B.flat(b.column(1))
        for i, j in B.pieces(off):
            low = B.LOWER[data[off[i]:off[j]]]
            yield (low, langs[i:j], *words_of(langs[i:j], low, off[i:j + 1] - off[i], seed))


def _slots(docs: DataFrame, seed: int) -> DataFrame:
    """Edges by slot of their first word (level 1) and first two words (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, SLOTS), np.int64)
        for _, _, h, _, _, _, left in _texts(batches, seed):
            g = edges_of(h, left)[left > 1]
            count[0] += np.bincount(_slot(g[:, 0]), minlength=SLOTS)
            count[1] += np.bincount(_slot(_pair(g[:, 0], g[:, 1])), minlength=SLOTS)
        lv, at = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array((lv + 1).astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(count[lv, at])], ["level", "slot", "n"])

    return docs.mapInArrow(run, "level int, slot int, n long").groupBy("level", "slot").agg(F.sum("n").alias("n"))


def _buckets(g: np.ndarray, hot1: np.ndarray, hot2: np.ndarray, n: int) -> np.ndarray:
    one, two = g[:, 0], _pair(g[:, 0], g[:, 1])
    deep = hot1[_slot(one)]
    key = np.where(deep, two, one)
    last = deep & hot2[_slot(two)]
    key = np.where(last, _pair(two, _pair(g[:, 2], g[:, 3])), key)
    return (B.mix(key) % np.uint64(n)).astype(np.int32)


def _merge(g: np.ndarray, count: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges in tree order (by ``first``, then by words) with equal ones merged."""
    keys = [g[:, k] for k in reversed(range(ORDER))] + ([first] if first is not None else [])
    order = np.lexsort(keys)
    g, count = g[order], count[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]).any(1)
    at = np.flatnonzero(new)
    return g[at], np.add.reduceat(count, at) if len(at) else count, (first[order][at] if first is not None else at)


def pack(g: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted edges as bytes: per edge the words it shares with the one before
    and its length, then the new words, then counts above one."""
    same = np.zeros((len(g), ORDER), bool)
    same[1:] = g[1:] == g[:-1]
    start = np.logical_and.accumulate(same, axis=1).sum(1)
    length = (g != 0).sum(1)
    start = np.minimum(start, length - 1)
    flag = (start | (length << 2) | ((count > 1).astype(np.int64) << 5)).astype(np.uint8)
    k = np.arange(ORDER)
    fresh = (k >= start[:, None]) & (k < length[:, None])
    many = count[count > 1].astype(np.int64)
    return np.array([len(g), fresh.sum()], np.int64).tobytes() + flag.tobytes() + g[fresh].tobytes() + many.tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2)
    flag = np.frombuffer(blob, np.uint8, n, 16).astype(np.int64)
    values = np.frombuffer(blob[16 + n:16 + n + 8 * m], np.uint64)
    start, length = flag & 3, (flag >> 2) & 7
    many = flag >> 5 == 1
    count = np.ones(n, np.int64)
    count[many] = np.frombuffer(blob[16 + n + 8 * m:], np.int64)
    at = np.cumsum(length - start) - (length - start)
    g = np.zeros((n, ORDER), np.uint64)
    for k in range(ORDER):
        own = (start <= k) & (k < length)
        src = np.maximum.accumulate(np.where(own, np.arange(n), 0))      # a shared word stands in the last edge that wrote it
        has = k < length
        g[has, k] = values[(at + k - start)[src[has]]]
    return g, count


def _send(docs: DataFrame, hot1: np.ndarray, hot2: np.ndarray, n_buckets: int, seed: int) -> DataFrame:
    """bucket, tree: the edges of two words and more, merged in each task."""
    schema = "bucket int, tree binary"

    def emit(parts: list) -> pa.RecordBatch:
        g = np.concatenate(parts)
        parts.clear()
        g, count, bucket = _merge(g, np.ones(len(g), np.int64), _buckets(g, hot1, hot2, n_buckets))
        at = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
        blobs = [pack(g[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), pa.array(blobs, pa.binary())], ["bucket", "tree"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, _, h, _, _, _, left in _texts(batches, seed):
            g = edges_of(h, left)[left > 1]
            for a in range(0, len(g), FLUSH):
                parts.append(g[a:a + FLUSH])
                held += len(parts[-1])
                if held >= FLUSH:
                    yield emit(parts)
                    held = 0
        if held:
            yield emit(parts)

    return docs.mapInArrow(run, schema)


def _flows(trees: DataFrame, hot1: np.ndarray, hot2: np.ndarray, n_buckets: int, least: int) -> DataFrame:
    """size, w1 .. w4, f, whole: phrases of two to four words and their flow.
    Whole ones below ``least`` are left out; others are parts of a sum."""
    schema = T.StructType([T.StructField("size", T.IntegerType()), *(T.StructField(k, T.LongType()) for k in KEYS),
                           T.StructField("f", T.LongType()), T.StructField("whole", T.BooleanType())])

    def table(size: int, g: np.ndarray, f: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(g), size, np.int32)), *(pa.array(g[:, k].view(np.int64)) for k in range(ORDER)), pa.array(f), pa.array(whole)],
            names=schema.names)

    def phrases(blobs: list) -> Iterator[pa.RecordBatch]:
        g, count = zip(*(unpack(x) for x in blobs))
        g, count, _ = _merge(np.concatenate(g), np.concatenate(count))
        deep = hot1[_slot(g[:, 0])] & hot2[_slot(_pair(g[:, 0], g[:, 1]))]     # dealt out by the whole edge
        for size in range(ORDER, 1, -1):
            at = np.flatnonzero(g[:, size - 1] != 0)                           # edges that go through a phrase of this size
            if not len(at):
                continue
            p, c, part = g[at, :size], count[at], deep[at]
            new = np.append(True, (p[1:] != p[:-1]).any(1))
            first = np.flatnonzero(new)
            f = np.add.reduceat(c, first)
            out = np.zeros((len(first), ORDER), np.uint64)
            out[:, :size] = p[first]
            whole = ~part[first] | (size == ORDER)
            keep = ~whole | (f >= least)
            yield table(size, out[keep], f[keep], whole[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                if k != now and held:
                    yield from phrases(held)
                    held = []
                now = k
                held.append(x.as_py())
        if held:
            yield from phrases(held)

    return trees.repartition(-(-n_buckets // EACH), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, word, key and f of every word: merged in tasks, then summed."""
    schema = "lang string, word string, key long, f long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, names, held = [], [], [], 0

        def emit() -> pa.RecordBatch:
            key, at, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
            f = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            lang, word = (pa.concat_arrays([x[k] for x in names]).take(pa.array(at)) for k in (0, 1))
            for x in (keys, counts, names):
                x.clear()
            return pa.RecordBatch.from_arrays([lang, word.cast(pa.string()), pa.array(key.view(np.int64)), pa.array(f)], ["lang", "word", "key", "f"])

        for low, langs, h, s, e, row, _ in _texts(batches, seed):
            key, at, count = np.unique(h, return_index=True, return_counts=True)
            size = e[at] - s[at]
            body = low[B.ranges(s[at], size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(body.tobytes())])
            keys.append(key)
            counts.append(count)
            names.append((pa.array(langs, pa.string()).take(pa.array(row[at])), word.cast(pa.large_string())))
            held += len(key) + int(size.sum()) // 16
            if held >= FLUSH:
                yield emit()
                held = 0
        if held:
            yield emit()

    return docs.mapInArrow(run, schema).groupBy("lang", "word", "key").agg(F.sum("f").alias("f"))


def graph(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(phrases, words). phrases: id, size, w1 .. w4 (word keys), f of all
    phrases of two to four words with f >= least; words: lang, word, key, f of
    all words."""
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    for seed in range(16):
        words = staged(_words(docs, seed), "words")
        if words.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            break
        discard(words)
    else:
        raise RuntimeError("two words have the same hash under every seed")
    slots = staged(_slots(docs, seed), "slots")
    n_buckets = max(1, -(-int(slots.where("level = 1").agg(F.sum("n")).first()[0] or 0) // bucket))
    hot = np.zeros((3, SLOTS), bool)
    for r in slots.where(F.col("n") > bucket).select("level", "slot").collect():      # at most 2 * n_buckets rows
        hot[r.level, r.slot] = True
    trees = _send(docs, hot[1], hot[2], n_buckets, seed)
    flows = staged(_flows(trees, hot[1], hot[2], n_buckets, least), "flows")
    part = flows.where("not whole").groupBy("size", *KEYS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    found = flows.where("whole").select("size", *KEYS, "f").unionAll(part)
    phrases = staged(found.select(F.monotonically_increasing_id().alias("id"), "*"), "phrases")
    discard(slots, flows)
    return phrases, words


def compact(phrases: DataFrame) -> DataFrame:
    """Unary paths of the edges (phrases of ORDER words): head, part, words
    (word keys) and flow (of its edges, in order). A path of more than
    ``STRETCH`` edges has several parts."""
    edges = phrases.where(F.col("size") == ORDER).select("id", *KEYS, "f")
    ins = edges.groupBy(*(F.col(k).alias(f"n{i}") for i, k in enumerate(KEYS[1:]))).agg(F.count("*").alias("ins"), F.min("id").alias("prev"))
    outs = edges.groupBy(*(F.col(k).alias(f"n{i}") for i, k in enumerate(KEYS[:-1]))).agg(F.count("*").alias("outs"), F.min("id").alias("id"))
    links = ins.where("ins = 1").join(outs.where("outs = 1"), ["n0", "n1", "n2"]).select("id", "prev")
    at = chains(edges.select("id").join(links, "id", "left"))
    return at.join(edges, "id").groupBy("head", F.expr(f"rank div {STRETCH}").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("rank", *KEYS, "f"))).alias("e")).select(
        "head", "part", F.concat(F.array(*(F.col("e")[0][k] for k in KEYS[:-1])), F.col("e")[KEYS[-1]]).alias("words"), F.col("e.f").alias("flow"))


def covers(phrases: DataFrame, paths: DataFrame) -> DataFrame:
    """size, w1 .. w3, longest: for phrases of two and three words the largest
    flow of a longer phrase that holds them. Those of ORDER words are read off
    the paths, where neighbours share what they hold."""
    inside = []
    for size in (2, 3):
        # the phrase from word i lies in the edges i - (ORDER - size) .. i
        reach = f"array_max(slice(flow, greatest(i - {ORDER - size}, 0) + 1, least(i, size(flow) - 1) - greatest(i - {ORDER - size}, 0) + 1))"
        last = "w[i + 2]" if size == 3 else "0L"
        inside.append(f"transform(sequence(0, size(w) - {size}), i -> struct({size} as size, w[i] as w1, w[i + 1] as w2, {last} as w3, {reach} as f))")
    rows = paths.withColumnRenamed("words", "w").select(F.explode(F.expr(f"concat({', '.join(inside)})")).alias("x")).select("x.*")
    three = phrases.where("size = 3").select(F.expr("inline(array(struct(2 as size, w1, w2, 0L as w3, f), struct(2 as size, w2 as w1, w3 as w2, 0L as w3, f)))"))
    return rows.unionAll(three).groupBy("size", "w1", "w2", "w3").agg(F.max("f").alias("longest"))


def score(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates (phrases) with lang, l, r and score of their lowest-scoring cut."""
    cuts = []
    for size in range(2, ORDER + 1):
        rows = []
        for cut in range(1, size):
            for side, a, b in (("l", 0, cut), ("r", cut, size)):
                w = [*KEYS[a:b], *["0L"] * (ORDER - 1 - (b - a))]
                rows.append(f"struct({cut} as cut, '{side}' as side, {b - a} as size, {w[0]} as w1, {w[1]} as w2, {w[2]} as w3)")
        cuts.append(f"WHEN size = {size} THEN array({', '.join(rows)})")
    asked = phrases.select("id", "f", F.explode(F.expr(f"CASE {' '.join(cuts)} END")).alias("x")).select("id", F.col("f").alias("a"), "x.*")
    zero = F.lit(0).cast("long")
    known = words.select(F.lit(1).alias("size"), F.col("key").alias("w1"), zero.alias("w2"), zero.alias("w3"), "f", "lang").unionAll(
        phrases.where("size < 4").select("size", "w1", "w2", "w3", "f", F.lit(None).cast("string").alias("lang")))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    cut = asked.join(known, ["size", "w1", "w2", "w3"]).groupBy("id", "a", "cut").agg(side("l"), side("r"), F.max("lang").alias("lang"))
    big = F.expr(f"CAST(a AS DECIMAL(20,0)) * {SCALE} div (CAST(l AS DECIMAL(20,0)) + r)")
    return cut.withColumn("score", big).groupBy("id", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("low"), F.max("lang").alias("lang")).select(
        "id", "a", "lang", "low.l", "low.r", "low.score", "low.cut")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, covered: int = COVERED,
                 top: int = TOP, **options) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, words (array),
    a, l, r, cut, n, score. Phrases inside a longer one that has at least
    ``covered`` per cent of their count are left out."""
    phrases, words = graph(docs, text_col, lang_col, least, **options)
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    inside = covers(phrases, compact(phrases))
    hidden = phrases.where("size < 4").join(inside, ["size", "w1", "w2", "w3"]).where(
        F.col("longest").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * covered).select("id")
    good = staged(score(phrases, frequent).join(hidden, "id", "left_anti"), "scored")
    # first within shares of each language, then over what they let through
    shares = max(1, good.count() // 50_000)
    best = [F.col("score").desc(), F.col("a").desc()]
    for part in (["lang", F.pmod(F.xxhash64("id"), F.lit(shares))], ["lang"]):
        good = good.withColumn("place", F.rank().over(Window.partitionBy(*part).orderBy(*best))).where(F.col("place") <= top).drop("place")
    named = good.join(phrases.select("id", "size", *KEYS), "id").select("*", F.posexplode(F.expr("slice(array(w1, w2, w3, w4), 1, size)")).alias("p", "key"))
    named = named.join(frequent.select("key", "word"), "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("p", "word")))["word"].alias("words"))
    w = Window.partitionBy("lang").orderBy(*best, "phrase")
    return (good.join(named, "id").withColumn("phrase", F.concat_ws(" ", "words")).withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "words", "a", "l", "r", "cut", "n", "score"))
