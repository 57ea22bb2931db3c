"""Search of a positional index for a query set of any size, by Spark joins.

The windows of the benchmark's items are a table, never driver data. One pass
over the documents writes the positional index: per document the hashes and
places of all words that the benchmark may hold, told by a bitmap of fixed size
(2 MB; a word let through by accident only lengthens the index). Terms are
counted once, and each window's terms ordered from rare to frequent. Postings of
the windows' rarest terms, with the terms around them, then meet the windows in
one join on the term: its condition holds the offset-adjusted terms of the
window against those around the posting, so only matches leave the join. A
frequent rarest term is a skewed key of a plain inner join, which AQE splits.

Results, also for null, empty and repeated rows, are those of ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bytescan as B
from tessera.llm.common import row_key, staged

BITS = 1 << 24
ROWS = 1 << 15
KEYS, WIN = ["k1", "k2"], ["w1", "w2"]


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """One row per window of every item: ``item``, ``terms`` (word hashes), and
    the window's keys ``w1``, ``w2``."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"),
                             F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = B.flat(b.column(1))
            for i, j in B.pieces(off):
                h, row = B.word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n = B.per_row(row, j - i)
                each = np.where(n >= window, n - window + 1, np.minimum(n, 1))
                item = np.repeat(np.arange(j - i), each)
                start = B.ranges(np.cumsum(n) - n, each)
                size = np.minimum(n, window)[item]
                for a in range(0, len(item), ROWS):
                    s, k = start[a:a + ROWS], size[a:a + ROWS]
                    terms = _lists(h[B.ranges(s, k)].view(np.int64), np.concatenate([[0], np.cumsum(k)]))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(item[a:a + ROWS] + i)), terms], ["item", "terms"])

    return items.mapInArrow(run, "item string, terms array<bigint>").withColumns(
        {"w1": F.xxhash64("terms"), "w2": F.xxhash64(F.lit("second"), "terms")})


def bitmap(terms: DataFrame) -> np.ndarray:
    """The low bits of the hashes ``h`` as a packed bitmap of ``BITS`` bits:
    at most 512 rows of 4 KB reach the driver, however many hashes there are."""
    x = F.pmod("h", F.lit(BITS)) + 1
    out = np.zeros(BITS // 8, np.uint8)
    for r in terms.groupBy(F.bitmap_bucket_number(x).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias("m")).collect():
        out[(r["b"] - 1) * 4096: r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    x = h.view(np.uint64) & np.uint64(BITS - 1)
    return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def positions(docs: DataFrame, bits: np.ndarray, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The positional index: per document ``n_words``, the hashes of the words
    in ``bits`` and their places."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    keyed = docs.select(*keep, F.col(text_col).cast("string").alias("__text")).withColumns(
        dict(zip(KEYS, row_key(*keep, "__text"))))
    cols = [*keep, *KEYS]
    schema = T.StructType([keyed.schema[c] for c in cols] + [
        T.StructField("n_words", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType())),
        T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = B.flat(b.column(len(cols)))
            for i, j in B.pieces(off):
                h, row = B.word_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
                n = B.per_row(row, j - i)
                ok = np.flatnonzero(_has(shared.value, h))
                cut = np.searchsorted(row[ok], np.arange(j - i + 1))
                place = (ok - (np.cumsum(n) - n)[row[ok]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in range(len(cols))), pa.array(n),
                     _lists(h[ok].view(np.int64), cut), _lists(place, cut)], names=schema.names)

    return keyed.select(*cols, "__text").mapInArrow(run, schema)


def postings(index: DataFrame, bits: np.ndarray, reach: int) -> DataFrame:
    """Postings (``h``, document, place ``p``) of the terms in ``bits``, with
    the ``reach`` terms on either side (0: none, or none of the index)."""
    shared = index.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy()
            for i, j in B.pieces(np.concatenate([[0], np.cumsum(n)]), 1 << 20):
                part, size = b.slice(i, j - i), n[i:j] + reach
                base = reach + np.cumsum(size) - size                # blank places between documents
                each = pc.list_value_length(part.column(3)).to_numpy()
                doc = np.repeat(np.arange(j - i), each)
                term, place = (part.column(c).flatten().to_numpy() for c in (3, 4))
                tok = np.zeros(int(size.sum()) + reach, np.int64)
                tok[base[doc] + place] = term
                some = np.flatnonzero(_has(shared.value, term))
                for a in range(0, len(some), ROWS):
                    at = some[a:a + ROWS]
                    around = tok[(base[doc[at]] + place[at])[:, None] + np.arange(-reach, reach + 1)]
                    key = pa.array(doc[at])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(term[at]), part.column(0).take(key), part.column(1).take(key), pa.array(place[at].astype(np.int64)),
                         _lists(around.ravel(), np.arange(len(at) + 1) * (2 * reach + 1))], ["h", *KEYS, "p", "around"])

    return index.select(*KEYS, "n_words", "terms", "places").mapInArrow(
        run, "h bigint, k1 bigint, k2 bigint, p bigint, around array<bigint>")


def rare_first(windows: DataFrame, index: DataFrame) -> DataFrame:
    """Windows all of whose terms occur in the corpus: ``terms``, the rarest
    one's hash ``h`` and offset ``o``, and the next two (null: none)."""
    counts = index.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("c"))
    ranked = (windows.select(*WIN, F.posexplode("terms").alias("off", "h")).join(counts, "h", "left")
              .groupBy(*WIN).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "off", "h"))).alias("r"))
              .where("r[0].c > 0"))
    in_place = F.array_sort(F.transform("r", lambda x: F.struct(x["off"], x["h"])))
    return ranked.select(*WIN, F.transform(in_place, lambda x: x["h"]).alias("terms"), F.expr("r[0].h").alias("h"),
                         F.expr("r[0].off").alias("o"), F.get("r", F.lit(1))["h"].alias("h2"), F.get("r", F.lit(2))["h"].alias("h3"))


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str, keep: tuple[str, ...], id_col: str, item_text: str,
                 window: int, near: int | None) -> DataFrame:
    """``keep``, ``n_words``, ``hits``, ``items``, ``near_items`` of every document."""
    every = item_windows(benchmark, id_col, item_text, window)
    windows = staged(every.groupBy(*WIN).agg(F.first("terms").alias("terms")), "windows")
    vocab = windows.select(F.explode("terms").alias("h"))
    index = staged(positions(docs, bitmap(vocab), text_col, keep), "positions")
    ranked = staged(rare_first(windows, index), "ranked")
    reach = max(window - 1, near or 0)
    exact = F.slice("around", F.lit(reach + 1) - F.col("o"), F.size("terms")) == F.col("terms")
    close = F.lit(False)
    if near is not None:
        by = F.slice("around", reach + 1 - near, 2 * near + 1)
        close = (F.col("h2").isNull() | F.array_contains(by, F.col("h2"))) & (F.col("h3").isNull() | F.array_contains(by, F.col("h3")))
    met = staged(postings(index, bitmap(ranked.select("h")), reach).join(ranked, "h").where(exact | close).select(
        *WIN, *KEYS, (F.col("p") - F.col("o")).alias("s"), F.size("terms").alias("n"), exact.alias("exact"), close.alias("close")).distinct(), "met")

    order = Window.partitionBy(*KEYS).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = met.where("exact").select(*KEYS, "s", (F.col("s") + F.col("n")).alias("e")).distinct()
    runs = (spans.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int"))
            .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(*KEYS, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
            .groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("hits")))
    items = (met.groupBy(*WIN, *KEYS).agg(F.max("exact").alias("exact"), F.max("close").alias("close"))
             .join(every.select(*WIN, "item").distinct(), WIN).groupBy(*KEYS)
             .agg(*(F.array_sort(F.collect_set(F.when(F.col(c), F.col("item")))).alias(a) for c, a in (("exact", "items"), ("close", "near_items")))))
    found = items.join(runs, KEYS, "left")
    none = {"hits": "array<struct<s:bigint,e:bigint>>", "items": "array<string>", "near_items": "array<string>"}
    return index.select(*keep, *KEYS, "n_words").join(found, KEYS, "left").select(
        *keep, "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in none.items()))
