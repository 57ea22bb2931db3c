"""A corpus pipeline of five stages over ``documents``.

Each stage works on all that the one before kept and returns the columns of
``documents`` (the last one returns the encoded documents). Every stage reads
its whole input; what it decides takes effect:

* toxicity: documents with a score of at least 0.3 go;
* duplicates: of each class of near duplicates one document stays;
* decontamination: documents with a benchmark phrase go;
* pii: personal values become pseudonyms, ``n_chars`` follows;
* bpe: ids and decoded text of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, pii, toxicity
from tessera.llm.common import row_key, staged, table
from tessera.llm.queries import tokenizer_path


def _like(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"`{c}`") for c in docs.columns))


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, made longer where ``docs`` has such columns itself."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in have:
            name += "_"
        out.append(name)
    return out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold (no other changes)."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text"))
    return toxicity.score(whole, model, keep=("doc",), evidence=0).where("predicted = 0").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return _like(jaccard_join.keep_one(docs), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark phrase. The hits are few, so only their
    keys are joined back."""
    text_in, k1, k2 = _fresh(docs, "__text_in", "__k1", "__k2")
    hits = decontaminate.find_matches(docs.withColumn(text_in, F.col("text")), table(spark, sf_dir, "benchmark"),
                                      keep=("doc_id", "text"), text_col=text_in, near=None)
    bad = staged(hits.where("size(hits) > 0").select(*row_key("doc_id", "text")).distinct(), "contaminated")
    keyed = docs.withColumns(dict(zip((k1, k2), row_key("doc_id", "text"))))
    return _like(keyed.join(bad.withColumnsRenamed({"k1": k1, "k2": k2}), [k1, k2], "left_anti"), docs)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal values; n_chars is made anew for
    changed texts."""
    found, = _fresh(docs, "__pii")
    got = pii.pseudonymise_table(docs, found_col=found)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return _like(got, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests."""
    got = bpe.encode_decode(docs, tokenizer_path())
    return bpe.digests(got.select("doc_id", "ids", "decoded"), ("doc_id", "ids"))


STAGES = [("toxicity", drop_toxic), ("duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("pii", hide_personal), ("bpe", encode)]
#: SQL cannot express the stages' models and the tokenizer; tests/llm compares
#: the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
