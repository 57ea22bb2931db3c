"""Licence scan: a trained paragraph classifier confirmed by templates.

Paragraphs (lines with a letter or digit of any script) and the ends of lines
with what follows (a notice may be wrapped over lines) become sparse counts of
the words and word pairs that the notices in ``NOTICES`` use; a multinomial logistic regression names the
licence family, ``unknown`` (a licence statement of no known family) or
``none``. It is trained on the notices and short names, alone and inside prose, and on
all of the corpus's own lines that share no word pair with a notice as ``none``
(counted by the words the model knows; three quarters of the lines by a hash, a
third of those only around notices). The other quarter, held out whole,
calibrates the least probability that a family needs: what falls below it is
``unknown``. A family is confirmed if its paragraph holds enough of the word
pairs of one of the family's notices, else it counts as unknown as well.

DataFrame, SQL and Spark ML expressions only; no Python runs on executors. Only
paragraphs that name a licence are shuffled (to their documents); the model and
the notices are fixed in size.

Defined cases: null and empty texts have no paragraphs; repeated paragraphs
count each time; equal rows get equal results; ties between families go to the
first in ``FAMILIES``; with no documents only the notices train the
model.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import row_key, staged

#: Public licence notices by family.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
    ],
    "unknown": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "Licensed under the terms in the license file.",
        "Released under a custom license.",
        "This work is licensed under the license agreement of its owner.",
        "Distributed under a proprietary license.",
        "Licensed under the Eclipse Public License 2.0, EPL-2.0.",
        "Distributed under the ISC License.",
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the European Union Public Licence.",
        "Licensed under the EUPL.",
        "This is free and unencumbered software released into the public domain.",
        "This software may be used only with written permission of the vendor.",
        "May not be copied or redistributed without prior written permission of the copyright holder.",
    ],
}
#: Names as short statements use them: they train the model and confirm a family as the notices do.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["Apache 2.0", "Apache License 2.0"],
    "MIT": ["MIT License", "License: MIT", "Licensing: MIT"],
    "BSD": ["BSD-3-Clause", "BSD License"],
    "GPL": ["GPL v3", "GPL-3.0-only", "GNU GPL 3.0"],
    "LGPL": ["LGPL v2.1 or later", "LGPL-2.1-only", "GNU LGPL 2.1"],
    "AGPL": ["AGPL v3", "AGPL-3.0-only", "GNU AGPL 3.0"],
    "MPL-2.0": ["MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public v. 2.0"],
    "CC-BY": ["CC-BY 4.0"],
    "CC-BY-SA": ["CC-BY-SA 4.0"],
    "CC-BY-NC": ["CC-BY-NC 4.0"],
    "CC0": ["CC0 1.0"],
}
STATEMENTS = {f: [*ns, *NAMES.get(f, [])] for f, ns in NOTICES.items()}
NONE = "none"
FAMILIES = [*NOTICES, NONE]
COVERAGE = 0.6


def _words(col):
    return F.filter(F.split(F.lower(col), "[^a-z0-9]+"), lambda w: w != "")


#: Weight of all prose lines together in training.
PROSE = 6_000


def _terms(df: DataFrame, line: str = "line") -> DataFrame:
    df = df if "words" in df.columns else df.withColumn("words", _words(F.col(line)))
    df = NGram(n=2, inputCol="words", outputCol="pairs").transform(df)
    return df.withColumn("terms", F.concat("words", "pairs"))


def _features(df: DataFrame, line: str = "line") -> DataFrame:
    return _counted(_terms(df, line))


def _counted(df: DataFrame) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(_vocabulary(), "terms", "features", binary=True).transform(df)


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _pairs(text: str) -> list[str]:
    w = _tokens(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def _vocabulary() -> list[str]:
    return sorted({t for notices in STATEMENTS.values() for n in notices for t in [*_tokens(n), *_pairs(n)]})


#: Words of the longest notice: what a wrapped one has at most on either side of a line's end.
REACH = max(len(_tokens(n)) for notices in NOTICES.values() for n in notices)


def margins(model: LogisticRegressionModel) -> tuple[float, dict[str, float]] | None:
    """(start, gain of each word): a bound on how far a family can be ahead of
    ``none``. A family's margin is its intercept and the weights of the terms
    present. A pair's weight is put down to the more telling of its words, without
    which it cannot be present; a word's gain is the largest sum of positive
    weights that any family has there. If start and the gains of its distinct
    words stay below zero, the model says ``none`` to a text. None if the
    intercepts alone speak for a family."""
    terms = _vocabulary()
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    gain, bias = np.maximum(coef[:-1] - coef[-1], 0), bias[:-1] - bias[-1]
    if bias.max() >= 0:
        return None
    alone = {t: gain[:, k].max() for k, t in enumerate(terms) if " " not in t}
    weight = {w: np.zeros(len(bias)) for w in alone}
    for k, t in enumerate(terms):
        weight[max(t.split(" "), key=lambda w: (alone[w], w))] += gain[:, k]
    return float(bias.max()), {w: float(x.max()) for w, x in sorted(weight.items()) if x.max() > 0}


def _gain(words, gains: dict[str, float]):
    """Sum of the gains of the distinct words."""
    gain = F.create_map(*[F.lit(x) for kv in gains.items() for x in kv])
    known = F.array_distinct(F.filter(words, lambda x: x.isin(*gains)))
    return F.aggregate(known, F.lit(0.0), lambda t, x: t + F.element_at(gain, x))


def paragraphs(docs: DataFrame, text_col: str, bound: tuple[float, dict[str, float]] | None = None) -> DataFrame:
    """Keys, place, last place and words of every line, and of every line's end
    (``wrapped``): its last ``REACH`` words with the next line, the next two and
    so on, up to ``REACH`` words or a line without one. With ``bound`` (from
    ``margins``), those that the model must call ``none`` are left out by their own
    words; windows are only made where the words of all their lines could be more."""
    lines = docs.withColumn("__w", F.transform(F.split(F.col(text_col), "\n"), _words)).withColumn(
        "__h", F.transform("__w", lambda w: F.slice(w, 1, REACH)))
    if bound is not None:
        lines = lines.withColumn("__s", F.transform("__w", lambda w: _gain(w, bound[1])))

    def may(gain):
        """Whether words of that gain could be more than prose."""
        return F.lit(True) if bound is None else gain() + bound[0] >= -1e-6

    def taken(i):
        """(n, c, s): the words, number and gain of the lines that the windows of
        line i take in, up to a line without words or ``REACH`` words."""
        near = F.arrays_zip(F.slice("__h", i + 2, REACH).alias("h"), F.slice("__s" if bound else "__h", i + 2, REACH).alias("s"))

        def step(t, x):
            n = F.size(x["h"])
            on = F.struct((t["n"] + n).alias("n"), (t["c"] + 1).alias("c"), (t["s"] + (x["s"] if bound else F.lit(0.0))).alias("s"))
            return F.when((t["n"] < REACH) & (n > 0), on).otherwise(F.struct(F.lit(REACH).alias("n"), t["c"].alias("c"), t["s"].alias("s")))

        return F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0.0).alias("s")), step)

    def crossing(w, i):
        tail = F.slice(w, F.greatest(F.size(w) - (REACH - 1), F.lit(1)), REACH)
        there = F.filter(F.array(taken(i)), lambda m: (F.size(w) > 0) & (m["c"] > 0) & may(lambda: F.get(F.col("__s"), i) + m["s"]))
        after = F.transform(there, lambda m: F.slice("__h", i + 2, m["c"]))
        windows = F.flatten(F.transform(after, lambda a: F.transform(F.sequence(F.lit(1), F.size(a)), lambda c: F.struct(
            i.alias("place"), (i + c).alias("last"), F.lit(True).alias("wrapped"),
            F.concat(tail, F.slice(F.flatten(F.slice(a, 1, c)), 1, REACH)).alias("words")))))
        return F.filter(windows, lambda x: may(lambda: _gain(x["words"], bound[1])))

    single = F.transform("__w", lambda w, i: F.struct(i.alias("place"), i.alias("last"), F.lit(False).alias("wrapped"), w.alias("words")))
    units = lines.select("k1", "k2", F.explode_outer(
        F.concat(F.filter(single, lambda x: may(lambda: F.get(F.col("__s"), x["place"]))), F.flatten(F.transform("__w", crossing)))).alias("u")).select("k1", "k2", "u.*")
    return units.where(F.size("words") > 0)


def _prose(docs: DataFrame, text_col: str, wanted=lambda fold, line: F.lit(True)) -> DataFrame:
    """line, fold, words, terms: every ``wanted`` line with a letter or digit that
    shares no word pair with a notice (what does is no prose), with the vocabulary's
    words that it holds, all that the model sees of it. Lines are cut into words
    before they become rows, so that this is done once a line."""
    known = sorted({p for n in STATEMENTS.values() for x in n for p in _pairs(x)})
    first, second = (sorted({p.split(" ")[k] for p in known}) for k in (0, 1))
    fold = lambda x: F.pmod(F.xxhash64(x), F.lit(4)).cast("int")
    texts = F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda x: x.rlike("[A-Za-z0-9]") & wanted(fold(x), x))
    lines = docs.select(F.explode(F.transform(texts, lambda x: F.struct(x.alias("line"), fold(x).alias("fold"), _words(x).alias("words")))).alias("u")).select("u.*")
    before = F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = F.zip_with(before, F.slice("words", 2, F.size("words")), lambda a, b: F.when(
        a.isin(*first) & b.isin(*second), F.concat_ws(" ", a, b)).otherwise(F.lit("")))
    alone = [w for w in _vocabulary() if " " not in w]
    return lines.where(~F.exists(pairs, lambda p: p.isin(*known))).withColumn(
        "terms", F.array_sort(F.array_distinct(F.filter("words", lambda w: w.isin(*alone)))))


#: Share of the hashes that is looked through first for the lines around notices.
FEW = 1024


def _near(docs: DataFrame, text_col: str, n: int = 12) -> list[str]:
    """The starts of ``n`` lines of fold 1 that are least by their hash: among the
    least hashes first, and among all if those are too few."""
    def some(least):
        rows = _prose(docs, text_col, lambda fold, x: (fold == 1) & least(F.xxhash64(F.substring(x, 1, 200))))
        return [r[0] for r in rows.select(F.substring("line", 1, 200).alias("line")).distinct()
                .orderBy(F.xxhash64("line"), "line").limit(n).collect()]

    got = some(lambda h: h < -2**63 + 2**64 // FEW)
    return got if len(got) == n else some(lambda h: F.lit(True))


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[LogisticRegressionModel, float]:
    """The fitted model and the least probability of a family, from every line of
    every document.

    Lines that look alike to the model are one row with their number as its
    weight; prose weighs ``PROSE`` in all, whatever the size of the corpus."""
    spark = docs.sparkSession
    prose = _prose(docs, text_col, lambda fold, x: fold != 1)
    counted = staged(prose.groupBy("fold", "terms").agg(F.count(F.lit(1)).alias("n")), "prose")
    notices = spark.createDataFrame([(f, n) for f, ns in STATEMENTS.items() for n in ns], "family string, notice string")
    # every notice inside twelve prose lines
    some = _near(docs, text_col)
    inside = notices.withColumn("near", F.explode(F.array(*[F.lit(x) for x in some or [""]]))).select(
        "family", F.concat_ws(" ", "near", "notice", "near").alias("line"))
    label = F.create_map(*[F.lit(x) for k, f in enumerate(FAMILIES) for x in (f, float(k))])
    told = _terms(notices.select("family", F.col("notice").alias("line")).unionAll(inside)
                  .unionAll(spark.createDataFrame([(NONE, "")], "family string, line string")))
    learned = counted.where("fold > 1")
    total = learned.agg(F.sum("n").alias("n")).first()["n"] or 1
    rows = told.select("family", "terms", F.lit(1.0).alias("weight")).unionAll(
        learned.select(F.lit(NONE), "terms", F.col("n") * (min(total, PROSE) / total)))
    data = rows.withColumn("label", F.element_at(label, F.col("family")))
    data = staged(_counted(data).select("label", "features", "weight").hint("rebalance"), "training")
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=60, weightCol="weight").fit(data)
    p = F.array_max(F.slice(vector_to_array("probability"), 1, len(NOTICES) - 1))
    held = model.transform(_counted(counted.where("fold = 0"))).groupBy(F.ceil(p * 10_000).cast("int").alias("p")).agg(F.sum("n").alias("n"))
    high, left = 0.0, 0
    steps = sorted((r["p"], r["n"]) for r in held.collect())     # 10,001 rows at most
    every = sum(n for _, n in steps)
    for at, n in steps:
        left += n
        if left >= 0.999 * every:
            high = at / 10_000
            break
    return model, min(0.9, max(0.5, high))


def _counts(x):
    """A line counts unless it is a fragment of a wrapped notice that names its
    family; of line ends that overlap the first one counts, if no line and (for
    unknown ones) no confirmed end tells."""
    def sure(y):
        return y["family"] != "unknown"

    whole = F.exists("h", lambda y: y["wrapped"] & sure(y) & (y["family"] == x["named"])
                     & (x["place"] >= y["place"]) & (x["place"] <= y["last"]))
    told = F.exists("h", lambda y: (y["place"] <= x["last"]) & (y["last"] >= x["place"]) & F.when(
        sure(x), (y["family"] == x["family"]) & (~y["wrapped"] | _before(y, x))).otherwise(~y["wrapped"] | sure(y) | _before(y, x)))
    return F.when(x["wrapped"], ~told).otherwise(sure(x) | ~whole)


def _before(y, x):
    return (y["place"] < x["place"]) | ((y["place"] == x["place"]) & (y["last"] < x["last"]))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **training) -> DataFrame:
    """One row per document: id, n_paragraphs, n_licences (confirmed), n_unknown,
    families (sorted), and ``found``: place, family, probability and coverage of
    each licence paragraph."""
    model, least = train(docs, text_col, id_col, **training)
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__t"))
    keyed = keyed.select("id", *row_key("id", "__t"), F.col("__t"))
    at = paragraphs(keyed, "__t", margins(model))
    scored = model.transform(_features(at)).withColumn("p", vector_to_array("probability"))
    names = F.array(*[F.lit(f) for f in FAMILIES])
    scored = scored.withColumn("family", F.element_at(names, (F.col("prediction") + 1).cast("int"))).where(F.col("family") != NONE)
    templates = F.create_map(*[x for f, ns in STATEMENTS.items() for x in
                               (F.lit(f), F.array(*[F.array(*[F.lit(p) for p in sorted(set(_pairs(n)))]) for n in ns]))])
    cover = F.array_max(F.transform(F.element_at(templates, F.col("family")),
                                    lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.greatest(F.size(t), F.lit(1))))
    hits = staged(scored.select("k1", "k2", "place", "last", "wrapped", "family", "pairs", F.array_max("p").alias("p")), "licence-lines")
    hits = hits.withColumn("coverage", cover)
    sure = (F.col("family") != "unknown") & (F.col("p") >= least) & (F.col("coverage") >= COVERAGE)
    hits = hits.withColumn("named", F.col("family")).withColumn("family", F.when(sure, F.col("family")).otherwise(F.lit("unknown")))
    all_hits = hits.distinct().groupBy("k1", "k2").agg(F.array_sort(F.collect_list(
        F.struct("place", "family", "p", "coverage", "named", "last", "wrapped"))).alias("h"))
    kept = F.transform(F.filter("h", _counts), lambda x: F.struct(x["place"].alias("place"), x["family"].alias("family"),
                                                                  x["p"].alias("p"), x["coverage"].alias("coverage")))
    confirmed = F.filter("found", lambda x: x["family"] != "unknown")
    per = all_hits.select("k1", "k2", kept.alias("found")).select(
        "k1", "k2", F.size(confirmed).cast("long").alias("n_licences"),
        (F.size("found") - F.size(confirmed)).cast("long").alias("n_unknown"),
        F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x["family"]))).alias("families"), "found")
    lines = F.size(F.filter(F.split("__t", "\n"), lambda x: x.rlike("[\\p{L}\\p{N}]")))
    base = keyed.select("id", "k1", "k2", F.when(F.col("__t").isNull(), F.lit(0)).otherwise(lines).cast("long").alias("n_paragraphs"))
    none = F.array().cast("array<string>")
    nothing = F.expr("cast(array() as array<struct<place:int,family:string,p:double,coverage:double>>)")
    return base.join(per, ["k1", "k2"], "left").select(
        F.col("id").alias(id_col), "n_paragraphs", F.coalesce("n_licences", F.lit(0)).cast("long").alias("n_licences"),
        F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"), F.coalesce("families", none).alias("families"),
        F.coalesce("found", nothing).alias("found"))
