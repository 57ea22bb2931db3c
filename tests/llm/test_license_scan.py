import random

from pyspark.sql import functions as F

from tessera.llm import license_scan


def test_families_unknown_and_prose(spark):
    rows = [(1, "Released under the MIT License.\nplain words"), (2, "some text. Licensed under the Apache License, Version 2.0. More text"),
            (3, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
            (4, "All rights reserved."), (5, "he asked for permission to leave"), (6, None), (7, ""), (1, "Released under the MIT License.\nplain words")]
    rows += [(100 + i, f"ordinary prose number {i} about rivers and hills\nwith a second line of words {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in license_scan.scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.n_licences, r.n_unknown, r.families, r.n_paragraphs))
    assert got[1] == [(1, 0, ["MIT"], 2)] * 2
    assert got[2][0][2] == ["Apache-2.0"] and got[3][0][2] == ["CC-BY-NC", "GPL"]
    assert got[4] == [(0, 1, [], 1)] and got[5][0][:3] == (0, 0, [])
    assert got[6] == got[7] == [(0, 0, [], 0)]
    assert all(got[100 + i][0][:2] == (0, 0) for i in range(60)) and sum(map(len, got.values())) == len(rows)


def test_every_line_is_classified(spark):
    short = ["Distributed under LGPL v2.1 or later", "AGPL-3.0-only", "GNU LGPL 2.1", "CC-BY-SA 4.0", "CC-BY 4.0", "Apache 2.0",
             "BSD-3-Clause", "Mozilla Public, v. 2.0", "Licensing: MIT"]
    rows = list(enumerate(short)) + [(100 + i, f"ordinary prose number {i} about rivers and hills\nwith the second line of words {i}") for i in range(60)]
    got = {r.doc_id: (r.families, r.n_unknown) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = ["LGPL", "AGPL", "LGPL", "CC-BY-SA", "CC-BY", "Apache-2.0", "BSD", "MPL-2.0", "MIT"]
    assert {t: got[i] for i, t in enumerate(short)} == {t: ([f], 0) for t, f in zip(short, want)}
    assert not any(any(got[100 + i]) for i in range(60))


def test_other_licences_are_unknown(spark):
    other = ["Distributed under the ISC License", "Licensed under the EPL-2.0", "Boost Software License, Version 1.0", "released into the public domain",
             "Licensed under the EUPL", "may be used only with written permission of the vendor"]
    rows = list(enumerate(other)) + [(100 + i, f"ordinary prose number {i} about rivers and hills\nwith the second line of words {i}") for i in range(60)]
    got = {r.doc_id: (r.families, r.n_unknown) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: got[i] for i, t in enumerate(other)} == {t: ([], 1) for t in other}


def test_the_bound_leaves_out_prose_only(spark):
    """Brute force: every line and line end through the model, against the scan."""
    rng = random.Random(6)
    vocab = [w for t in license_scan._vocabulary() for w in t.split()] + ["river", "hill", "walks", "said", "the", "of"] * 40
    texts = ["\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    texts += [f"the river\n{n}\nwalks of the hill" for notices in license_scan.STATEMENTS.values() for n in notices]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, _ = license_scan.train(df)
    start, gains = license_scan.margins(model)
    keyed = df.select(F.col("doc_id").alias("k1"), F.col("doc_id").alias("k2"), "text")
    every = license_scan.paragraphs(keyed, "text")
    some = license_scan.paragraphs(keyed, "text", (start, gains))
    keys = ["k1", "place", "last", "wrapped", "words"]

    def told(units):
        got = model.transform(license_scan._features(units)).select(*keys, "prediction").collect()
        return sorted((r.k1, r.place, r.last, r.wrapped, r.words) for r in got if license_scan.FAMILIES[int(r.prediction)] != "none")

    assert told(every) == told(some) and len(told(every)) > 20 and some.count() < every.count()


def test_wrapped_notices_and_other_scripts(spark):
    gpl = ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License"
           " as published by\n# the Free Software Foundation, either version 3 of the License")
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following\n * conditions are met:"
    narrow = "\n".join("Licensed under the GNU Lesser General Public License, version 2.1.".split())
    rows = [(1, gpl), (2, bsd), (3, narrow), (4, "日本\nРусский\n...\n\nx"), (5, f"some words here\n{bsd}\nReleased under the MIT License.\nAll rights reserved."),
            (6, "Licensed under the GNU Lesser\n\nGeneral ordinary words")]
    rows += [(100 + i, f"ordinary prose number {i} about rivers and hills\nwith a second line of words {i}") for i in range(60)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[i].families, got[i].n_licences, got[i].n_unknown) for i in (1, 2, 3)] == [(["GPL"], 1, 0), (["BSD"], 1, 0), (["LGPL"], 1, 0)]
    assert got[4].n_paragraphs == 3 and not got[4].found
    assert (got[5].families, got[5].n_licences, got[5].n_unknown) == (["BSD", "MIT"], 2, 1) and got[6].families == []
    assert not any(got[100 + i].found for i in range(60))


def test_no_python_on_executors(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    plan = license_scan.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_odd_rows(odd, nothing):
    assert license_scan.scan(odd).count() == odd.count()
    assert license_scan.scan(nothing).count() == 0


def test_every_line_trains(spark):
    """More documents and more lines each than any sample: all but statements count."""
    texts = ["\n".join([f"the river {i} of line {j}" for j in range(30)] + ["Released under the MIT License.", "..."]) for i in range(450)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = license_scan._prose(df, "text").groupBy("terms").count().collect()
    assert sum(r["count"] for r in got) == 450 * 30 and all({"of", "the"} <= set(r["terms"]) for r in got)


def test_windows_stand_for_their_own_words(spark):
    """A statement's words lend nothing to windows of the lines around it."""
    start, gains = -5.0, {"license": 4.0, "mit": 4.0, "river": 0.5}
    text = "\n".join(["the river runs"] * 6 + ["MIT license"] + ["the river runs"] * 6 + ["license " * 40, "mit " * 40])
    df = spark.createDataFrame([(1, 1, text)], "k1 long, k2 long, text string")
    got = license_scan.paragraphs(df, "text", (start, gains)).collect()
    assert got and all(start + sum(gains.get(w, 0) for w in set(r.words)) >= 0 for r in got)
    every = license_scan.paragraphs(df, "text").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in every if start + sum(gains.get(w, 0) for w in set(r.words)) >= 0)


def test_lines_near_notices_are_the_least_by_hash(spark, monkeypatch):
    """The few least hashes give the same lines as a look at all of them."""
    df = spark.createDataFrame([(i, "\n".join(f"the river {i} of line {j} is long" for j in range(40))) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(license_scan, "FEW", 4)
    few = license_scan._near(df, "text")
    monkeypatch.setattr(license_scan, "FEW", 1 << 40)
    assert few == license_scan._near(df, "text") and len(few) == 12
