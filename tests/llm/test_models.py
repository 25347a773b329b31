"""The three trained models: held-out quality, odd rows, nothing to learn from."""

import textwrap

import numpy as np
from pyspark.sql import functions as F

from creditloom.llm import langid, licenses, toxicity
from creditloom.llm.queries import QUERIES
from llm.helpers import no_docs, odd_docs

MIDDLE = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    rows = QUERIES["op8_byte_network"](spark, MIDDLE).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 150 < len(held) < 350
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark):
    docs = odd_docs(spark).withColumn("lang", F.when(F.col("doc_id") > 6, "en").when(F.col("doc_id") == 5, "xx"))
    net = langid.fit(docs)
    found = {r.doc_id: r.x for r in docs.select("doc_id", langid.identify(net, F.col("text")).alias("x")).collect()}
    assert [found[k].label for k in (1, 2, 3, 9)] == ["und"] * 4 and found[9].score == 0
    assert found[6].label in ("en", "xx") and 0 < found[6].score <= 1
    assert langid.fit(no_docs(spark)) is None
    assert {r.x.label for r in docs.select(langid.identify(None, F.col("text")).alias("x")).collect()} == {"und"}


def test_language_sample_counts_copies_once(spark):
    """Languages of few texts in many copies, and more languages than 200: each gives its distinct texts, up to its own bound."""
    few = F.concat(F.lit("few "), (F.col("id") % 7).cast("string")).alias("text")
    many = F.concat(F.lit("many "), F.col("id").cast("string")).alias("text")
    rare = F.concat(F.lit("rare "), F.col("id").cast("string")).alias("text")
    docs = spark.range(20_000).select(few, F.lit("few").alias("lang"))
    docs = docs.unionByName(spark.range(3000).select(many, F.lit("many").alias("lang")))
    docs = docs.unionByName(spark.range(250).select(rare, F.concat(F.lit("r"), F.col("id").cast("string")).alias("lang")))
    drawn = langid.sample(docs, "text", "lang")
    texts = {}
    for x, part in drawn:
        texts.setdefault(x, []).append(part)
    assert len(texts) == 252 and set(texts["few"]) == {f"few {i}".encode() for i in range(7)} and len(texts["few"]) == 28
    most = langid.ALL_ROWS // 252
    assert len(set(texts["many"])) == most and all(len(texts[f"r{i}"]) == 4 for i in range(250))
    assert drawn == langid.sample(docs.repartition(5), "text", "lang")


def test_convolution_is_the_largest_window_sum():
    rng = np.random.default_rng(0)
    net = langid.ByteNetwork(["a", "b"], [rng.normal(size=(3, 256, 2)).astype(np.float32)], np.eye(2, dtype=np.float32), np.zeros(2, np.float32))
    window = rng.integers(0, 256, (1, 9)).astype(np.uint8)
    want = [max(sum(net.tables[0][k, window[0, i + k], f] for k in range(3)) for i in range(7)) for f in range(2)]
    p = np.exp(np.maximum(want, 0)) / np.exp(np.maximum(want, 0)).sum()
    assert np.allclose(net.probabilities(window)[0], p, atol=1e-5)


def test_windows_cover_whole_texts():
    data = np.arange(1, 251, dtype=np.uint8)
    windows, text, length = langid.cut(data, np.array([0, 0, 130, 250]), 64)
    assert text.tolist() == [1, 1, 1, 2, 2] and length.tolist() == [64, 64, 2, 64, 56]
    assert np.concatenate([w[:n] for w, n in zip(windows, length, strict=True)]).tolist() == data.tolist()


def test_steps_by_bytes_change_nothing(monkeypatch):
    """Runs of long texts and one very long text are worked off in steps; votes are those of one step."""
    rng = np.random.default_rng(3)
    net = langid.ByteNetwork(["a", "b"], [rng.normal(size=(2, 256, 4)).astype(np.float32)], rng.normal(size=(4, 2)).astype(np.float32), np.zeros(2, np.float32))
    import pyarrow as pa

    texts = pa.array(["x" * 5000, None, "ab", "", *["word " * int(k) for k in rng.integers(1, 400, 30)], "z y " * 3000])
    whole = langid.guess(net, texts)
    monkeypatch.setattr(langid, "STEP_BYTES", 1024)
    assert all(np.allclose(a, b) for a, b in zip(whole, langid.guess(net, texts), strict=True))


def test_toxicity_of_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))
    rest = docs.join(labels, "doc_id").where("doc_id % 3 = 0").select("toxic", toxicity.assess(model, F.col("text")).alias("x")).collect()
    hit = [r.x.toxic for r in rest if r.toxic == 1]
    clean = [r.x.toxic for r in rest if r.toxic == 0]
    assert np.mean(hit) > 0.9 and np.mean(clean) < 0.02
    assert (np.diff(model.cuts) > 0).all()
    assert all((r.x.grade > 0) == r.x.toxic and 0 <= r.x.expected_severity <= 3 for r in rest)


def test_ordinal_gradient_recovers_order():
    rng = np.random.default_rng(2)
    n = 3000
    count = rng.integers(0, 6, n)
    grade = np.clip(count - (rng.random(n) < 0.1), 0, 3)
    row = np.flatnonzero(count > 0)
    model = toxicity.OrdinalModel.fit(row, np.zeros(len(row), np.int64), np.log1p(count[row].astype(float)), grade, np.ones(n), np.array([7], np.uint64))
    mean = [float((model.chances(np.array([np.log1p(c) * model.weights.sum()])) @ np.arange(4))[0]) for c in range(6)]
    assert mean == sorted(mean) and mean[0] < 0.6 and mean[-1] > 2.5


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (7, 0), (8, 0), (6, 1), (None, 1), (1, None), (4, 1)], "doc_id long, toxic int")
    docs = odd_docs(spark)
    model = toxicity.fit(docs, labels)
    rows = docs.select("doc_id", toxicity.assess(model, F.col("text")).alias("x")).collect()
    assert len(rows) == 11 and all(0 <= r.x.p_toxic <= 1 for r in rows)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None
    assert toxicity.fit(no_docs(spark), labels) is None
    assert no_docs(spark).select(toxicity.assess(None, F.col("text"))).collect() == []


def test_licence_lines(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = licenses.fit(docs)
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(docs, model).collect()}
    want = {}
    marks = {"mit": "MIT License.", "apache-2.0": "Apache License, Version 2.0", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC"}
    for r in docs.select("doc_id", "text").collect():
        for i, line in enumerate(r.text.split("\n")):
            want |= {(r.doc_id, i): f for f, m in marks.items() if m in line}
    assert len(want) > 20 and want.items() <= got.items()
    assert all(f == "all-rights-reserved" for k, f in got.items() if k not in want)
    long = "prose words of no meaning " * 40
    tests = [
        (1, f"{long} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files {long}"),
        (2, "a driving license is required by the general public\n\nRedistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met:"),
        (3, long),
    ]
    rows = licenses.scan(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.paragraph, r.family) for r in rows) == [(1, 0, "mit"), (2, 2, "bsd")]
    assert licenses.scan(odd_docs(spark), model).collect() == []
    assert licenses.scan(no_docs(spark), model).collect() == []
    assert licenses.fit(no_docs(spark)).threshold >= 0.5


def test_wrapped_licence_notices(spark):
    model = licenses.fit(spark.read.parquet(f"{MIDDLE}/documents.parquet"))
    prose = "The river rose in spring and the mill stood still.\nNobody in the village spoke of it again."
    cases = []
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for width in (24, 45, 60):
                lines = textwrap.wrap(notice, width)
                cases += [(family, 0, "\n".join(lines)), (family, 3, f"{prose}\n\n" + "\n".join(f" * {x}" for x in lines) + f"\n\n{prose}")]
    lgpl = (
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
        "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."
    )
    gpl = (
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    )
    cases += [("lgpl", 0, lgpl), ("gpl", 0, gpl), ("lgpl", 2, f"{prose}\n{lgpl}\n{prose}"), ("gpl", 2, f"{prose}\n{gpl}\n{prose}")]
    docs = spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(cases)], "doc_id long, text string").repartition(4)
    found = {}
    for r in licenses.scan(docs, model).collect():
        found.setdefault(r.doc_id, []).append((r.family, r.paragraph))
    assert [(c, found.get(i)) for i, c in enumerate(cases) if found.get(i) != [c[:2]]] == []
    apart = spark.createDataFrame([(1, prose), (2, lgpl.replace("\n", "\n\n"))], "doc_id long, text string")
    assert licenses.scan(apart, model).collect() == []
