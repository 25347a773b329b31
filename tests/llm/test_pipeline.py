"""The pipeline's stages against brute force, and the registered queries."""

import pytest

import corpus_pipeline
from compare import difference, duck
from conftest import SMALL
from creditloom.llm import stages
from creditloom.llm.queries import QUERIES, SQL
from llm.helpers import brute_components, no_docs, odd_docs, texts_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "pii", "packing"]
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert "pipeline" in corpus_pipeline.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name], SQL[name], spark, duck(SMALL), SMALL) is None


def test_stages_decide_as_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = texts_of(spark, SMALL)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in stages.known_language(spark, docs, SMALL).collect()}
    assert kept == {k for k, t in texts.items() if any(c.isalpha() for c in t)}
    one = stages.one_of_each_group(spark, docs, SMALL)
    classes = brute_components(texts, 5, 80, 100)
    assert one.columns == COLUMNS
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, c in classes.values()})
    clean = stages.without_benchmark(spark, docs, SMALL)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == COLUMNS and not any(b in texts[k] for k in left for b in items)
    assert len(left) > 0.9 * len(texts)
    assert stages.masked(spark, docs, SMALL).columns == COLUMNS


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r.doc_id for r in rows} < set(texts_of(spark, SMALL))
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


def test_odd_and_no_rows(spark):
    docs = odd_docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.selectExpr("*", "'en' AS lang") if "lang" not in docs.columns else docs, SMALL)
        rows = out.collect()
        if name == "language_id":
            assert sorted(r.doc_id or -1 for r in rows) == [-1, 4, 4, 5, 6, 7, 8]
        if name == "jaccard_join":
            assert sorted(r.doc_id or -1 for r in rows) == [-1, 1, 2, 3, 4, 5, 6, 7, 9]
        assert stage(spark, no_docs(spark), SMALL).collect() == []
