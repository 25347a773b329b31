"""The search for weights on arrays: same tables as the joins, two jobs a step, nothing left behind."""

import math
import pathlib

import numpy as np
import pytest

from creditloom.operators import text_blocks as TB, text_risk as T

WORDS = "loan repay late steady income rent salary default overdue savings house car travel debt medical school".split()


def rows(n, seed):
    rng = np.random.default_rng(seed)
    bad = rng.uniform(size=n) < 0.4
    odds = [np.ones(len(WORDS)) + (np.arange(len(WORDS)) % 3 == b) * 1.5 for b in (0, 1)]
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 12), p=odds[b] / odds[b].sum())) for b in bad.astype(int)]
    return [*((i, t, float(b)) for i, (t, b) in enumerate(zip(texts, bad))), (n, "", 0.0), (n + 1, "the of and", 1.0), (n + 2, None, 1.0)]


def odd_rows():
    """Keys that are null, repeated or have two labels; labels and texts that are null."""
    more = [(None, "loan zebra", 1.0), (None, "zebra rent", 0.0), (500, "car debt debt", 1.0), (500, "car debt debt", 0.0)]
    return [*rows(60, 5), *more, (501, "salary rent", None), (502, "house car", 1.0), (502, "travel", 1.0), (503, None, None)]


@pytest.mark.parametrize("batch", [1000, 7])
def test_arrays_hold_the_training_tables(spark, monkeypatch, batch):
    train = spark.createDataFrame(odd_rows(), "doc_id long, text string, label double")
    docs, idf, entries = T.training_tables(train, "doc_id", "text", "label", T.english_stop_words())
    held = T.small_batches
    monkeypatch.setattr(T, "small_batches", lambda session: held(session, batch))
    monkeypatch.setattr(T, "BLOCK_DOCS", 10)
    model = T.fit(train, c=0.5)
    terms = {r.term: r for r in model.terms.collect()}
    known = {r.term: r.idf for r in idf.collect()}
    assert set(terms) == set(known) and "zebra" in terms and all(terms[t].idf == pytest.approx(known[t], rel=1e-12) for t in known)
    z = {}
    for r in entries.collect():
        z[r.key] = z.get(r.key, 0.0) + r.x * terms[r.term].w
    loss = sum(r.w**2 for r in terms.values())  # |w|^2 / 2C
    for r in docs.collect():
        if r.y is not None:
            m = z.get(r.key, 0.0) + model.intercept
            loss += math.log1p(math.exp(m)) - r.y * m
    entries.unpersist()
    assert model.loss == pytest.approx(loss, rel=1e-10)


def test_a_step_is_two_jobs_and_leaves_nothing_behind(spark, monkeypatch):
    sc = spark.sparkContext
    train = spark.createDataFrame(rows(60, 8), "doc_id long, text string, label double")
    before = sc._jsc.getPersistentRDDs().size()

    def jobs(steps):
        monkeypatch.setattr(T, "STEPS", steps)
        sc.setJobGroup(f"fit-{steps}", "")
        T.fit(train)
        return len(sc.statusTracker().getJobIdsForGroup(f"fit-{steps}"))

    try:
        assert jobs(6) - jobs(2) == 2 * 4
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sc._jsc.getPersistentRDDs().size() == before


def test_vectors_of_many_steps_are_written_and_let_go(spark, monkeypatch):
    """More steps than lineage is kept for: the same minimum, and of what was written the last of both sides at most."""
    train = spark.createDataFrame(rows(120, 9), "doc_id long, text string, label double")
    loss = T.fit(train).loss
    monkeypatch.setattr(TB, "CUT", 2)
    written = []
    forget = TB.TextMatrix._forget
    monkeypatch.setattr(TB.TextMatrix, "_forget", lambda self, rdd: (written.append(rdd), forget(self, rdd)))
    assert T.fit(train).loss == pytest.approx(loss, rel=1e-9)
    files = [pathlib.Path(rdd.getCheckpointFile().removeprefix("file:")) for rdd in written if rdd is not None and rdd.isCheckpointed()]
    assert len(files) > 4 and not any(f.exists() for f in files)
