"""The quadratic discriminant: statistics against a plain loop, densities against their definition, held-out rows."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditloom.llm import quality
from creditloom.llm.quality import FLOOR, NAMES, Discriminant, Moments
from creditloom.llm.queries import QUERIES
from llm.helpers import LONG, no_docs, odd_docs

MIDDLE = "/root/testdata/sf0.01"


def plain(text: str | None) -> list[float]:
    """The statistics by their description, one byte at a time."""
    data = (text or "").encode()
    lower, upper, far = set(range(97, 123)), set(range(65, 91)), set(range(128, 256))
    gap, digit = {32, *range(9, 14)}, set(range(48, 58))
    letter = lower | upper | far
    control = (set(range(32)) | {127}) - gap
    symbol = set(range(256)) - letter - gap - digit - control
    size = lambda kind: sum(b in kind for b in data)
    words = re.findall(rb"[^\x20\x09-\x0d]+", data)
    seen = collections.Counter(w.lower() for w in words)
    lines = [x for x in data.split(b"\n") if x]
    n, n_lines, sentences = len(words), len(lines), size({46, 33, 63})
    letters = [sum(b in letter for b in w) for w in words]
    twice = sum(a == b and a in symbol for a, b in zip(data, data[1:], strict=False))
    over = lambda x, y: min(max(x / max(y, 1), 0), 1)
    lengths = [n, len(seen), n_lines, sum(map(len, words)) / max(n, 1), n / max(n_lines, 1), n / (sentences + 1)]
    shares = [over(size(letter), len(data)), over(size(upper), size(letter)), *(over(size(k), len(data)) for k in (digit, symbol, gap, far, control))]
    shares += [over(twice, size(symbol)), over(sum(w[0] in upper for w in words), n)]
    shares += [over(sum(c > 1 and sum(b in upper for b in w) == c for w, c in zip(words, letters, strict=True)), n)]
    shares += [over(letters.count(0), n), over(sum(len(w) <= 3 for w in words), n), over(sum(sum(b in symbol for b in w) > 1 for w in words), n)]
    shares += [over(n - len(seen), n), over(n_lines - len(set(lines)), n_lines), over(sum(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False)), n)]
    shares += [over(max(seen.values(), default=0) - 1 if n > 1 else 0, n)]
    return [math.log1p(x) for x in lengths] + [math.log((s + FLOOR) / (1 - s + FLOOR)) for s in shares]


def test_statistics_of_odd_texts(spark):
    docs = odd_docs(spark)
    odd = ["..", "!!!", "AB ab Ab", "a\n\na\na", "É é\r\n\x07\x7f $$$ U.S.A.", "x" * 300, "-"]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(odd, 50)), "doc_id long, text string"))
    rows = docs.select("text", quality.statistics(F.col("text")).alias("x")).collect()
    assert len(rows) == 18
    for r in rows:
        assert len(r.x) == len(NAMES) and np.allclose(r.x, plain(r.text), atol=1e-9), (r.text or "")[:40]


def test_statistics_of_documents(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet").where("doc_id < 250")
    rows = docs.select("text", quality.statistics(F.col("text")).alias("x")).collect()
    assert all(np.allclose(r.x, plain(r.text), atol=1e-9) for r in rows) and len(rows) == 250


def test_long_texts_in_pieces(monkeypatch):
    """Pieces cut after white space give the counts of the whole; a word beyond a piece is only cut."""
    texts = [("Some words, here!! " * 400).encode(), LONG[:5000].encode(), b"y" * 4000]
    whole = [quality.measured(*flat) for flat in ((np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts)]
    monkeypatch.setattr(quality, "PIECE_BYTES", 500)
    cut = [quality.measured(*flat) for flat in ((np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts)]
    lines = [NAMES.index(n) for n in ("lines", "line_words", "repeated_lines", "next_same")]  # lines and neighbours end with a piece
    for a, b in zip(whole[:2], cut[:2], strict=True):
        assert np.allclose(np.delete(a, lines), np.delete(b, lines))
    assert np.expm1(cut[2][0, 0]) == pytest.approx(8)
    assert sum(len(p) for p in quality.pieces(np.frombuffer(texts[0], np.uint8))) == len(texts[0])
    assert max(len(p) for p in quality.pieces(np.frombuffer(texts[0], np.uint8))) <= 500


def log_density(x, mean, cov):
    apart = x - mean
    return -0.5 * np.einsum("ij,jk,ik->i", apart, np.linalg.inv(cov), apart) - 0.5 * np.linalg.slogdet(cov)[1]


def test_densities_by_definition():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 1, rng.normal(size=(90, 4)) @ rng.normal(size=(4, 4))]
    classes = [Moments(len(v), v.sum(0), v.T @ v) for v in x]
    for a, b in ((0.0, 0.01), (0.3, 0.2), (1.0, 0.5)):
        pooled = sum((len(v) - 1) * np.cov(v.T) for v in x) / 488
        covs = [(1 - b) * ((1 - a) * np.cov(v.T) + a * pooled) + b * np.diag(np.diag(pooled)) for v in x]
        at = np.concatenate(x)
        want = log_density(at, x[1].mean(0), covs[1]) - log_density(at, x[0].mean(0), covs[0])
        model = Discriminant.of(classes, a, b)
        assert np.allclose(model.difference(at), np.sign(want) * np.log1p(np.abs(want)))
        order = np.argsort(want)
        assert (np.diff(model.score(at)[order]) >= 0).all()


def test_moments_are_those_of_all_rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, len(NAMES))) + 10
    label, fold = rng.integers(0, 2, 500), rng.integers(0, 4, 500)
    frame = spark.createDataFrame([(v.tolist(), int(f), int(k)) for v, f, k in zip(x, fold, label, strict=True)], "x array<double>, fold int, label int")
    parts = quality.moments(frame.repartition(5))
    for (f, k), m in parts.items():
        some = x[(fold == f) & (label == k)]
        assert m.n == len(some) and np.allclose(m.mean(), some.mean(0)) and np.allclose(m.scatter(), np.cov(some.T) * (len(some) - 1))


def test_curve_recovers_chances():
    at = np.arange(-quality.BINS, quality.BINS + 1) * quality.WIDTH
    p = 1 / (1 + np.exp(-(0.8 * at - 1)))
    n = 1000 * np.exp(-(at**2) / 20)
    slope, level, _ = quality.curve(np.array([n * (1 - p), n * p]))
    assert slope == pytest.approx(0.8, abs=0.01) and level == pytest.approx(-1, abs=0.02)


def test_held_out_quality(spark):
    rows = {r.doc_id: r for r in QUERIES["op12_quadratic_quality"](spark, MIDDLE).collect()}
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    held = [i for i in marked if rows[i].held_out]
    assert len(rows) == 1000 and len(held) > 60
    assert np.mean([rows[i].predicted == marked[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_odd_rows_and_labels(spark):
    docs = odd_docs(spark).withColumn("x", quality.statistics(F.col("text"))).withColumn("lang", F.lit(None).cast("string"))
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 0), (4, 1, 1), (4, 1, 0), (4, 0, 0), (5, 1, 0), (6, 1, 0), (7, None, 0), (8, 2, 0), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, label int")
    model = quality.fit(docs, labels)
    assert isinstance(model, Discriminant)
    got = docs.select("doc_id", quality.rated(model, F.col("x")).alias("score")).collect()
    assert len(got) == 11 and all(r.score is not None and 0 <= r.score <= 1 for r in got)
    known = quality.labelled(docs, labels).collect()
    assert sorted(r.label for r in known) == [0, 0, 0, 1, 1, 1, 1]  # 4 is there twice, its majority is 1


def test_nothing_to_learn_from(spark):
    docs = odd_docs(spark).withColumn("x", quality.statistics(F.col("text")))
    ones = spark.createDataFrame([(4, 1), (5, 1)], "doc_id long, quality int")
    assert quality.fit(docs, ones) == pytest.approx(4 / 5)  # three rows of label 1
    assert quality.fit(docs, ones.where("false")) == 0.5
    none = no_docs(spark).withColumn("x", quality.statistics(F.col("text")))
    model = quality.fit(none, ones)
    assert none.select(quality.rated(model, F.col("x")).alias("s")).collect() == [] and model == 0.5
