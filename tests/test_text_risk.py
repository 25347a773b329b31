"""Text risk on weight tables against the library's own TF-IDF and logistic regression, and against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from creditloom.operators import text_risk as T

WORDS = "loan repay late steady income rent salary default overdue savings house car travel debt medical school".split()


def rows(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        bad = int(rng.uniform() < 0.4)
        p = np.ones(len(WORDS)) + (np.arange(len(WORDS)) % 3 == bad) * 1.5
        out.append((i, " ".join(rng.choice(WORDS, rng.integers(1, 12), p=p / p.sum())), float(bad)))
    return [*out, (n, "", 0.0), (n + 1, "the of and", 1.0), (n + 2, None, 1.0)]


def by_library(train):
    """Loss, intercept and probabilities of the library's model with the same penalty."""
    words = [
        RegexTokenizer(inputCol="text", outputCol="words", pattern=T.WORD, gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="words", outputCol="kept"),
        CountVectorizer(inputCol="kept", outputCol="counts"),
    ]
    train = train.fillna("", "text")
    counting = Pipeline(stages=words).fit(train)
    counted = counting.transform(train)
    idf = IDF(inputCol="counts", outputCol="idf").fit(counted)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="counts", outputCol="weighted").transform(counted)
    data = Normalizer(inputCol="weighted", outputCol="features").transform(scaled)
    n = train.count()
    model = LogisticRegression(labelCol="label", regParam=1.0 / n, standardization=False, maxIter=500, tol=1e-12).fit(data)
    out = {r.doc_id: r.p for r in model.transform(data).select("doc_id", vector_to_array("probability")[1].alias("p")).collect()}
    y = {r.doc_id: r.label for r in train.collect()}
    loss = -sum(math.log(p if y[k] else 1 - p) for k, p in out.items())
    return loss + 0.5 * float((model.coefficients.toArray() ** 2).sum()), model.intercept, out


def test_same_minimum_as_the_library(spark):
    train = spark.createDataFrame(rows(160, 3), "doc_id long, text string, label double")
    loss, intercept, chances = by_library(train)
    model = T.fit(train)
    assert model.loss == pytest.approx(loss, rel=1e-6) and model.intercept == pytest.approx(intercept, abs=2e-3)
    got = {r.doc_id: r.prob for r in model.apply(train).collect()}
    assert set(got) == set(chances) and max(abs(got[k] - chances[k]) for k in got) < 2e-3
    # unknown words are left out; a text without known words has the intercept's chance
    odd = spark.createDataFrame([(1, "zebra zebra"), (2, "zebra debt"), (3, "debt"), (4, None)], "doc_id long, text string")
    p = {r.doc_id: r.prob for r in model.apply(odd).collect()}
    assert p[1] == p[4] == pytest.approx(1 / (1 + math.exp(-model.intercept))) and p[2] == pytest.approx(p[3])


def test_direction_is_the_two_loop_recursion():
    rng = np.random.default_rng(0)
    for steps in (0, 1, 4):
        root = rng.normal(size=(9, 9))
        curvature = root @ root.T + np.eye(9)
        s = rng.normal(size=(steps, 9))
        y = s @ curvature
        g = rng.normal(size=9)
        q, scale = g.copy(), np.zeros(steps)
        for i in reversed(range(steps)):
            scale[i] = s[i] @ q / (y[i] @ s[i])
            q = q - scale[i] * y[i]
        if steps:
            q = q * (s[-1] @ y[-1]) / (y[-1] @ y[-1])
        for i in range(steps):
            q = q + s[i] * (scale[i] - y[i] @ q / (y[i] @ s[i]))
        vectors = np.vstack([s, y, g[None]])
        assert np.allclose(T.direction(vectors @ vectors.T, steps) @ vectors, -q)


def test_gradient_steps_in_numpy(spark):
    train = spark.createDataFrame(rows(40, 8), "doc_id long, text string, label double")
    docs, idf, entries = T.training_tables(train, "doc_id", "text", "label", T.english_stop_words())
    terms = sorted(r.term for r in idf.collect())
    x, y = np.zeros((43, len(terms))), np.zeros(43)
    for r in entries.collect():
        x[r.key, terms.index(r.term)] = r.x
    for r in docs.collect():
        y[r.key] = r.y
    assert np.allclose(np.linalg.norm(x[:40], axis=1), 1) and not x[40:].any()
    w, b = np.zeros(len(terms)), 0.0
    for _ in range(2):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 0.02 * (x.T @ e + w / 0.5), b - 0.02 * e.sum()
    weights, level = T.gradient_steps(docs, entries, idf, 2, 0.02, c=0.5)
    got = {r.term: r.w for r in weights.collect()}
    assert np.allclose([got[t] for t in terms], w) and level == pytest.approx(b)


def test_nothing_to_learn_from(spark):
    with pytest.raises(ValueError, match="no training rows"):
        T.fit(spark.createDataFrame([], "doc_id long, text string, label double"))
    same = spark.createDataFrame([(1, "debt debt", 1.0), (1, "debt debt", 1.0), (2, "rent", 0.0)], "doc_id long, text string, label double")
    assert T.fit(same).terms.count() == 2


def test_steps_do_not_shuffle_the_entries(spark):
    train = spark.createDataFrame(rows(40, 8), "doc_id long, text string, label double")
    docs, idf, entries = T.training_tables(train, "doc_id", "text", "label", T.english_stop_words())
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        with T.joined_in_blocks(spark):
            wants = T.wanted(entries, idf)
            for sums in (T.term_sums(entries, docs, T.F.col("y")), T.doc_sums(entries, wants, idf, T.F.col("idf"))):
                sums.collect()
                plan = sums._jdf.queryExecution().executedPlan().toString().split("\n")
                scan = next(line for line in plan if "InMemoryTableScan" in line)
                depth, above = scan.index("InMemoryTableScan"), []
                for line in reversed(plan[: plan.index(scan)]):  # the nodes over the scan, bottom up
                    start = len(line) - len(line.lstrip(" :+-"))
                    if start < depth:
                        depth, above = start, [*above, line]
                first = next(i for i, line in enumerate(above) if "Join" in line)
                assert not any("Exchange" in line for line in above[:first])
    finally:
        spark.conf.set(name, before)
        entries.unpersist()
