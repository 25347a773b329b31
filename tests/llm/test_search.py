"""Vantage-point trees against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from creditloom.llm import vptree
from creditloom.llm.queries import QUERIES
from creditloom.llm.vptree import Search, Tree, nearest


def brute(rows, queries, k):
    out = {}
    for q in queries:
        own = np.array(rows[q], float)
        scored = sorted((-float(np.cumsum(own * np.array(v, float))[-1]), i) for i, v in rows.items() if i != q and len(v) == len(own))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_exact_at_factor_one(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    found = {}
    for r in QUERIES["op2_vantage_point_trees"](spark, SMALL).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute(rows, [i for i in rows if i % 20 == 0], 20)
    assert {q: [v for _, v in sorted(x)] for q, x in found.items()} == want


@pytest.mark.parametrize("factor", [1.0, 1.5, 3.0])
def test_factor_trades_visits_for_recall(factor, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 48)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(3000, 3)) * rng.uniform(0.2, 2, (3000, 1))
    tree = Tree.build(np.arange(3000), vectors)
    search = Search(np.arange(60), vectors[:60], 10, factor)
    search.run(tree)
    score = vectors[:60] @ vectors.T
    score[np.arange(60), np.arange(60)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(search.found, want, strict=True)])
    assert recall == 1 if factor == 1 else recall > 0.5
    assert search.leaves / 60 < (tree.nodes[:, 2] < 0).sum() * (0.6 if factor == 1 else 0.5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1.0, None]), (120, []), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows += [(i, [1.0, 1.0]) for i in range(1, 90)] + [(0, [1.0, 0.0]), (7, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("dim", "shard", "score", "rank", "vector")})
    got = sorted((r["rank"], r.query_id, r.vec_id, r.score) for r in nearest(frame, F.col("vec_id") % 20 == 0, 20, shard_rows=16).collect() if r.query_id == 0)
    assert got == [(k, 0, k, 1.0) for k in range(1, 21)]
    assert {r.query_id for r in nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()} == {0, 20, 40, 60, 80}
    assert nearest(frame.where("false"), F.col("vec_id") % 20 == 0).collect() == []
    few = nearest(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(few)] == [(1, 1), (2, 2)]
