"""Hard negatives against a comparison of all pairs in whole numbers of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import difference, duck
from conftest import SMALL
from creditloom.llm import negatives
from creditloom.llm.negatives import Anchors, Block, Sample, angles_to, directions_of, mine, norms_of
from creditloom.llm.queries import QUERIES, SQL

SHAPE = "vec_id long, embedding array<double>, label int"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=10, n_positives=5, k=5):
    kept = []
    for i, vector, label in rows:
        if i is None or vector is None or label is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in whole) < 1 << 62:
            kept.append((i, whole, label))
    out = []
    for i, a, label in kept:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, v, strict=True)), j, other == label) for j, v, other in kept if j != i and len(v) == len(a)]
        scored.sort()
        for p, j, _ in [x for x in scored if x[2]][:n_positives]:
            fits = [(n, m) for n, m, same in scored if not same and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(i, j, r + 1, m, -p, -n) for r, (n, m) in enumerate(fits[:k])]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, SHAPE).withColumns({c: F.lit(1) for c in ("dim", "home", "salt", "score", "place", "vector", "rank", "slot")})
    got = mine(frame, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == NAMES
    return sorted(map(tuple, got.collect()))


def clustered(rng, n, dim, noise):
    centres = rng.normal(size=(4, dim))
    return centres[rng.integers(0, 4, n)] + noise * rng.normal(size=(n, dim))


def test_reference_sql(spark):
    name = "op13_angular_negatives"
    assert difference(QUERIES[name], SQL[name], spark, duck(SMALL), SMALL) is None


@pytest.mark.parametrize("noise", [0.05, 1.0])
def test_blocks_and_rounds(spark, monkeypatch, noise):
    """Small blocks, several partitions and several rounds of anchors give what one comparison gives."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), int(rng.integers(0, 3))) for i, v in enumerate(clustered(rng, 300, 6, noise))]
    want = brute(rows)
    assert found(spark, rows, round_bytes=1000) == want and len(want) > 100


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (10, None, 1), (20, [nan, 1.0], 1), (30, [inf, 1.0], 1), (40, [1.0, None], 1), (50, [], 1), (60, [0.001, 0.002], 1)]
    rows += [(None, [1.0, 1.0], 1), (70, [1.0, 1.0], None), (80, [1.0, 2.0, 3.0], 1), (90, [-1.0, -1.0], 2), (100, [1e200, 1.0], 1), (51, [], 2)]
    rows += [(i, [1.0, 0.5], i % 3) for i in range(1, 60)] + [(0, [1.0, 0.5], 1)] * 2 + [(7, [0.9, 0.5], 2)] * 9
    want = brute(rows)
    assert {r[0] for r in want} >= {0, 60} and found(spark, rows) == want
    assert found(spark, []) == [] and found(spark, rows[:1]) == [] and found(spark, [(1, [1.0], 1)]) == []


def test_fewer_than_asked_and_one_label(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.5, 0.0], 1), (2, [0.45, 0.0], 2), (3, [0.6, 0.0], 2)]
    assert found(spark, rows) == [(0, 1, 1, 2, 128 * 256, 115 * 256)]
    assert found(spark, [(i, [1.0, float(i)], 4) for i in range(12)]) == []


def test_scores_beyond_doubles(spark):
    """Products above 2**53 are kept exact."""
    rng = np.random.default_rng(9)
    base = rng.integers(1 << 29, 1 << 30, (60, 3))
    rows = [(i, (v / 256).tolist(), i % 2) for i, v in enumerate(base)]
    want = brute(rows)
    assert max(r[4] for r in want) > 1 << 58 and found(spark, rows) == want


def test_hot_copies(spark):
    """A third of all rows is one vector under many ids, and one id many times."""
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), int(i % 4)) for i, v in enumerate(rng.normal(size=(200, 4)))]
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)] + [(2001, rows[10][1], 2)] * 60
    assert found(spark, rows) == brute(rows)


def test_bounds_hold_and_prune():
    """Every score lies in its bounds, also near 0 and 180 degrees; clustered rows are mostly not scored."""
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * clustered(rng, 3000, 16, 0.1)).astype(np.int64)
    vectors[:50] = -vectors[50:100]
    vectors[100] = 0
    toward = directions_of(vectors[:500], 16)
    angles = angles_to(toward, vectors).astype(np.float32).astype(float)
    block = Block(np.arange(3000), rng.integers(0, 5, 3000), vectors, norms_of(vectors), angles, 0)
    one = np.ones((200, 1), np.int64)
    low = one * 0
    a = Anchors(np.arange(200), np.arange(200), block.labels[:200], vectors[:200], toward, 5, True, low, one * (1 << 60))
    scores = vectors[:200] @ vectors.T
    every = np.arange(200)
    down, up = a.bounds(every, block, slice(None), range(len(toward)))
    assert (down <= scores).all() and (scores <= up).all()
    down, up = a.reach(every, block)
    assert (down <= scores.min(1)).all() and (scores.max(1) <= up).all()
    a.low = np.sort(np.where(block.labels[:200, None] == block.labels, scores, 0), axis=1)[:, -6:-5]
    for start in range(0, 3000, 100):  # blocks of rows with like angles
        rows = np.lexsort((angles.min(1), angles.argmin(1)))[start : start + 100]
        a.meet(Block(rows, block.labels[rows], vectors[rows], block.norms[rows], angles[rows], int(angles[rows].argmin(1)[0])))
    own = (block.labels[:200, None] == block.labels) & (every[:, None] != np.arange(3000))
    want = [sorted(zip(-scores[i][own[i]], np.flatnonzero(own[i]), strict=True))[:5] for i in every]
    assert [[j for less, j in w if less <= 0] for w in want] == [[int(x) for x, s in zip(f, t, strict=True) if s >= 0] for f, t in zip(a.found, a.score, strict=True)]
    assert a.scored < 0.12 * a.pairs


def test_sample_only_speeds_up(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(rng.normal(size=(150, 5)))]
    want = brute(rows)
    monkeypatch.setattr(Sample, "draw", classmethod(lambda cls, rows, total: cls()))
    assert found(spark, rows) == want
