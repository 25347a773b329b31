"""The Jaccard join against all pairs, and components against union-find."""

import random

import numpy as np
import pytest

from conftest import SMALL
from creditloom.llm.graph import components
from creditloom.llm.jaccard import BINS, FINE_BINS, JaccardJoin, allocate, bins_of, may_link, schemes, shared
from llm.helpers import brute_components, no_docs, odd_docs, texts_of


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_same_as_all_pairs(spark, width, num):
    texts = texts_of(spark, SMALL)
    rows = JaccardJoin(spark.read.parquet(f"{SMALL}/documents.parquet"), width, num, 100).result().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, width, num, 100)


def test_group_of_near_copies_about_the_threshold(spark):
    """Copies of one text with a few random edits: some pairs link, most do not, all in one crowded bucket."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    texts = {}
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 6))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = JaccardJoin(docs, 3, 90, 100).result().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, 3, 90, 100)


def test_short_texts_of_every_size(spark):
    """Sets around the sizes where a band begins to allow one different element."""
    texts = {}
    for n in range(1, 26):
        for lost in range(2):
            texts[len(texts)] = " ".join(f"v{n}a{i}" for i in range(n) if not (lost and i == n - 1))
            texts[len(texts)] = " ".join(f"v{n}a{i}" for i in range(n + lost))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = JaccardJoin(docs, 1, 90, 100).result().collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, 1, 90, 100)


def test_odd_rows(spark):
    rows = JaccardJoin(odd_docs(spark), 3).result().collect()
    found = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_shingles, r.component_id) for r in rows)
    assert len(rows) == 11
    assert [x for x in found if x[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [x for x in found if x[0] == 4] == [(4, 1, 4)] * 2
    assert (8, 2, 7) in found and (7, 2, 7) in found and (6, 1, 6) in found
    assert [x for x in found if x[0] == -1] == [(-1, 3, None)]


def test_no_rows(spark):
    assert JaccardJoin(no_docs(spark)).result().collect() == []


def test_bands_cover_all_sizes_and_allow_enough_segments():
    for num in (80, 90, 95):
        s = schemes(num, 100)
        assert (s["lo"][1:] == s["hi"][:-1] + 1).all()
        for lo, hi, m in zip(s["lo"][:25], s["hi"][:25], s["m"][:25], strict=True):
            for small in (lo, hi):
                big = small * 100 // num
                assert (small + big) * (100 - num) // (100 + num) < max(m, 1)


def test_thresholds_keep_their_sum():
    rng = np.random.default_rng(3)
    size, job = rng.integers(0, 6, 400), np.repeat(np.arange(20), 20)
    t = allocate(size, job, np.tile(np.arange(20) < 4, 20), 20)
    assert (np.bincount(job, weights=t) == 0).all() and set(np.unique(t)) == {-1, 0, 1}
    assert (t[(size >= 2)] >= 0).all()


def test_intersections():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 6000)).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert shared(sets[:4], sets[4:]).tolist() == want


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)] + [(600, i) for i in range(601, 800)]
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = top(a), top(b)
        parent[max(p, q)] = min(p, q)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == {x: top(x) for a, b in pairs if a != b for x in (a, b)}


@pytest.mark.parametrize("width", [BINS, FINE_BINS])
def test_screening_by_widths_loses_no_pair(width, monkeypatch):
    """The same pairs as all bins of all pairs give; the finest width sees few of the pairs of unrelated sets."""
    rng = np.random.default_rng(3)
    base = [rng.integers(1 << 62, size=k) for k in rng.integers(8, 400, 60)]
    sets = [b[rng.random(len(b)) > rng.choice([0, 0.05, 0.3])] for b in base for _ in range(4)]
    sets.append(rng.integers(1 << 62, size=300_000))  # bins are cut at 255
    size = np.array([len(x) for x in sets])
    bins = bins_of(np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(len(sets)), size), len(sets), width)
    top = rng.integers(0, 3, len(sets))
    wide = bins.astype(np.int64)
    want = np.array([[(np.abs(x - y).sum() * 180 <= (a + b) * 20) and 100 * min(a, b) >= 80 * max(a, b) for y, b in zip(wide, size)] for x, a in zip(wide, size)])
    seen, plain = [], np.abs
    monkeypatch.setattr(np, "abs", lambda x: seen.append(x.size) or plain(x))
    assert (may_link(bins, size, 80, 100) == want).all()
    assert sum(seen) < bins.size * len(sets) / 2
    assert (may_link(bins, size, 80, 100, top) == want & (top[:, None] != top)).all()
