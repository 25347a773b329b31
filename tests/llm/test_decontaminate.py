"""Occurrences against a full edit-distance search."""

import random

import pyarrow as pa

from conftest import SMALL
from creditloom.llm import decontaminate as d
from llm.helpers import no_docs, odd_docs, texts_of


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, e in enumerate(text, 1):
            new[j] = min(row[j - 1] + (c != e), row[j] + 1, new[j - 1] + 1)
        row = new
    return min(row)


def test_random_edits(spark):
    rng = random.Random(1)
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    fill = list(texts_of(spark, SMALL).values())
    index = d.ItemIndex.build(sorted(items.items()), 0.1)
    within = 0
    for _ in range(80):
        name = rng.choice(list(items))
        own = list(items[name])
        for _ in range(rng.randrange(int(len(own) * 0.14))):
            k = rng.randrange(len(own))
            own[k : k + rng.randrange(2)] = rng.choice(["", "q", "e ", "\n"])
        around = rng.choice(fill)[:200]
        k = rng.randrange(len(around) + 1)
        text = f"{around[:k]} {''.join(own)} {around[k:]}"
        code, _ = d.normal(text)
        pattern, _ = d.normal(items[name].strip())
        want, budget = least_edits(pattern.tolist(), code.tolist()), int(index.budget[index.ids.index(name)])
        found = [x for x in d.searched(index, pa.array(["before", text, "after"]))[1].as_py() if x["item"] == name]
        assert bool(found) == (want <= budget)
        if found:
            within += 1
            best = min(found, key=lambda x: x["edits"])
            assert best["edits"] == want
            stretch, _ = d.normal(text[best["start"] : best["end"]])
            assert least_edits(pattern.tolist(), stretch.tolist()) == want
    assert within > 40


def test_documents(spark):
    rows = d.contaminated(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    texts = texts_of(spark, SMALL)
    exact = {(k, i) for k, t in texts.items() for i, b in items.items() if b in t}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        assert r.edits > 0 or texts[r.doc_id][r.start : r.end].lower().split() == items[r.item_id].lower().split()


def test_many_parts_give_the_same(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    one = sorted(d.contaminated(docs, items).collect())
    monkeypatch.setattr(d, "ITEM_CHARS", 3000)
    assert sorted(d.contaminated(docs, items).collect()) == one
    hit = {r.doc_id for r in one}
    assert sorted(r.doc_id for r in d.clean(docs, items).collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in hit)


def test_short_items(spark):
    """Items of every length up to 40, with as many edits as their budget, against a full search."""
    import re

    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = {m: "".join(rng.choice(letters) for _ in range(m)) for m in range(2, 41)}
    texts = []
    for m, item in items.items():
        for edits in {0, m // 10, m // 10 + 1}:
            own = list(item)
            for k in rng.sample(range(m), edits):
                own[k] = rng.choice("0123456789")
            texts.append(f"0 {''.join(own)} 9")
        texts.append(f"00{item}99")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(sorted(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.edits for r in d.contaminated(docs, bench).collect()}
    want = {}
    for k, text in enumerate(texts):
        for m, item in items.items():
            if m < 8:
                if re.search(rf"\b{item}\b", text):
                    want[k, m] = 0
            elif (least := least_edits(item, text)) <= m // 10:
                want[k, m] = least
    assert found == want and {m for _, m in want} == set(items)
    rows = spark.createDataFrame([(1, "The cat\n SAT on it."), (2, "bobcat sat"), (3, "a+b, a+ b"), (4, "cat  sat")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "cat sat"), (2, "a+"), (3, " ")], "item_id long, text string")
    assert sorted(tuple(r) for r in d.contaminated(rows, bench).collect()) == [(1, 1, 4, 12, 0), (3, 2, 0, 2, 0), (3, 2, 5, 7, 0), (4, 1, 0, 8, 0)]


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "The Same  Four Words"), (2, None), (3, ""), (4, "tiny"), (1, "the same four words"), (None, "no id at all here")], "item_id long, text string")
    rows = d.contaminated(odd_docs(spark), items).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.start, r.end, r.edits) for r in rows) == [(-1, -1, 0, 17, 0)] + [(k, 1, 0, 19, 0) for k in (7, 7, 8, 8)]
    assert d.contaminated(no_docs(spark), items).collect() == []
    assert d.contaminated(odd_docs(spark), items.where("false")).collect() == []
