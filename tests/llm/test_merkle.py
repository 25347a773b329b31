"""The Merkle manifest against a plain loop over each source's rows."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import difference, duck
from conftest import SMALL
from creditloom.llm import merkle
from creditloom.llm.merkle import every_fifth, manifest
from creditloom.llm.queries import QUERIES, SQL
from llm.helpers import CLASHES, LONG, no_docs

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """Root of a list of nodes, and the (before, after) steps of each."""
    steps = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i // 16 * 16
            steps[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 16])))
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        at = [i // 16 for i in at]
    return nodes[0], steps


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        kept = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = (kept, *tree([leaf(r) for r in kept]))
    root, over = tree([trees[name][1] for name in names])
    out = []
    for name, above in zip(names, over, strict=True):
        kept, subroot, steps = trees[name]
        for row, path in zip(kept, steps, strict=True):
            altered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf((*row[:4], lowered(row[4]))) if altered else leaf(row)
            for before, after in path + above:
                node = h(before + node + after)
            proof = h("".join(b + a for b, a in path + above))
            out.append((row[0], leaf(row), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in manifest(docs, every_fifth(F.col("doc_id"))).collect()), key=str)


def test_reference_sql(spark):
    name = "op11_merkle_manifest"
    assert difference(QUERIES[name], SQL[name], spark, duck(SMALL), SMALL) is None


def test_odd_rows(spark):
    rows = [(i, "b", "en", 3, f"Text {i}") for i in range(40)] + [(7, "b", "en", 3, "Text 7")] * 3 + [(7, "b", None, None, "other")]
    rows += [(5, None, None, None, None), (10, "", "x", 0, ""), (None, "b", "é", -1, None), (None, "B", "é", 2, "UPPER É İ"), (11, "ß", "de", 9, LONG)]
    rows += [(i, f"s{i}", "", 0, "AB") for i in range(100, 130)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in CLASHES + ["pos", "n", "digest", "altered", "salt", "part"] if c not in COLUMNS})
    assert found(docs) == brute(rows)
    assert found(docs.repartition(7)) == brute(rows)


def test_one_row_and_none(spark):
    rows = [(3, "a", None, 1, "X")]
    docs = spark.createDataFrame(rows, COLUMNS)
    only = manifest(docs).first()
    assert only.leaf == only.subroot == only.root == only.folded_root and only.proof_sha256 == h("") and only.verified
    assert found(docs) == brute(rows)
    empty = manifest(no_docs(spark))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_hot_source_beyond_one_superblock(spark):
    """A source of more than two superblocks, half of it one repeated row, beside sources of one row."""
    rows = [(i, "hot", "en", i, f"Row {i}") for i in range(5000)] + [(77, "hot", "en", 0, "Same")] * 4500
    rows += [(i, f"s{i}", "en", i, "Lone") for i in range(20)]
    assert found(spark.createDataFrame(rows, COLUMNS).repartition(5)) == brute(rows)


@pytest.mark.parametrize("n_sources", [1, 300])
def test_several_tables_of_superblocks(spark, monkeypatch, n_sources):
    """Superblocks of one round only: every tree passes through several tables on the way up and down."""
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, f"s{i % n_sources if i > 600 else 0}", "en", i, f"Row {i}") for i in range(1000)]
    assert found(spark.createDataFrame(rows, COLUMNS)) == brute(rows)


def test_altered_rows_only_fail(spark):
    rows = [(i, "a" if i % 3 else "b", "en", i, "ALL CAPS" if i % 2 else "no caps") for i in range(200)]
    got = manifest(spark.createDataFrame(rows, COLUMNS), F.col("doc_id") < 20).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(20) if i % 2}
    assert len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 2


def test_sql_deep_enough():
    """The reference SQL climbs as far as it needs to."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, 'T' || i AS text, 'en' AS lang, 'a' AS source, i AS n_chars FROM range(300) t(i)")
    rows = [(i, "a", "en", i, f"T{i}") for i in range(300)]
    got = {r[0]: r for r in con.execute(SQL["op11_merkle_manifest"]).fetchall()}
    assert sorted(map(tuple, got.values()), key=str) == brute(rows)
