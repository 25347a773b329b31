"""Slots, maps and places."""

import zlib

from conftest import SMALL
from creditloom.llm.slots import SlotMap, shard_documents
from llm.helpers import no_docs, odd_docs, texts_of


def test_documents(spark):
    texts = texts_of(spark, SMALL)
    placed, maps = shard_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), shards=6)
    rows = placed.collect()
    first, at, grown = maps[0], maps[-2], maps[-1]
    assert [m.version for m in maps] == list(range(1, len(maps) + 1)) and all(first.shard_of[s] == s % 6 for s in range(4096))
    totals, later = {}, {}
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        assert at.shard_of[r.unit] == r.shard and grown.shard_of[r.unit] == r.next_shard and r.unit % 4096 == r.virtual_slot
        assert r.next_shard in (r.shard, 6)
        later[r.next_shard] = later.get(r.next_shard, 0) + r.size
        totals[r.shard] = totals.get(r.shard, 0) + r.size
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for s in range(6):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert max(totals.values()) - min(totals.values()) < 0.02 * sum(totals.values()) / 6
    assert max(later.values()) < 1.2 * sum(later.values()) / 7 and len(later) == 7


def test_repeated_rows_spread(spark):
    """A third of all rows, then all rows, are one row."""
    from pyspark.sql import functions as F

    hot = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"))
    hot = hot.withColumn("text", F.when(F.col("doc_id") == 7, "the same text").otherwise(F.repeat(F.lit("ab "), (F.col("doc_id") % 9).cast("int"))))
    for docs in (hot, hot.where("doc_id = 7")):
        placed, maps = shard_documents(docs, shards=6)
        rows = placed.collect()
        totals = [sum(r.size for r in rows if r.shard == s) for s in range(6)]
        assert len(rows) == docs.count() and max(totals) - min(totals) < 0.02 * sum(totals) / 6
        for s in range(6):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
        assert len({r.virtual_slot for r in rows if r.doc_id == 7}) == 1 and len({r.unit for r in rows if r.doc_id == 7}) > 100
        assert len(maps) == 4 and max(len(m.shard_of) for m in maps) <= 4096 + 2 * 64 * 6


def test_odd_and_no_rows(spark):
    rows = shard_documents(odd_docs(spark), shards=3)[0].collect()
    assert len(rows) == 11 and all(r.size == 8 and r.text_crc32 == 0 for r in rows if r.doc_id in (1, 2))
    for s in range(3):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.virtual_slot for r in rows if r.doc_id == 4}) == 1
    assert shard_documents(no_docs(spark))[0].collect() == []


def test_map_versions(spark, tmp_path):
    loads = {s: 100 + s % 7 for s in range(64)}
    one = SlotMap.dealt(64, 4).rebalanced(loads, 0)
    assert one.version == 2 and max(one.totals(loads)) - min(one.totals(loads)) <= 100
    two = one.grown(loads)
    moved = [s for s in range(64) if one.shard_of[s] != two.shard_of[s]]
    assert moved and {two.shard_of[s] for s in moved} == {4} and two.version == 3
    assert max(two.totals(loads)) <= 1.2 * sum(loads.values()) / 5
    drift = loads | {s: 900 for s in range(64) if two.shard_of[s] == 0}
    three = two.rebalanced(drift)
    assert max(three.totals(drift)) < max(two.totals(drift))
    folder = str(tmp_path / "map")
    for m in (one, two, three):
        m.save(spark, folder)
    assert SlotMap.load(spark, folder).shard_of == three.shard_of
    assert SlotMap.load(spark, folder, 2).shard_of == one.shard_of
