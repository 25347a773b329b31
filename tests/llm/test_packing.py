"""Token ids against the tokenizer, and packing against its constraints."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SMALL
from creditloom.llm import encode
from creditloom.llm.encode import WordEncoder
from creditloom.llm.packing import Capacity, pack, pack_documents
from creditloom.llm.queries import word_tokenizer
from llm.helpers import ODD, no_docs, odd_docs, texts_of

TOKENIZER = Tokenizer.from_file(word_tokenizer())
ENCODER = WordEncoder(word_tokenizer())


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé 'sßÀ<|>.!19\n\t\x0b\x1c\x85 ́İΣς "), st.characters(codec="utf-8")), max_size=60))
def test_same_ids_as_whole_texts(text):
    assert np.frombuffer(ENCODER.ids(text.encode()), "<u4").tolist() == ids_of(text)


def check(rows, texts, capacity=2048):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    for doc, text in texts:
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc)
        ids = [*ids_of(text), 0]
        want = [(k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert set(want) <= set(own)
    return len(by_sequence), math.ceil(total / capacity)


def test_documents(spark):
    rows = pack_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), word_tokenizer()).collect()
    used, bound = check(rows, texts_of(spark, SMALL).items())
    assert used <= bound * 1.02 + 1


def test_odd_rows(spark):
    rows = pack_documents(odd_docs(spark), word_tokenizer()).collect()
    check(rows, ODD)
    assert [r.length for r in rows if r.doc_id in (1, 2, 3)] == [1, 1, 1]
    assert len([r for r in rows if r.doc_id == 4]) == 2


def test_no_rows(spark):
    assert pack_documents(no_docs(spark), word_tokenizer()).collect() == []


def test_ids_travel_with_pieces(spark):
    docs = spark.createDataFrame([(1, "some words here"), (2, "more")], "doc_id long, text string")
    rows = pack_documents(docs, word_tokenizer(), with_ids=True).collect()
    assert {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in rows} == {1: [*ids_of("some words here"), 0], 2: [*ids_of("more"), 0]}


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_three_capacities_hold(rule):
    rng = np.random.default_rng(1)
    length = rng.integers(1, 400, 500)
    capacity = Capacity(tokens=1000, documents=4, attention=300_000, rule=rule, weights=(1.0, 0.3, 0.3))
    where, place = pack(length, capacity)
    for b in np.unique(where):
        own = length[where == b]
        assert own.sum() <= 1000 and len(own) <= 4 and (own**2).sum() <= 300_000
        assert sorted(place[where == b]) == list(range(len(own)))


def test_attention_cuts_pieces_not_sequences(spark):
    docs = spark.createDataFrame([(i, "one two three " * 40) for i in range(48)] + [(99, "word " * 3000)], "doc_id long, text string")
    n = len(ids_of("one two three " * 40)) + 1
    quarter = Capacity(attention=2048**2 // 4)
    rows = pack_documents(docs, word_tokenizer(), quarter).collect()
    assert max(r.length for r in rows) == 1024 and sum(r.length for r in rows if r.doc_id == 99) == 3001
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(x) <= 2048 and sum(v * v for v in x) <= 2048**2 // 4 for x in held.values())
    short = pack_documents(docs.where("doc_id < 99"), word_tokenizer(), quarter)
    assert short.select("sequence_id").distinct().count() == math.ceil(48 / (2048 // n))
    with pytest.raises(ValueError):
        pack_documents(docs, word_tokenizer(), Capacity(attention=0))


def test_an_item_beyond_the_capacities_is_an_error():
    with pytest.raises(ValueError):
        pack(np.array([10, 2000]), Capacity(tokens=1000))


def test_chunks_of_one_word_merge_it_once(monkeypatch):
    """Case and signs at the ends do not merge a word again; a full cache of pieces starts anew with the same ids."""
    texts = ["Hähent, hähent! HÄHENT### it's 12", "reesea. reesea Reesea; don't"] * 3
    plain = [np.array(ENCODER.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    merged, full = [], WordEncoder(word_tokenizer())
    once = full.piece
    monkeypatch.setattr(full, "piece", lambda p: merged.append(p) or once(p))
    assert [full.ids(t.encode()) for t in texts] == plain
    assert merged.count("hähent") == merged.count("reesea") == 1
    monkeypatch.setattr("creditloom.llm.encode.CACHE_PIECES", 2)
    small = WordEncoder(word_tokenizer())
    assert [small.ids(t.encode()) for t in texts] == plain and len(small.pieces) <= 2


def test_plain_words_are_merged_without_patterns(monkeypatch):
    """A word of a-z, alone or with one sign after it, is known as a piece; other chunks are still cut."""
    whole = WordEncoder(word_tokenizer()).tokenizer
    texts = ["Plain words, PLAIN Words. and; more: signs? yes!", ". , a, a.", "a,, it's x2 Größe, <|endoftext|>"]
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [WordEncoder(word_tokenizer()).ids(t.encode()) for t in texts] == want
    monkeypatch.setattr(encode, "PIECES", None)
    assert WordEncoder(word_tokenizer()).ids(texts[0].encode()) == want[0]
