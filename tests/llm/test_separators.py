"""The separator scan against a plain loop."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from creditloom.llm.common import fresh_folder
from creditloom.llm.queries import END_OF_TEXT, QUERIES, word_tokenizer
from creditloom.llm.separators import count_tokens, list_token_files, write_token_files
from llm.helpers import ODD, no_docs, odd_docs, texts_of


@pytest.mark.parametrize("block", [16, 64, 1000])
@pytest.mark.parametrize("width", [2, 4])
def test_blocks_are_stitched(spark, tmp_path, block, width):
    rng, want = np.random.default_rng(1), []
    for name, n, kinds in (("a.bin", 1000, 40), ("b.bin", 7, 9), ("c.bin", 5000, 40), ("d.bin", 64, 2), ("e.bin", 0, 2)):
        ids = rng.integers(0, kinds, n).astype(f"<u{width}")
        ids[100:4000] = 5
        ids.tofile(tmp_path / name)
        begin = number = 0
        for i in np.flatnonzero(ids == 0):
            want.append((name, number, begin, i - begin, True))
            begin, number = i + 1, number + 1
        if begin < n:
            want.append((name, number, begin, n - begin, False))
    rows = count_tokens(list_token_files(spark, str(tmp_path)), 0, width, block).collect()
    assert sorted((r.file.rsplit("/")[-1], r.doc, r.start, r.n_tokens, r.closed) for r in rows) == sorted(want)


def test_documents_round_trip(spark):
    tokenizer = Tokenizer.from_file(word_tokenizer())
    rows = QUERIES["op4_separator_scan"](spark, SMALL).collect()
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts_of(spark, SMALL).values()]
    assert sorted(r.n_tokens for r in rows) == sorted(want) and all(r.closed for r in rows)


def test_odd_rows_and_wrong_sizes(spark, tmp_path):
    tokenizer = Tokenizer.from_file(word_tokenizer())
    made = write_token_files(odd_docs(spark), word_tokenizer(), fresh_folder(spark, "t"), END_OF_TEXT)
    want = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t in ODD]
    rows = count_tokens(made.unionByName(made), END_OF_TEXT).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(want)  # one text holds the literal <|endoftext|>
    with pytest.raises(Exception, match="cannot end documents"):
        write_token_files(odd_docs(spark), word_tokenizer(), fresh_folder(spark, "t"), 49407)
    made = write_token_files(no_docs(spark), word_tokenizer(), fresh_folder(spark, "t"), END_OF_TEXT)
    assert count_tokens(made, END_OF_TEXT).collect() == []
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        count_tokens(list_token_files(spark, str(tmp_path)), 0)
