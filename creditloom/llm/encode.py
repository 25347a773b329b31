"""Token ids by a public tokenizer file, with a bounded cache of white-space-free chunks (runs inside tasks)."""

from __future__ import annotations

import re
import struct

from .common import worker_cache

CACHE_CHUNKS = 500_000  # about 100 MB; the cache starts anew beyond that
CACHE_PIECES = 250_000  # about 40 MB, likewise

#: Text for which lower case, composition and letter classes are the same in every library.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The pieces into which word_bpe_49k.json cuts lower-case text of that kind.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

SIGNS = frozenset(b"%c" % c for c in b",.!?;:")  # each a piece of its own after a word


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Kept(dict):
    """A dictionary that makes what it does not hold yet, so that one pass over a text's chunks finds and adds them."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """Ids of whole texts for a tokenizer that drops white space, as little-endian unsigned 32-bit bytes.

    White space always ends a piece there, so a text's ids are those of its chunks in a row.  Chunks of
    plain letters go straight to the vocabulary's merges; any other chunk goes through the whole tokenizer.
    Chunks that differ in case or in signs at their ends share the pieces, which are merged once.
    ``simple`` is for word_bpe_49k.json, whose pieces PIECES states.
    """

    def __init__(self, path: str, simple: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.simple = simple
        self.known: dict[bytes, bytes] = Kept(lambda chunk: self.chunk(chunk))
        self.pieces: dict[str, bytes] = Kept(lambda piece: self.piece(piece))
        self.shown = byte_characters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def piece(self, piece: str) -> bytes:
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        shown = piece if piece.isascii() else "".join(map(self.shown.__getitem__, piece.encode("utf-8")))
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(shown)])

    def chunk(self, chunk: bytes) -> bytes:
        if self.simple and chunk.isalpha():  # A-Z and a-z alone: one piece
            return self.pieces[chunk.lower().decode("ascii")]
        if self.simple and chunk[-1:] in SIGNS and chunk[:-1].isalpha():
            return self.pieces[chunk[:-1].lower().decode("ascii")] + self.pieces[chunk[-1:].decode("ascii")]
        text = chunk.decode("utf-8")
        if not (self.simple and PLAIN.fullmatch(text) and "<|" not in text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return b"".join(map(self.pieces.__getitem__, PIECES.findall(text.lower())))

    def ids(self, text: bytes) -> bytes:
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    kept = worker_cache("encoders")
    if path not in kept:
        kept[path] = WordEncoder(path)
    return kept[path]
