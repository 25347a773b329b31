"""Sparse word features: 64-bit hashes of lower-case letter and digit words and their n-grams (runs inside tasks)."""

from __future__ import annotations

import numpy as np

from . import textbatch


def word_bytes(data: np.ndarray) -> np.ndarray:
    """Letters, digits and all bytes beyond ASCII."""
    return ((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128)


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash, owner, start and end of every word."""
    starts, ends, owner = textbatch.spans(word_bytes(data), offsets)
    return textbatch.hashes(textbatch.ascii_lower(data), starts, ends), owner, starts, ends


def ngrams(word: np.ndarray, owner: np.ndarray, most: int):
    """Hashes and owners of all n-grams of 1 to ``most`` words; none crosses owners."""
    found, owners = [word], [owner]
    for n in range(2, most + 1):
        last = len(word) - n + 1
        if last <= 0:
            break
        total = np.full(last, n, np.uint64)
        for i in range(n):
            total = textbatch.mix(total * np.uint64(0xD6E8FEB86659FD93) + word[i : i + last])
        whole = owner[:last] == owner[n - 1 : n - 1 + last]
        found.append(total[whole])
        owners.append(owner[:last][whole])
    return np.concatenate(found), np.concatenate(owners)


class Lookup:
    """Place of a hash among a sorted list of known ones; a bit table turns most unknown ones away."""

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        log = min(22, max(10, int(len(known) * 32).bit_length()))
        self.shift = np.uint64(64 - log)
        self.bits = np.zeros(1 << log, bool)
        self.bits[(self.known >> self.shift).astype(np.int64)] = True

    def find(self, hashed: np.ndarray):
        """Index of the input and place in ``known`` of each known hash."""
        at = np.flatnonzero(self.bits.take((hashed >> self.shift).astype(np.int64)))
        if not len(at) or not len(self.known):
            none = np.zeros(0, np.int64)
            return none, none
        place = np.minimum(np.searchsorted(self.known, hashed[at]), len(self.known) - 1)
        same = self.known[place] == hashed[at]
        return at[same], place[same]


def counted(owner: np.ndarray, place: np.ndarray, n_known: int):
    """Owner, place and count of each distinct pair."""
    key, count = np.unique(owner.astype(np.int64) * max(n_known, 1) + place, return_counts=True)
    return key // max(n_known, 1), key % max(n_known, 1), count


def flat_texts(texts: list[bytes]):
    """Bytes and offsets of a list of texts."""
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), offsets
