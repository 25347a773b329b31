"""Vectorised word hashes over Arrow batches of texts (runs inside tasks)."""

from __future__ import annotations

import numpy as np

from .common import worker_cache

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers can be undone modulo 2**64
SLICE_BYTES = 1 << 20


def mix(x):
    """64-bit finaliser: spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column):
    """Bytes and offsets of an Arrow string column; NULL is the empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    worker_cache("powers")  # a new stage drops what the one before has kept
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch, text_at: int, limit: int = SLICE_BYTES):
    """Cut a record batch into slices of about ``limit`` text bytes; one row at least."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if n == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0), np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def powers(n: int):
    """The first n powers of the base and of its inverse; those for one slice of texts are kept."""
    kept = worker_cache("powers") if n <= SLICE_BYTES else {}
    if len(kept.get("up", ())) < n:
        size = max(n, SLICE_BYTES)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            kept[name] = np.multiply.accumulate(steps)
    return kept["up"], kept["down"]


def byte_table(change) -> np.ndarray:
    return np.array([change(i) for i in range(256)])


def ascii_lower(data):
    """Bytes with A-Z lowered."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def spans(inside, offsets):
    """Starts, ends and document numbers of the runs where ``inside`` holds; no run crosses documents."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    full = offsets[:-1] < offsets[1:]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][full]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data, starts, ends):
    """64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def not_space(data):
    return ~((data == 32) | ((data >= 9) & (data <= 13)))


def words(data, offsets):
    """Hash and document number of each word between ASCII white space, A-Z lowered."""
    starts, ends, doc = spans(not_space(data), offsets)
    return hashes(ascii_lower(data), starts, ends), doc


def shingle_sets(data, offsets, width: int):
    """Distinct word shingles by document, sorted: hashes, document numbers.

    A document of fewer words than ``width`` gives its whole sequence; one without words gives nothing.
    """
    word, doc = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    found, owner = [], []
    for size in range(1, width + 1):
        if size == width:
            at = np.flatnonzero(np.arange(len(doc)) - first[doc] <= count[doc] - width) if len(doc) else np.zeros(0, np.int64)
        else:
            at = first[count == size]
        total = np.full(len(at), size, np.uint64)
        for i in range(size):
            total = mix(total * np.uint64(0xD6E8FEB86659FD93) + word[at + i])
        found.append(total)
        owner.append(doc[at] if len(at) else np.zeros(0, np.int64))
    value, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    value, owner = value[order], owner[order]
    ends = np.cumsum(np.bincount(owner, minlength=n))
    begin = 0
    for end in ends:
        value[begin:end].sort()
        begin = end
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], owner[keep]


def sums(value, owner, n: int):
    """Wrapping sum of values by owner."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, owner, value)
    return out
