"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

An occurrence of an m-character item with at most k edits keeps at least m + 1 - q (k + 1) of its q-grams, on
diagonals (place in the text less place in the item) that lie at most k apart.  Diagonals are counted
in bands of 2 (k + 1) that overlap by half, so one band sees all of them.  Bands below the bound are dropped;
the others are verified by an edit-distance alignment inside the band.  q is 8, and less for items so short that
8-grams would leave no bound: then m // (k + 1), so that items of any length keep their whole budget of edits.

Texts and items are compared in lower case with white space runs as one blank; positions are code
points of the original text, ends exclusive.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textbatch import mix, powers

Q = 8
EDIT_SHARE = 0.1  # edits allowed, as a share of an item's characters
ITEM_CHARS = 1_000_000  # characters of items in one pass; beyond that, one pass for each such part
SLICE_CHARS = 1 << 19
JOBS = 96  # alignments computed side by side
BLANKS = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
FOUND = "array<struct<item:long,start:int,end:int,edits:int>>"


def lowered(text: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] or c for c in text)


def normal(text: str):
    """Code points of the normal form, and where each stands in the text."""
    code = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (code <= 32) & (code >= 9)
    odd = code >= 0x85
    if odd.any():
        blank |= odd & np.isin(code, BLANKS)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    code = np.where(blank, np.uint32(32), code)
    at = np.flatnonzero(keep)
    return code[at], at


def grams(code, q: int = Q):
    """Hash of the q-gram that starts at each place."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    up, down = powers(len(code))
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=total[1:])
    return mix((total[q:] - total[:-q]) * down[: len(code) - q + 1])


def aligned(jobs: list[tuple]) -> list[tuple[int, int]]:
    """For each (item, text, low, high): the fewest edits that turn the item into a stretch of the text along
    diagonals low..high, and the stretch's end; of several ends the one nearest to the middle diagonal.

    Jobs of similar lengths go through the band together, one row of all their tables at a time.
    """
    out: list = [None] * len(jobs)
    order = sorted(range(len(jobs)), key=lambda i: len(jobs[i][0]))
    for c in range(0, len(order), JOBS):
        chunk = order[c : c + JOBS]
        size = np.array([len(jobs[i][0]) for i in chunk])
        low = np.array([jobs[i][2] for i in chunk])[:, None]
        width = np.array([jobs[i][3] - jobs[i][2] + 1 for i in chunk])[:, None]
        chars = np.array([len(jobs[i][1]) for i in chunk])[:, None]
        most, wide = int(size.max()), int(width.max())
        item = np.full((len(chunk), most), 0xFFFFFFFE, np.uint32)
        text = np.full((len(chunk), most + wide), 0xFFFFFFFF, np.uint32)
        for r, i in enumerate(chunk):
            pattern, code, a, _ = jobs[i]
            item[r, : len(pattern)] = pattern
            begin, end = max(0, a), max(0, min(len(code), a + most + wide))
            if begin < end:
                text[r, begin - a : end - a] = code[begin:end]
        diagonal = np.arange(wide, dtype=np.int32)
        place = (low + diagonal).astype(np.int64)
        first, last = -place, np.where(diagonal < width, chars - place, -1)
        far = np.int32(most + wide + 1)
        row = np.where((first <= 0) & (last >= 0), np.int32(0), far)
        for i in range(1, most + 1):
            live = slice(int(np.searchsorted(size, i)), None)
            old = row[live]
            step = old + (text[live, i - 1 : i - 1 + wide] != item[live, i - 1 : i])
            np.minimum(step[:, :-1], old[:, 1:] + 1, out=step[:, :-1])
            step[(first[live] > i) | (last[live] < i)] = far
            step -= diagonal
            np.minimum.accumulate(step, axis=1, out=step)
            step += diagonal
            row[live] = np.minimum(step, far)
        for r, i in enumerate(chunk):
            edits = int(row[r].min())
            ends = np.flatnonzero(row[r] == edits)
            best = int(ends[np.abs(ends - int(width[r, 0]) // 2).argmin()])
            out[i] = (edits, int(low[r, 0]) + best + int(size[r]))
    return out


def exact(item, text, begin: int, end: int) -> int:
    """First place in text[begin:end] where the item stands unchanged, or -1."""
    part, wanted = text[begin:end].tobytes(), item.tobytes()
    at = part.find(wanted)
    while at >= 0 and at % 4:
        at = part.find(wanted, at + 1)
    return begin + at // 4 if at >= 0 else -1


def gram_length(size: int, share: float) -> int:
    """Length of the q-grams for an item: Q, or as long as one of them survives the item's budget of edits."""
    return max(1, min(Q, size // (int(size * share) + 1)))


@dataclass
class ItemIndex:
    """q-grams of the items of one pass, with a bit table that most q-grams of a text fail."""

    ids: list[int]
    codes: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray
    gram: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    shift: int
    q: int = Q

    @classmethod
    def build(cls, items: list[tuple[int, str]], share: float, q: int = Q) -> ItemIndex:
        """The index of those items whose q-gram length is ``q``."""
        ids, codes = [], []
        for name, text in items:
            code, _ = normal((text or "").strip())
            if len(code) and gram_length(len(code), share) == q:
                ids.append(name)
                codes.append(code)
        size = np.array([len(c) for c in codes], np.int64)
        budget = (size * share).astype(np.int64)
        found = [grams(c, q) for c in codes]
        owner = np.repeat(np.arange(len(codes)), [len(g) for g in found])
        place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
        gram = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        gram, owner, place = gram[order], owner[order], place[order]
        unique, begin = np.unique(gram, return_index=True)
        log = min(24, max(10, int(len(unique) * 32).bit_length()))
        bits = np.zeros(1 << log, bool)
        bits[(unique >> np.uint64(64 - log)).astype(np.int64)] = True
        return cls(ids, codes, budget, size + 1 - q * (budget + 1), unique, np.append(begin, len(gram)), owner, place, bits, 64 - log, q)

    def regions(self, code):
        """Item, lowest and highest diagonal of the bands of a text that reach their item's bound."""
        none = np.zeros(0, np.int64)
        hashed = grams(code, self.q)
        at = np.flatnonzero(self.bits.take((hashed >> np.uint64(self.shift)).astype(np.int64)))
        if not len(at) or not len(self.gram):
            return none, none, none
        slot = np.minimum(np.searchsorted(self.gram, hashed[at]), len(self.gram) - 1)
        same = self.gram[slot] == hashed[at]
        at, slot = at[same], slot[same]
        many = self.begin[slot + 1] - self.begin[slot]
        from_ = np.repeat(self.begin[slot] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        item = self.item[from_]
        diagonal = np.repeat(at, many) - self.place[from_] + (1 << 31)
        step = self.budget[item] + 1
        band = diagonal // step
        key = np.concatenate((item << 33 | band, item << 33 | (band - 1)))
        key, count = np.unique(key, return_counts=True)
        item, band = key >> 33, key & ((1 << 33) - 1)
        good = count >= self.least[item]
        item, low = item[good], band[good] * (self.budget[item[good]] + 1) - (1 << 31)
        return item, low, low + 2 * (self.budget[item] + 1) - 1

    def whole(self, item: int, code, start: int, end: int) -> bool:
        """An item of fewer than Q characters counts as whole words only: no letter or digit goes on beyond its own at an edge."""
        if len(self.codes[item]) >= Q:
            return True
        first, last = self.codes[item][0], self.codes[item][-1]
        before = start > 0 and chr(first).isalnum() and chr(code[start - 1]).isalnum()
        return not (before or (end < len(code) and chr(last).isalnum() and chr(code[end]).isalnum()))

    def search(self, forms: list[tuple]) -> list[list[tuple[int, int, int, int]]]:
        """All occurrences in each text's normal form: item, start, end, edits, one for each stretch of a text.

        Neighbouring bands see the same occurrence; of occurrences of an item that overlap, the closest counts.
        """
        best: list[dict] = [{} for _ in forms]
        jobs, owner = [], []
        for f, (code, _) in enumerate(forms):
            for i, a, b in zip(*(x.tolist() for x in self.regions(code)), strict=True):
                known = best[f].setdefault(i, [])
                if any(a <= start <= b for _, start, _ in known):
                    continue  # an unchanged occurrence: whatever else this band holds overlaps it and is farther
                pattern = self.codes[i]
                same = exact(pattern, code, max(a, 0), b + len(pattern))
                if same >= 0:
                    known.append((0, same, same + len(pattern)))
                else:
                    jobs.append((pattern, code, a, b))
                    owner.append((f, i))
        good = [(f, i, job, e, end) for (f, i), job, (e, end) in zip(owner, jobs, aligned(jobs), strict=True) if e <= self.budget[i]]
        back = aligned([(job[0][::-1], job[1][:end][::-1], -int(self.budget[i]), int(self.budget[i])) for _, i, job, _, end in good])
        for (f, i, job, edits, end), (again, length) in zip(good, back, strict=True):
            start = end - length if again <= edits else max(0, end - len(job[0]))
            best[f][i].append((edits, start, end))
        out = []
        for (code, at), items in zip(forms, best, strict=True):
            rows = []
            for i, found in items.items():
                taken: list[tuple[int, int]] = []
                for edits, start, end in sorted(found):
                    if start < end and self.whole(i, code, start, end) and all(end <= s or start >= e for s, e in taken):
                        taken.append((start, end))
                        rows.append((self.ids[i], int(at[start]), int(at[end - 1]) + 1, edits))
            out.append(sorted(rows, key=lambda x: (x[1], x[0])))
        return out


def searched(index: ItemIndex, texts):
    """Occurrences in each text of an Arrow array.  Short texts are screened together, a blank of code 0 between them."""
    import pyarrow as pa

    out: list[list] = []
    forms, size = [], 0

    def flush():
        code = np.concatenate([np.append(c, np.uint32(0)) for c, _ in forms])
        item, low, high = index.regions(code)
        ends = np.cumsum([len(c) + 1 for c, _ in forms])
        size = np.array([len(c) for c in index.codes], np.int64)
        first = np.searchsorted(ends, np.clip(low, 0, len(code) - 1), "right")
        last = np.searchsorted(ends, np.clip(high + size[item], 0, len(code) - 1), "right") if len(item) else first
        hit = {d for a, b in zip(first.tolist(), last.tolist(), strict=True) for d in range(a, b + 1)}
        close = iter(index.search([form for i, form in enumerate(forms) if i in hit]))
        out.extend(next(close) if i in hit else [] for i in range(len(forms)))
        forms.clear()

    for text in texts:
        text = text.as_py() or ""
        code, at = normal(text)
        forms.append((code, at))
        size += len(code)
        if size >= SLICE_CHARS:
            flush()
            size = 0
    if forms:
        flush()
    kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    names = ("item", "start", "end", "edits")
    return pa.array([[dict(zip(names, x, strict=True)) for x in row] for row in out], kind)


def _searcher(rows: list[tuple[int, str]], share: float):
    """Column function: the occurrences of one part's items in a text, by start."""
    import pyarrow as pa
    from pyspark.sql.functions import arrow_udf

    indexes = [ItemIndex.build(rows, share, q) for q in range(1, Q + 1)]
    indexes = [x for x in indexes if x.ids]

    def run(texts):
        found = [searched(x, texts) for x in indexes]
        if len(found) == 1:
            return found[0]
        merged = [sorted((x for f in found for x in f[i].as_py()), key=lambda x: (x["start"], x["item"])) for i in range(len(texts))]
        kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
        return pa.array(merged, kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(run, FOUND)


def parts_of(benchmark: DataFrame) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many parts of about ITEM_CHARS characters the items make, and the items of one part after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parts = max(1, -(-total // ITEM_CHARS))
    if parts > 1:
        part = F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(parts))  # repeats spread
        items = written(items.withColumn("part", part), "items")

    def rows(part: int) -> list[tuple[int, str]]:
        own = items.where(F.col("part") == part) if parts > 1 else items
        return sorted((r.item_id if r.item_id is not None else -1, r.text) for r in own.collect())

    return parts, (rows(p) for p in range(parts))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """doc_id, item_id, start, end, edits: one row for each occurrence; documents without any give no row.

    ``benchmark`` needs item_id and text.  NULL, empty and blank items are found nowhere; items of fewer than Q characters
    only as whole words; repeated items are found each.  NULL and empty texts hold nothing.  Items go to the tasks in parts
    of ITEM_CHARS characters, one pass over the documents for each, written before the next part is read: the driver
    and a task hold one part, however large the benchmark is.
    """
    parts, each = parts_of(benchmark)
    passes = []
    for rows in each:
        found = docs.select("doc_id", F.explode(_searcher(rows, share)(F.col("text"))).alias("x"))
        found = found.select("doc_id", F.col("x.item").alias("item_id"), "x.start", "x.end", "x.edits")
        passes.append(written(found, "hits") if parts > 1 else found)
    return functools.reduce(DataFrame.unionByName, passes)


def clean(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """``docs`` without those in which an item occurs, by the same passes; each works on what the one before kept."""
    parts, each = parts_of(benchmark)
    for rows in each:
        kept = docs.where(F.size(_searcher(rows, share)(F.col("text"))) == 0)
        docs = written(kept, "clean") if parts > 1 else kept
    return docs
