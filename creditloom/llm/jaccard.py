"""Exact self-join of documents on the Jaccard similarity of word shingles, by universe partition.

Sets are grouped in size bands.  For a band whose sets may differ from a partner in at most H
elements, the universe is hashed into H + 1 segments.  By the pigeonhole principle, thresholds
t in {-1, 0, 1} per segment with sum(t + 1) = H + 1 guarantee one segment that differs in at most t
elements: t = 0 looks for the equal segment subset, t = 1 also for subsets one deletion away, and
t = -1 skips the segment.  Every set indexes all its segment subsets, and the one-deletion
neighbourhoods of a few spare segments; as a probe it allocates the thresholds by cost: segments that
are empty or nearly so collide with many unrelated sets, and are skipped in exchange for t = 1
on cheap spare segments.  Each pair is looked for by its larger set only.

Buckets of equal signatures are read as one sorted stream and tied to their first set (a star, not
all pairs), so that thousands of similar texts give thousands of candidates, not millions.  Every
candidate is verified on the two whole sets.  Only bucket members that are not connected
by verified links yet are then screened against each other by a lower bound of their difference (the counts of
their elements in fixed segments), and the groups of those that may be linked are compared, block by block, inside
the tasks.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch
from .common import if_small, written
from .graph import components

INDEX, PROBE = 1, 2
BINS, BIN_SALT, BUCKET_ROWS = 128, 0x3C6EF372FE94F82B, 512
NODE_SALT, CHECK_SALT = 0x51ED270B76A5A5A5, 0x2545F4914F6CDD1D
FINE_BINS, REFINE_BYTES = 2048, 128 << 20  # clusters that would ship more bytes of sets are first split by finer bins
COARSE_BINS, FINER = 32, (BINS, FINE_BINS)  # widths at which pairs are screened, one after the other
BROADCAST_ROWS = 500_000  # node ids: about 20 MB as a hash relation
BLOCK_ROWS, BLOCK_BYTES = 256, 24 << 20  # sets that meet in one group: two blocks of this size at most, about


def schemes(num: int, den: int) -> dict[str, np.ndarray]:
    """Size bands [lo, hi] for similarity num/den, with segments (0: equal sets only) and spare segments."""
    rows, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo, lo * den // num)
        most = (hi + hi * den // num) * (den - num) // (den + num)
        m = most + 1 if most else 0
        spare = min(m - 1, 1 + math.ceil(2 * m * math.exp(-lo / m))) if m else 0
        rows.append((lo, hi, m, spare))
        lo = hi + 1
    return dict(zip(("lo", "hi", "m", "spare"), np.array(rows, np.int64).T, strict=True))


def identity(value, owner, n: int):
    """Two independent 64-bit sums of each set; the first names its class, the second checks it."""
    one, two = np.uint64(NODE_SALT), np.uint64(CHECK_SALT)
    return (textbatch.sums(textbatch.mix(value ^ s), owner, n) for s in (one, two))


def bins_of(value, owner, n: int, width: int = BINS) -> np.ndarray:
    """Elements of each set in ``width`` (a power of two) fixed segments of the universe, 255 at most.

    Two sets differ in no fewer elements than their bins differ in sum, which screens candidates without their sets.
    """
    place = (textbatch.mix(value ^ np.uint64(BIN_SALT)) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(owner * width + place, minlength=n * width), 255).astype(np.uint8).reshape(n, width)


def facts_of(width: int):
    """Task function: doc_id, n_shingles, node, check and bins of each document; node is NULL for the empty set."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for part in textbatch.slices(batch, 1):
                value, owner = textbatch.shingle_sets(*textbatch.flat(part.column(1)), width)
                count = np.bincount(owner, minlength=part.num_rows)
                node, check = identity(value, owner, part.num_rows)
                bins = bins_of(value, owner, part.num_rows)
                empty = count == 0
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array(count, pa.int64()),
                        pa.array(node.view(np.int64), pa.int64(), mask=empty),
                        pa.array(check.view(np.int64), pa.int64(), mask=empty),
                        pa.array([b.tobytes() for b in bins], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "node", "mark", "bins"],
                )

    return run


def fresh_rows(node, seen: set):
    """Rows whose node is not in ``seen`` yet, which they enter."""
    keep = np.zeros(len(node), bool)
    for i, x in enumerate(node.tolist()):
        if x not in seen:
            seen.add(x)
            keep[i] = True
    return keep


def allocate(size, job, spare, n_jobs: int):
    """Thresholds of all segments: -1, 0 or 1, with an equal number of -1 and 1 in every job.

    The cost of a segment falls with its number of elements: an empty one matches a fixed share of
    all sets, a single shingle may be a common passage.
    """
    cost = np.array([1e6, 30.0, 3.0, 1.0])
    of = lambda k: cost[np.clip(k, 0, 3)]
    t = np.zeros(len(size), np.int64)
    dear = np.flatnonzero(size <= 1)
    cheap = np.flatnonzero(spare & (size >= 2))
    extra = size[cheap] * (1 + of(size[cheap] - 1))
    dear = dear[np.lexsort((size[dear], job[dear]))]
    order = np.lexsort((extra, job[cheap]))
    cheap, extra = cheap[order], extra[order]

    def ranked(at):
        own = job[at]
        start = np.searchsorted(own, np.arange(n_jobs))
        return own * (1 << 32) + np.arange(len(at)) - start[own]

    _, i, j = np.intersect1d(ranked(dear), ranked(cheap), assume_unique=True, return_indices=True)
    swap = of(size[dear[i]]) > extra[j]
    t[dear[i[swap]]] = -1
    t[cheap[j[swap]]] = 1
    return t


def signatures(value, first, count, bands: dict):
    """Signature, document and flags of every index and probe entry of the given sets.

    ``value[first[d] : first[d] + count[d]]`` is the set of document d.
    """
    mix, u64 = textbatch.mix, np.uint64
    lo, hi, m, spare, num, den = (bands[k] for k in ("lo", "hi", "m", "spare", "num", "den"))
    own = np.searchsorted(lo, count, "right") - 1
    docs = np.arange(len(count))
    jd, jb, jown = [docs], [own], [np.ones(len(docs), bool)]
    for back in (1, 2):  # smaller bands that hold possible partners
        at = own - back
        fits = (at >= 0) & (hi[np.maximum(at, 0)] * den >= count * num)
        jd, jb, jown = [*jd, docs[fits]], [*jb, at[fits]], [*jown, np.zeros(int(fits.sum()), bool)]
    jd, jb, jown = np.concatenate(jd), np.concatenate(jb), np.concatenate(jown)
    used = m[jb] > 0
    jd, jb, jown = jd[used], jb[used], jown[used]
    size, segs = count[jd], m[jb]
    job = np.repeat(np.arange(len(jd)), size)
    at = np.arange(len(job)) + np.repeat(first[jd] - (np.cumsum(size) - size), size)
    salted = mix(value[at] ^ mix(jb.astype(u64) + u64(77))[job])
    seg = (((salted >> u64(32)) * segs.astype(u64)[job]) >> u64(32)).astype(np.int64)
    element = mix(salted + u64(0x1234567))
    base = np.cumsum(segs) - segs
    slot = base[job] + seg
    n_slots = int(segs.sum())
    total = textbatch.sums(element, slot, n_slots)
    elements = np.bincount(slot, minlength=n_slots)
    slot_job = np.repeat(np.arange(len(jd)), segs)
    slot_seg = np.arange(n_slots) - base[slot_job]
    is_spare = slot_seg < spare[jb][slot_job]
    t = allocate(elements, slot_job, is_spare, len(jd))
    salt = mix((jb[slot_job].astype(u64) << u64(32)) + slot_seg.astype(u64) + u64(0xABCDEF))
    full = mix(total ^ salt)
    near = u64(0x6A09E667F3BCC909)
    owns = jown[slot_job]
    out = []

    def add(sig, slots, flags):
        keep = flags > 0
        out.append((sig[keep], jd[slot_job[slots[keep]]], flags[keep]))

    every = np.arange(n_slots)
    add(full, every, owns * INDEX + (t >= 0) * PROBE)  # equal segment subsets
    one = np.flatnonzero(t == 1)
    add(mix(full[one] ^ near), one, np.full(len(one), PROBE))  # equal to a deletion of the partner's
    away = np.flatnonzero(is_spare[slot])
    slots = slot[away]
    deleted = mix((total[slots] - element[away]) ^ salt[slots])
    add(deleted, slots, (t[slots] == 1) * PROBE)  # a deletion equal to the partner's subset
    add(mix(deleted ^ near), slots, owns[slots] * (elements[slots] > 2) * INDEX)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def signed(width: int, num: int, den: int):
    """Task function: sig, node and meta (size and flags) of all entries of each set.

    The number of entries follows from the set alone, whatever the partitions.  Copies within the task count once.
    """
    import pyarrow as pa

    bands = schemes(num, den) | {"num": num, "den": den}

    def run(batches):
        seen: set = set()
        for batch in batches:
            for part in textbatch.slices(batch, 0):
                value, owner = textbatch.shingle_sets(*textbatch.flat(part.column(0)), width)
                count = np.bincount(owner, minlength=part.num_rows)
                node, _ = identity(value, owner, part.num_rows)
                first = np.cumsum(count) - count
                rows = np.flatnonzero(count > 0)
                rows = rows[fresh_rows(node[rows], seen)]
                sig, doc, flags = signatures(value, first[rows], count[rows], bands)
                d = rows[doc]
                columns = [pa.array(sig.view(np.int64)), pa.array(node[d].view(np.int64)), pa.array((count[d] << 8) | flags)]
                yield pa.record_batch(columns, names=["sig", "node", "meta"])

    return run


def starred(batches):
    """Task function over rows sorted by sig, size and node: each row after its bucket's first index entry, with that entry.

    Only the current bucket's first entry is held, so a bucket may be of any length.
    """
    import pyarrow as pa

    last = pivot = pivot_meta = last_node = None
    for batch in batches:
        sig, node, meta = (np.asarray(batch.column(i), np.int64) for i in range(3))
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        new[0] = last is None or sig[0] != last
        twin = np.zeros(len(sig), bool)
        twin[1:] = ~new[1:] & (node[1:] == node[:-1])
        twin[0] = not new[0] and node[0] == last_node
        run = np.cumsum(new)  # 0: goes on from the batch before
        n_runs = int(run[-1]) + 1
        at = np.full(n_runs, len(sig), np.int64)
        index = np.flatnonzero((meta & INDEX) > 0)
        np.minimum.at(at, run[index], index)
        held = np.minimum(at, len(sig) - 1)
        by, by_meta, has = node[held], meta[held], at < len(sig)
        after = np.arange(len(sig)) > at[run]
        if pivot is not None:
            by[0], by_meta[0], has[0] = pivot, pivot_meta, True
            after |= run == 0
        keep = after & has[run] & ~twin
        r = run[keep]
        yield pa.record_batch(
            [pa.array(x, pa.int64()) for x in (sig[keep], node[keep], meta[keep], by[r], by_meta[r])],
            names=["sig", "node", "meta", "pivot", "pivot_meta"],
        )
        last, last_node = sig[-1], node[-1]
        pivot, pivot_meta = (by[-1], by_meta[-1]) if has[-1] else (None, None)


def sets_of(width: int):
    """Task function: node and its sorted shingles as bytes; copies within the task once."""
    import pyarrow as pa

    def run(batches):
        seen: set = set()
        for batch in batches:
            for part in textbatch.slices(batch, 0):
                value, owner = textbatch.shingle_sets(*textbatch.flat(part.column(0)), width)
                count = np.bincount(owner, minlength=part.num_rows)
                node, _ = identity(value, owner, part.num_rows)
                ends = np.cumsum(count)
                rows = np.flatnonzero(count > 0)
                rows = rows[fresh_rows(node[rows], seen)]
                yield pa.record_batch(
                    [
                        pa.array(node[rows].view(np.int64)),
                        pa.array([value[ends[r] - count[r] : ends[r]].tobytes() for r in rows], pa.binary()),
                    ],
                    names=["node", "shingles"],
                )

    return run


def shared(left: list, right: list) -> np.ndarray:
    """Sizes of all intersections of two lists of sets of 64-bit numbers, a few thousand elements at a time."""
    count = np.array([len(x) for x in (*left, *right)])
    owner = np.repeat(np.arange(len(count)), count)
    _, name, often = np.unique(np.concatenate((*left, *right)), return_inverse=True, return_counts=True)
    common = np.flatnonzero(often[name] > 1)
    order = common[np.argsort(name[common], kind="stable")]
    owner, name = owner[order], name[order]
    name = np.cumsum(np.concatenate(([0], name[1:] != name[:-1]))) if len(name) else name
    out = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    for first in range(0, int(name[-1]) + 1 if len(name) else 0, step):
        part = slice(*np.searchsorted(name, (first, first + step)))
        has = np.zeros((len(count), step), np.float32)
        has[owner[part], name[part] - first] = 1
        out += has[: len(left)] @ has[len(left) :].T
    return out.astype(np.int64)


def crossed(num: int, den: int):
    """Task function for two blocks: linked pairs that join components which no earlier pair of the group has joined."""
    import pyarrow as pa

    def run(table):
        own, i, node, root = (table.column(c).to_numpy() for c in ("own", "i", "node", "root"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        order = np.lexsort((node, own))
        alone = (own == own[0]).all() and table.column("j")[0].as_py() == i[0]
        left = [k for k in order if own[k] == i[0]]
        right = left if alone else [k for k in order if own[k] != i[0]]
        pairs: list[tuple] = []
        if left and right and (root != root[0]).any():
            both = shared([sets[k] for k in left], [sets[k] for k in right])
            size = lambda ks: np.array([len(sets[k]) for k in ks])
            total = size(left)[:, None] + size(right)[None, :] - both
            good = (den * both >= num * total) & (root[left][:, None] != root[right][None, :])
            parent: dict = {}

            def top(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for x, y in zip(*np.nonzero(good), strict=True):
                a, b = left[x], right[y]
                p, q = top(root[a]), top(root[b])
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    pairs.append((node[a], node[b]))
        a, b = ([p[k] for p in pairs] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    left, out = np.ones(len(near), bool), []
    for start in range(len(near)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            found = np.flatnonzero(near[x] & left)
            left[found] = False
            out += [(x, int(y)) for y in found]
            queue += found.tolist()
    return out


def distances(bins: np.ndarray):
    """First row, and sums of differences of a run of rows to all rows from there on; about 8 MB of differences at a time."""
    start = 0
    while start < len(bins):
        stop = start + max(1, (1 << 22) // ((len(bins) - start) * bins.shape[1]))
        yield start, np.abs(bins[start:stop, None] - bins[None, start:]).sum(2, dtype=np.int32).astype(np.int64)
        start = stop


def may_link(bins: np.ndarray, size: np.ndarray, num: int, den: int, top: np.ndarray | None = None) -> np.ndarray:
    """Pairs of different ``top`` whose sizes and bins allow a link.

    Sums of neighbouring bins differ no more than the bins do: a few wide ones rule most pairs out, finer ones see the rest.
    """
    n = len(size)
    small, big = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
    most = (size[:, None] + size) * (den - num)
    near = small * den >= big * num
    if top is not None:
        near &= top[:, None] != top
    wide = bins.astype(np.int16)
    coarse = wide.reshape(n, COARSE_BINS, -1).sum(2, dtype=np.int16)  # 64 bins of 255 at most: below 2 ** 15
    for start, least in distances(coarse):
        stop = start + len(least)
        near[start:stop, start:] &= least * (den + num) <= most[start:stop, start:]
    left, right = np.nonzero(np.triu(near, 1))
    for width in (w for w in FINER if w <= wide.shape[1]):
        kept, step = [], (1 << 22) // width
        level = wide.reshape(n, width, -1).sum(2, dtype=np.int16)
        for i in range(0, len(left), step):
            x, y = left[i : i + step], right[i : i + step]
            kept.append(np.abs(level[x] - level[y]).sum(1, dtype=np.int32).astype(np.int64) * (den + num) <= most[x, y])
        if kept:
            left, right = (side[np.concatenate(kept)] for side in (left, right))
    good = np.zeros((n, n), bool)
    np.fill_diagonal(good, near.diagonal())
    good[left, right] = good[right, left] = True
    return good


def alike(num: int, den: int, width: int):
    """Task function over rows sorted by bucket and pair of blocks: ties a, b that connect the members which may be linked.

    Only pairs that are not linked to the same first set count.  Only the current pair of blocks is held.
    """
    import pyarrow as pa

    def run(batches):
        rest = None
        for batch in _and_last(batches):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if rest is not None:
                table = pa.concat_tables([rest, table]) if table is not None else rest
            if table is None or not table.num_rows:
                continue
            sig, i, j, node, size, top = (np.asarray(table.column(c).combine_chunks()) for c in ("sig", "i", "j", "node", "size", "top"))
            new = np.flatnonzero((sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = np.concatenate(([0], new, [len(sig)]))
            if batch is not None:  # the last group may go on
                rest, edges = table.slice(edges[-2]).combine_chunks(), edges[:-1]
            packed = table.column("bins").combine_chunks()
            _, places, data = packed.buffers()
            places = np.frombuffer(places, np.int32)[packed.offset : packed.offset + len(packed) + 1]
            bins = np.frombuffer(data, np.uint8)[places[0] : places[-1]].reshape(-1, width)
            a, b = [], []
            for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if end - begin < 2 or (top[begin:end] == top[begin]).all():
                    continue
                near = may_link(bins[begin:end], size[begin:end], num, den, top[begin:end])
                for x, y in forest(near):
                    a.append(node[begin + x])
                    b.append(node[begin + y])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def screened(num: int, den: int):
    """Task function: the pairs whose sizes and bins allow a link."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            bins = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16) for c in (4, 5)]
            least = np.abs(bins[0] - bins[1]).sum(1, dtype=np.int64)
            keep = pa.array(least * (den + num) <= size * (den - num))
            yield pa.record_batch([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


def _and_last(batches):
    yield from batches
    yield None


def fine_bins(batches):
    """Task function: node, size and FINE_BINS bins of each set; enough to tell long texts apart."""
    import pyarrow as pa

    for batch in batches:
        for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(1)]
            size = np.array([len(x) for x in sets], np.int64)
            bins = bins_of(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), len(sets), FINE_BINS)
            columns = [part.column(0), pa.array(size), pa.array([b.tobytes() for b in bins], pa.binary())]
            yield pa.record_batch(columns, names=["node", "size", "bins"])


def linked(num: int, den: int):
    """Task function: pairs a, b with whether den * intersection >= num * union of their sets."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                good.append(den * shared >= num * (len(both) - shared))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "linked"])

    return run


class JaccardJoin:
    """Classes of documents whose shingle sets are linked at ``num / den`` or more.

    ``docs`` needs doc_id and text; other columns are ignored.  NULL, empty and blank texts have the empty
    set and no links.  Rows with equal sets are one class and count as linked; rows that share a doc_id stay rows.
    """

    def __init__(self, docs: DataFrame, width: int = 3, num: int = 90, den: int = 100):
        self.docs = docs.select("doc_id", "text")
        self.width, self.num, self.den = width, num, den

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id (smallest doc_id reachable) of every row."""
        facts = self.docs.mapInArrow(facts_of(self.width), "doc_id long, n_shingles long, node long, mark long, bins binary")
        facts = written(facts, "facts")
        classes = facts.where("node IS NOT NULL").groupBy("node")
        classes = written(classes.agg(F.min("doc_id").alias("first_doc"), F.min("mark").alias("low"), F.max("mark").alias("high"), F.first("n_shingles").alias("size"), F.first("bins").alias("bins")), "classes")
        if not classes.where("low <> high").isEmpty():
            raise RuntimeError("two different sets share a 64-bit name: change NODE_SALT")
        roots = self.roots(classes)
        named = classes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first_doc")
        least = written(named.groupBy("root").agg(F.min("first_doc").alias("least_doc")), "least")
        named = written(named.join(least, "root").select("node", "least_doc"), "named")
        out = facts.join(named, "node", "left")
        own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least_doc"))
        return out.select("doc_id", "n_shingles", own.alias("component_id"))

    def roots(self, classes: DataFrame) -> DataFrame:
        """node, root of every class that is linked with another one."""
        spark = self.docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        task = signed(self.width, self.num, self.den)
        rows = self.docs.select("text").mapInArrow(task, "sig long, node long, meta long").repartition(parts, "sig")
        rows = rows.sortWithinPartitions("sig", F.shiftright("meta", 8), "node")
        stars = rows.mapInArrow(starred, "sig long, node long, meta long, pivot long, pivot_meta long")
        stars = written(stars.where("node <> pivot"), "stars")
        pairs = self.possible(stars.selectExpr("pivot a", "pivot_meta a_meta", "node b", "meta b_meta"))
        done = written(self.verified(pairs, classes).where("linked").select("a", "b"), "links")
        tied = stars.select("sig", "node", "meta", "pivot").join(done.selectExpr("a pivot", "b node", "a top"), ["pivot", "node"], "left")
        members = written(tied.select("sig", "node", "meta", F.coalesce("top", "node").alias("top")), "members")
        held = members.groupBy("sig").agg(F.count("*").alias("n"), F.min("top").alias("low"), F.max("top").alias("high"))
        held = written(held.where("low <> high").select("sig", F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("blocks")), "open")
        rows = members.join(held.select("sig"), "sig", "left_semi").join(classes.select("node", "bins"), "node").select("sig", "node", F.shiftright("meta", 8).alias("size"), "top", "bins")
        ties = self.ties(rows, held, BINS)
        more = self.across(components(ties, "a", "b"), done.groupBy("b").agg(F.min("a").alias("top")), classes)
        return components(done.unionByName(more), "a", "b")

    def across(self, clusters: DataFrame, tops: DataFrame, classes: DataFrame) -> DataFrame:
        """Links a, b between members of one cluster (sets tied by open buckets) that are not linked to the same first set.

        A cluster is dealt at random over blocks, bounded in members and in bytes, and every two blocks meet in one group
        that counts all their intersections: a large cluster becomes many groups, and only links come out.
        """
        clusters = clusters.withColumnRenamed("root", "cluster").join(tops.withColumnRenamed("b", "node"), "node", "left")
        clusters = written(clusters.select("node", "cluster", F.coalesce("top", "node").alias("root")), "clusters")
        sets = self.sets(clusters.select("node"), classes)
        blocks = self.blocks(clusters, sets)
        if (blocks.agg(F.sum(F.col("bytes") * F.col("blocks"))).first()[0] or 0) > REFINE_BYTES:
            rows = sets.mapInArrow(fine_bins, "node long, size long, bins binary").join(clusters, "node")
            rows = rows.select(F.col("cluster").alias("sig"), "node", "size", F.col("root").alias("top"), "bins")
            held = clusters.groupBy(F.col("cluster").alias("sig")).agg(F.ceil(F.count("*") / BUCKET_ROWS).cast("int").alias("blocks"))
            finer = components(self.ties(rows, written(held, "open"), FINE_BINS), "a", "b").withColumnRenamed("root", "cluster")
            clusters = written(finer.join(clusters.select("node", "root"), "node").select("node", "cluster", "root"), "clusters")
            blocks = self.blocks(clusters, sets)
        near = sets.join(clusters, "node")
        dealt = near.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "shingles")
        return written(dealt.groupBy("cluster", "i", "j").applyInArrow(crossed(self.num, self.den), "a long, b long"), "crossed")

    def blocks(self, clusters: DataFrame, sets: DataFrame) -> DataFrame:
        """Bytes and number of blocks of each cluster."""
        size = clusters.join(sets.select("node", F.octet_length("shingles").cast("long").alias("bytes")), "node").groupBy("cluster")
        count = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int")
        return written(size.agg(F.sum("bytes").alias("bytes"), count.alias("blocks")), "blocks")

    def ties(self, rows: DataFrame, held: DataFrame, width: int) -> DataFrame:
        """Ties a, b of rows (sig, node, size, top, bins) whose sig is held; large groups meet in pairs of blocks."""
        rows = rows.join(held.select("sig", "blocks"), "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        block = (F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        rows = rows.select("sig", *block, "own", "node", "size", "top", "bins")
        rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "own", "node")
        return written(rows.mapInArrow(alike(self.num, self.den, width), "a long, b long"), "ties")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs of an index entry a and a larger probe b whose sizes allow a link."""
        a, b = F.shiftright("a_meta", 8), F.shiftright("b_meta", 8)
        roles = (F.col("a_meta").bitwiseAND(INDEX) > 0) & (F.col("b_meta").bitwiseAND(PROBE) > 0)
        order = (a < b) | ((a == b) & (F.col("a") < F.col("b")))
        return pairs.where(roles & order & (a * self.den >= b * self.num)).select("a", "b").distinct()

    def verified(self, pairs: DataFrame, classes: DataFrame) -> DataFrame:
        """a, b, linked of candidate pairs, by their whole sets; pairs whose bins rule a link out are left away."""
        one = written(pairs, "pairs").join(classes.selectExpr("node a", "size a_size", "bins a_bins"), "a")
        both = one.join(classes.selectExpr("node b", "size b_size", "bins b_bins"), "b")
        both = both.select("a", "b", "a_size", "b_size", "a_bins", "b_bins")
        pairs = written(both.mapInArrow(screened(self.num, self.den), "a long, b long"), "pairs")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        sets = self.sets(ends.distinct(), classes)
        left = sets.withColumnsRenamed({"node": "a", "shingles": "x"})
        right = sets.withColumnsRenamed({"node": "b", "shingles": "y"})
        full = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
        return full.mapInArrow(linked(self.num, self.den), "a long, b long, linked boolean")

    def sets(self, nodes: DataFrame, classes: DataFrame) -> DataFrame:
        """node and its sorted shingles as bytes; the texts of these nodes are read again, those of no others."""
        nodes = written(nodes, "nodes")
        n = nodes.count()
        nothing = F.lit(-(1 << 63))
        wanted = classes.join(if_small(nodes, n, BROADCAST_ROWS), "node", "left_semi")
        wanted = wanted.select(F.coalesce("first_doc", nothing).alias("key")).distinct()
        texts = self.docs.select(F.coalesce("doc_id", nothing).alias("key"), "text")
        texts = texts.join(if_small(wanted, n, BROADCAST_ROWS), "key", "left_semi")
        sets = texts.select("text").mapInArrow(sets_of(self.width), "node long, shingles binary")
        sets = sets.join(if_small(nodes, n, BROADCAST_ROWS), "node", "left_semi")
        return written(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
