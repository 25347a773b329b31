"""Documents and terms of text risk as arrays: a sparse matrix whose rows are dealt over blocks, its columns over parts.

A block holds the term counts of its documents, a part its terms with idf and one row of numbers per vector.  Both stay where
they are, in memory and on disk; a pass sends a block the values of the terms that it holds, or a part the sums of a block,
without names or ids, as both sides keep them in the same order.  The driver sees inner products and losses only.

Executors need numpy and pyarrow, not this package: functions are shipped by value.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = "block int, piece binary"
PIECE_ROWS = 1 << 18  # entries or terms of a piece, at most, about
CUT = 10  # passes after which lineage is cut


def written(columns: dict) -> bytes:
    """Arrow columns of any lengths as bytes."""
    import pyarrow as pa

    lists = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for k, v in columns.items()}
    batch, sink = pa.RecordBatch.from_pydict(lists), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read(piece: bytes) -> dict:
    import pyarrow as pa

    batch = pa.ipc.open_stream(piece).read_next_batch()
    return {k: batch.column(k).flatten() for k in batch.schema.names}


def pieces(stop: Sequence[str]) -> Callable:
    """Rows (block, unknown, labels, words), one for a document's key, as term counts of some documents each (PIECE).

    A document is a row for each of its labels.  Words of unknown documents, those without a key, count for idf only.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for table in map(lambda b: pa.Table.from_batches([b]), batches):
            for block in pc.unique(table["block"]).to_pylist():
                rows = table.filter(pc.equal(table["block"], block)).combine_chunks().to_batches()[0]
                words, labels, unknown = rows["words"], rows["labels"], rows["unknown"].to_numpy(zero_copy_only=False)
                coded = words.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy())
                width = max(1, len(coded.dictionary))
                both, tf = np.unique(row * width + coded.indices.to_numpy().astype("i8"), return_counts=True)
                row, code = both // width, both % width
                kept = ~pc.is_in(coded.dictionary, value_set=pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)
                new = np.cumsum(kept) - 1
                row, code, tf = (v[kept[code]] for v in (row, new[code], tf)) if len(code) else (row, code, tf)
                seen = np.bincount(code, minlength=int(kept.sum()))
                row, code, tf = (v[~unknown[row]] for v in (row, code, tf))
                sizes = np.bincount(row, minlength=len(words))
                copies = labels.value_lengths().to_numpy()
                doc = np.repeat(np.arange(len(words)), copies)
                lengths = sizes[doc]
                take = np.repeat((np.cumsum(sizes) - sizes)[doc] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                y = labels.flatten().field("y")
                found = {"y": y.fill_null(0.0), "labelled": y.is_valid(), "lengths": lengths.astype("i4"), "codes": code[take].astype("i4"), "tf": tf[take].astype("i4"), "terms": coded.dictionary.filter(pa.array(kept)), "seen": seen}
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "piece": pa.array([written(found)], pa.binary())})

    return run


def gathered(items: Iterator) -> list[tuple[int, dict[str, list]]]:
    """What a task holds of each key, by kind; messages in the order of their senders."""
    out: dict[int, dict[str, list]] = {}
    for key, (kind, value) in items:
        out.setdefault(key, {}).setdefault(kind, []).append(value)
    for held in out.values():
        held.get("sent", []).sort(key=lambda m: m[0])
    return sorted(out.items())


def smallest(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def assembled(parts: int) -> Callable:
    """The pieces of a block as one: labels, row lengths, columns, counts, where each part begins; and its terms, in that order."""

    def run(items):
        import pyarrow as pa
        import pyarrow.compute as pc

        for block, held in gathered(items):
            found = [read(p) for p in held["piece"]]
            terms = pc.unique(pa.chunked_array([f["terms"] for f in found], pa.string()))
            part = np.array([zlib.crc32(t) % parts for t in terms.cast(pa.binary()).to_pylist()], "i8")
            order = np.argsort(part, kind="stable")
            place = np.empty(len(terms), "i4")
            place[order] = np.arange(len(terms), dtype="i4")
            seen, columns = np.zeros(len(terms), "i8"), []
            for f in found:
                at = place[pc.index_in(f["terms"], value_set=terms).to_numpy()]
                seen[at] += f["seen"].to_numpy()
                columns.append(at[f["codes"].to_numpy()])
            y, labelled, lengths, tf = (np.concatenate([f[k].to_numpy(zero_copy_only=False) for f in found]) for k in ("y", "labelled", "lengths", "tf"))
            begins = np.searchsorted(part[order], np.arange(parts + 1))
            yield block, ("counted", (y, labelled, lengths, np.concatenate(columns), smallest(tf), begins, terms.take(pa.array(order)), seen))

    return run


def totals(items: Iterator) -> Iterator:
    """Documents, labelled ones, and the sum of 1/2 less the label."""
    for block, held in gathered(items):
        y, labelled = held["counted"][0][:2]
        yield block, (len(y), int(labelled.sum()), float((0.5 - y[labelled]).sum()))


def by_part(block: int, values: np.ndarray, begins: np.ndarray) -> Iterator:
    for part in np.flatnonzero(np.diff(begins)):
        yield int(part), ("sent", (block, values[begins[part] : begins[part + 1]]))


def wishes(items: Iterator) -> Iterator:
    """The terms of each block, and in how many of its documents they are, sent to their parts."""
    for block, held in gathered(items):
        *_, begins, terms, seen = held["counted"][0]
        for part in np.flatnonzero(np.diff(begins)):
            some = slice(begins[part], begins[part + 1])
            yield int(part), ("sent", (block, written({"terms": terms[some], "seen": seen[some]})))


def indexed(n: int) -> Callable:
    """The terms of a part in order, their idf = ln((1 + n) / (1 + documents with the term)) + 1, and where those of each block are among them."""

    def run(items):
        import pyarrow as pa
        import pyarrow.compute as pc

        for part, held in gathered(items):
            asked = [(block, read(piece)) for block, piece in held["sent"]]
            terms = pc.unique(pa.chunked_array([some["terms"] for _, some in asked], pa.string()))
            terms = terms.take(pc.sort_indices(terms))
            places, seen = [], np.zeros(len(terms), "i8")
            for block, some in asked:
                at = pc.index_in(some["terms"], value_set=terms).to_numpy().astype("i4")
                seen[at] += some["seen"].to_numpy()
                places.append((block, at))
            yield part, ("named", (terms, np.log((1.0 + n) / (1.0 + seen)) + 1, places))

    return run


def places(items: Iterator) -> Iterator:
    for part, (_, (terms, _, at)) in items:
        yield part, ("index", (len(terms), at))


def frequencies(items: Iterator) -> Iterator:
    for part, (_, (_, idf, at)) in items:
        yield from ((block, ("sent", (part, idf[some]))) for block, some in at)


def merged(held: dict, begins: np.ndarray) -> np.ndarray:
    """What the parts have sent, in the order of the block's terms."""
    out = np.zeros(begins[-1])
    for part, values in held.get("sent", ()):
        out[begins[part] : begins[part + 1]] = values
    return out


def scaled(items: Iterator) -> Iterator:
    """Blocks with the idf of their terms and the lengths of their documents; an entry is x = tf x idf / norm."""
    for block, held in gathered(items):
        y, labelled, lengths, columns, tf, begins, _, _ = held["counted"][0]
        idf = merged(held, begins)
        norm = np.sqrt(row_sums(lengths, (tf * idf[columns]) ** 2))
        yield block, ("rows", (y, labelled, lengths, columns, tf, begins, idf, np.where(norm > 0, norm, 1.0)))


def row_sums(lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    out, full = np.zeros(len(lengths)), np.flatnonzero(lengths)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(lengths, dtype="i8") - lengths)[full])
    return out


def chances(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z))


def margins(held: dict, length: float) -> np.ndarray:
    """The documents' margins after a step of this length."""
    if "margins" not in held:
        return np.zeros(len(held["rows"][0][0]))
    z, dz, _ = held["margins"][0]
    return z + length * dz


def slopes(length: float) -> Callable:
    """Each block's sums of x times error by term, sent to their parts."""

    def run(items):
        for block, held in gathered(items):
            y, labelled, lengths, columns, tf, begins, idf, norm = held["rows"][0]
            errors = np.where(labelled, chances(margins(held, length)) - y, 0.0)
            yield from by_part(block, idf * np.bincount(columns, tf * np.repeat(errors / norm, lengths), len(idf)), begins)

    return run


def moved(share: np.ndarray | None, length: float, c: float, memory: int) -> Callable:
    """The vectors s.., y.., g and w of each part: at the start, or after a step along the direction of these coefficients."""

    def run(items):
        for part, held in gathered(items):
            size, found = held["index"][0]
            slope, at = np.zeros(size), dict(found)
            for block, values in held["sent"]:
                slope[at[block]] += values
            if share is None:
                yield part, ("vectors", np.array([slope, np.zeros(size)]))
                continue
            old = held["vectors"][0]
            steps = len(old) // 2 - 1
            s, y, w = old[:steps], old[steps : 2 * steps], old[-1]
            move = length * (share @ old[:-1])
            g = slope + (w + move) / c
            first = max(0, steps + 1 - memory)
            yield part, ("vectors", np.array([*s[first:], move, *y[first:], g - old[-2], g, w + move]))

    return run


def products(items: Iterator) -> Iterator:
    for part, (_, vectors) in items:
        yield part, vectors @ vectors.T


def aimed(share: np.ndarray) -> Callable:
    """The direction of these coefficients, sent to the blocks that hold its terms."""

    def run(items):
        for part, held in gathered(items):
            if "vectors" in held:
                along = share @ held["vectors"][0][:-1]
                yield from ((block, ("sent", (part, along[at]))) for block, at in held["index"][0][1])

    return run


def ahead(length: float, free: float, lengths: np.ndarray) -> Callable:
    """Margins after the last step, what a unit of the new direction adds (``free`` by the intercept), and ``tried`` of both."""

    def run(items):
        for block, held in gathered(items):
            y, labelled, counts, columns, tf, begins, idf, norm = held["rows"][0]
            along = idf * merged(held, begins)
            z, dz = margins(held, length), row_sums(counts, tf * along[columns]) / norm + free
            yield block, ("margins", (z, dz, tried(y[labelled], z[labelled], dz[labelled], lengths)))

    return run


def tried(y: np.ndarray, z: np.ndarray, dz: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sums of losses and errors for each step length."""
    out = []
    for m in (z + a * dz for a in lengths):
        out.append(((np.maximum(m, 0) + np.log1p(np.exp(-np.abs(m))) - y * m).sum(), (chances(m) - y).sum()))
    return np.array(out)


def sums_tried(items: Iterator) -> Iterator:
    for block, (_, (_, _, sums)) in items:
        yield block, sums


def weights(share: np.ndarray | None, length: float) -> Callable:
    """Terms with idf and weight in pieces, after a last step if there is one."""

    def run(items):
        for _, held in gathered(items):
            vectors, (terms, idf, _) = held["vectors"][0], held["named"][0]
            w = vectors[-1] if share is None else vectors[-1] + length * (share @ vectors[:-1])
            for a in range(0, len(terms), PIECE_ROWS):
                rows = slice(a, a + PIECE_ROWS)
                yield (written({"term": terms[rows], "idf": idf[rows], "w": w[rows]}),)

    return run


def unpacked(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        for piece in batch.column(0).to_pylist():
            yield pa.RecordBatch.from_pydict(read(piece))


class TextMatrix:
    """The held blocks and parts, the vectors of the search over the parts and the margins over the blocks."""

    def __init__(self, documents: DataFrame, blocks: int, parts: int, stop: Sequence[str]):
        """``documents``: block, unknown (no key), labels (distinct structs of y) and words; one row for a key."""
        self.spark, self.n_blocks, self.n_parts = documents.sparkSession, blocks, parts
        self.passes, self.vectors, self.margins, self.old = 0, None, None, []
        found = documents.mapInArrow(pieces(list(stop)), PIECE).rdd.map(lambda r: (r[0], ("piece", bytes(r[1]))))
        dealt = self._dealt(found, blocks)
        counted = self._kept(dealt, assembled(parts))
        held = sorted(counted.mapPartitions(totals).collect())
        self.documents, self.labelled = (sum(v[i] for _, v in held) for i in range(2))
        self.level = sum(v[2] for _, v in held)
        asked = self._dealt(counted.mapPartitions(wishes), parts)
        self.named = self._kept(asked, indexed(self.documents))
        self.index = self._kept(self.named, places)
        sent = self._dealt(self.named.mapPartitions(frequencies), blocks)
        self.blocks = self._kept(self._joined(counted, sent), scaled)
        self.blocks.count(), self.index.count()
        for shuffled in (dealt, asked, sent):
            shuffled.cleanShuffleDependencies()
        counted.unpersist()

    def _dealt(self, items: RDD, n: int) -> RDD:
        """Items by key; read by the reader of the held sides, else a union would send both through another worker."""
        dealt = items.partitionBy(n, int)
        return RDD(dealt._jrdd, dealt.ctx, self.spark.sparkContext.serializer)

    def _kept(self, items: RDD, function: Callable) -> RDD:
        return items.mapPartitions(function, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)

    def _joined(self, *sides: RDD | None) -> RDD:
        """What several sides, dealt alike, hold of a key: in one task, without a shuffle."""
        first, *rest = (s for s in sides if s is not None)
        for side in rest:
            first = first.union(side)
        return first

    def _forget(self, rdd: RDD | None) -> None:
        if rdd is None:
            return
        rdd.unpersist()
        if rdd.isCheckpointed():  # written for its successors, which no longer need it
            sc = self.spark.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def gradient(self, share: np.ndarray | None, length: float, c: float, memory: int) -> np.ndarray:
        """Inner products of s.., y.., g and w, after the step along ``share`` (none at the start)."""
        sent = self._dealt(self._joined(self.blocks, self.margins).mapPartitions(slopes(length)), self.n_parts)
        before, self.vectors = self.vectors, self._kept(self._joined(self.index, self.vectors, sent), moved(share, length, c, memory))
        if self.passes % CUT == CUT - 1:
            self.vectors.checkpoint()
        found = dict(self.vectors.mapPartitions(products).collect())
        self._done(sent, before)
        return sum((found[part] for part in sorted(found)), np.zeros(()))

    def search(self, share: np.ndarray, free: float, length: float, lengths: np.ndarray) -> np.ndarray:
        """Sums of losses and errors at each of ``lengths`` along ``share``, from the margins after the last step."""
        sent = self._dealt(self._joined(self.index, self.vectors).mapPartitions(aimed(share)), self.n_blocks)
        before, self.margins = self.margins, self._kept(self._joined(self.blocks, self.margins, sent), ahead(length, free, lengths))
        if self.passes % CUT == CUT - 1:
            self.margins.checkpoint()
        found = dict(self.margins.mapPartitions(sums_tried).collect())
        self._done(sent, before)
        self.passes += 1
        return sum(found[block] for block in sorted(found))

    def _done(self, sent: RDD, before: RDD | None) -> None:
        """Lets go of messages and of the state before; what is written stays until both sides have been written again."""
        sent.cleanShuffleDependencies()
        if before is not None:
            before.unpersist()
            if before.isCheckpointed():
                self.old.append(before)
        if len(self.old) == 4:
            for rdd in self.old[:2]:
                self._forget(rdd)
            self.old = self.old[2:]

    def weights(self, share: np.ndarray | None, length: float) -> DataFrame:
        """term, idf, w; after a last step along ``share`` if there is one."""
        rows = self._joined(self.named, self.vectors).mapPartitions(weights(share, length))
        return self.spark.createDataFrame(rows, "piece binary", verifySchema=False).mapInArrow(unpacked, "term string, idf double, w double")

    def release(self) -> None:
        for rdd in (self.blocks, self.index, self.named, self.vectors, self.margins, *self.old):
            self._forget(rdd)
