"""Hard negatives by angular triangle filtering: exact, with integer scores.

Vectors become whole numbers, and a score is an inner product of whole numbers.  Every row stores its norm and its angles to a few
reference directions.  If a reference lies at angle s from an anchor and t from a row, the angle between the two is at least
|s - t| and at most s + t, so their cosine lies in [cos(s + t), cos(s - t)]; multiplied by both norms and widened by more than all
rounding, that bounds the score.  A pair is scored only if its bounds overlap a window in which the anchor still looks for rows.

Rows are sorted by their nearest reference and the angle to it (a range partitioning) and stored in blocks, whose ranges of
angles are tested first.  The blocks stay where they are; anchors come in rounds of bounded size past all of them.  Each task
keeps the best rows of every window of the round, and a window function merges the tasks.  A first pass of a round finds the
positives, whose scores are the windows of the second.  Windows start from the scores of a bounded sample of rows, so that
tasks hand on little; the result does not depend on it.

Defined results: rows whose id, label or vector is NULL, or that hold NULL or non-finite components, take no part, nor do rows
with a norm of 2**31 or more after scaling, whose scores no long could hold.  Vectors meet only those of their length.  Rows that share an id
are never each other's partners; otherwise repeated rows count each, and a repeated anchor is answered each time.  Ties go to the
smaller id.  A zero vector scores 0 with all.  Positives with a negative score have an empty window and give no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder, written

#: The bounded sample that reference directions and first thresholds come from, and the number of directions.
SAMPLE_ROWS, REFERENCES, STEPS = 4096, 8, 8
#: Rows and bytes of a block at most, rows of a range partition, bytes of a round's anchors about, anchors compared at a time.
BLOCK_ROWS, BLOCK_BYTES, PART_ROWS, ROUND_BYTES, CHUNK = 4096, 4 << 20, 1 << 18, 8 << 20, 256
MARGIN = 1e-6  # stored angles are exact to about 2e-7
EXACT = float(1 << 53)
DENSE = 0.1
LOWEST = -(1 << 63)
INDEX = "dim int, home int, rows int, kind string, ids binary, labels binary, vectors binary, norms binary, angles binary"
HITS = "anchor int, slot int, vec_id long, score long"


def whole_numbers(vectors: DataFrame, is_anchor: Column, scale: int) -> DataFrame:
    """vec_id, label, vector of whole numbers, dim, is_anchor, salt of the rows that take part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    scaled = F.transform("embedding", lambda x: F.floor(x * scale).cast("double"))
    size = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), is_anchor.alias("is_anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.where(F.forall("embedding", number)).where(F.forall("embedding", lambda x: F.abs(x) * scale < float(1 << 31)))
    rows = rows.where(size < float(1 << 62))
    vector = F.transform("embedding", lambda x: F.floor(x * scale)).alias("vector")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector, F.size("embedding").alias("dim"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))
    return written(rows.withColumn("salt", F.monotonically_increasing_id()), "whole")


def matrix(column, dim: int) -> np.ndarray:
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def by_length(rows: DataFrame):
    """Length, row numbers, ids, labels and vectors of a frame of bounded size, for each length."""
    import pyarrow as pa

    table = rows.select("dim", "vec_id", "label", "vector").toArrow()
    dims = np.asarray(table.column("dim"))
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        part = table.take(pa.array(at))
        yield dim, at, np.asarray(part.column("vec_id")), np.asarray(part.column("label")), matrix(part.column("vector"), dim)


def norms_of(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors.astype(float) ** 2).sum(1))


def angles_to(directions: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Angle of every vector (row) to every unit direction (column); 0 for the zero vector."""
    norms = np.maximum(norms_of(vectors), 1e-300)
    return np.arccos(np.clip(vectors.astype(float) @ directions.T / norms[:, None], -1, 1)) * (norms[:, None] > 1e-300)


def directions_of(vectors: np.ndarray, dim: int) -> np.ndarray:
    """Reference directions: centres of a few rounds of spherical clustering, from starts far apart."""
    norms = norms_of(vectors)
    unit = vectors[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.full((1, dim), 1 / np.sqrt(max(dim, 1)))
    chosen, near = [0], unit @ unit[0]
    while len(chosen) < min(REFERENCES, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(STEPS):
        own = (unit @ centres.T).argmax(1)
        for k in range(len(centres)):
            total = unit[own == k].sum(0)
            size = np.linalg.norm(total)
            if size > 1e-9:
                centres[k] = total / size
    return centres


@dataclass
class Sample:
    """Bounded sample of rows by vector length, and the reference directions of each length."""

    ids: dict = field(default_factory=dict)
    labels: dict = field(default_factory=dict)
    vectors: dict = field(default_factory=dict)
    directions: dict = field(default_factory=dict)

    @classmethod
    def draw(cls, rows: DataFrame, total: int) -> Sample:
        """Rows that a hash puts first, copies once."""
        place = F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(1 << 40))
        share = min(1.0, 2 * SAMPLE_ROWS / max(1, total)) * float(1 << 40)
        picked = rows.withColumn("place", place).where(F.col("place") <= share).select("place", "dim", "vec_id", "label", "vector").distinct()
        out = cls()
        for dim, _, ids, labels, found in by_length(picked.orderBy("place").limit(SAMPLE_ROWS)):
            out.ids[dim], out.labels[dim], out.vectors[dim] = ids, labels, found
            out.directions[dim] = directions_of(found, dim)
        return out

    def toward(self, dim: int) -> np.ndarray:
        """Directions for vectors of this length; a length that is not in the sample has the diagonal."""
        return self.directions[dim] if dim in self.directions else directions_of(np.zeros((0, dim)), dim)


def build_index(rows: DataFrame, total: int, sample: Sample) -> DataFrame:
    """The written index: rows sorted by (length, nearest direction, angle to it) in blocks with norms and angles."""
    import pyarrow as pa

    spark = rows.sparkSession
    directions = sample.directions
    toward = lambda dim: directions[dim] if dim in directions else directions_of(np.zeros((0, dim)), dim)

    def placed(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            dims = np.asarray(table.column("dim"))
            for dim in np.unique(dims):
                part = table.filter(pa.array(dims == dim))
                angles = angles_to(toward(int(dim)), matrix(part.column("vector"), int(dim)))
                home = angles.argmin(1)
                angle = angles[np.arange(len(home)), home]
                part = part.append_column("home", pa.array(home, pa.int32())).append_column("angle", pa.array(angle))
                yield from part.to_batches()

    def blocks(batches):
        kept = size = 0
        parts: list = []
        key = None

        def block():
            dim, home = key
            table = pa.Table.from_batches(parts)
            vectors = matrix(table.column("vector"), dim)
            most = int(np.abs(vectors).max(initial=0))
            kind = next(k for k, bound in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if most < bound)
            columns = [np.asarray(table.column(c), np.int64).tobytes() for c in ("vec_id", "label")]
            columns += [vectors.astype(kind).tobytes(), norms_of(vectors).tobytes(), angles_to(toward(dim), vectors).astype(np.float32).tobytes()]
            heads = [pa.array([dim], pa.int32()), pa.array([home], pa.int32()), pa.array([len(vectors)], pa.int32()), pa.array([kind])]
            names = [c.split()[0] for c in INDEX.split(", ")]
            return pa.record_batch([*heads, *(pa.array([c], pa.binary()) for c in columns)], names=names)

        for batch in batches:
            pairs = np.column_stack((np.asarray(batch.column("dim")), np.asarray(batch.column("home"))))
            edges = np.flatnonzero((pairs[1:] != pairs[:-1]).any(1)) + 1
            for start, stop in zip([0, *edges], [*edges, len(pairs)], strict=True):
                if start == stop:
                    continue
                now = (int(pairs[start][0]), int(pairs[start][1]))
                if parts and now != key:
                    yield block()
                    parts, kept = [], 0
                key = now
                size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, now[0]))))
                while start < stop:
                    take = min(stop - start, size - kept)
                    parts.append(batch.slice(start, take))
                    kept, start = kept + take, start + take
                    if kept == size:
                        yield block()
                        parts, kept = [], 0
        if parts:
            yield block()

    shape = "dim int, vec_id long, label long, vector array<long>, salt long, home int, angle double"
    found = rows.select("dim", "vec_id", "label", "vector", "salt").mapInArrow(placed, shape)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_ROWS))
    by = ["dim", "home", "angle", "salt"]
    dealt = found.repartitionByRange(n_parts, *by).sortWithinPartitions(*by).drop("salt")
    return written(dealt.mapInArrow(blocks, INDEX), "angles")


@dataclass
class Block:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    angles: np.ndarray
    home: int


@dataclass
class Anchors:
    """Anchors of one length with windows [low, high] of scores, in each of which the best ``k`` rows are wanted."""

    numbers: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    directions: np.ndarray
    k: int
    same: bool  # rows of the anchor's label, else of the other ones
    low: np.ndarray  # (anchor, slot); a slot with low > high is closed
    high: np.ndarray
    pairs: int = 0
    scored: int = 0

    def __post_init__(self):
        self.norms = norms_of(self.vectors)
        self.angles = angles_to(self.directions, self.vectors)
        self.home = self.angles.argmin(1)
        n, slots = self.low.shape
        self.score = np.full((n * slots, self.k), LOWEST, np.int64)
        self.found = np.zeros((n * slots, self.k), np.int64)

    def needed(self) -> np.ndarray:
        """Smallest score that still counts, by anchor and slot: the window's low end or the k-th best so far."""
        return np.maximum(self.low, self.score[:, -1].reshape(self.low.shape) if self.k else self.low)

    def bounds(self, at: np.ndarray, block: Block, rows: slice | np.ndarray, references) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of some anchors with rows of a block."""
        low = high = None
        size = block.norms[rows]
        for r in references:
            s, t = self.angles[at, r], block.angles[rows, r]
            along = np.multiply.outer(self.norms[at] * np.cos(s), size * np.cos(t))
            across = np.multiply.outer(self.norms[at] * np.sin(s), size * np.sin(t))
            high = along + across if high is None else np.minimum(high, along + across)
            low = along - across if low is None else np.maximum(low, along - across)
        slack = (MARGIN * self.norms[at] * size.max(initial=0) + 1)[:, None]
        return low - slack, high + slack

    def reach(self, at: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of anchors with any row of a block, from its ranges of angles."""
        least, most = block.angles.min(0), block.angles.max(0)
        own = self.angles[at]
        apart = np.maximum(np.maximum(own - most, least - own), 0).max(1)
        wide = np.where(own + most <= np.pi, own + most, np.minimum(2 * np.pi - (own + least), np.pi)).min(1)
        small, large = block.norms.min(), block.norms.max()
        up, down = np.cos(apart), np.cos(wide)
        slack = MARGIN * self.norms[at] * large + 1
        return self.norms[at] * np.where(down < 0, large, small) * down - slack, self.norms[at] * np.where(up > 0, large, small) * up + slack

    def scores(self, at: np.ndarray, block: Block, mask: np.ndarray, least: np.ndarray):
        """Pairs (anchor, row) of the mask and their exact scores, from the anchor's least one that still counts.

        A rectangle that is wanted to a fair part is multiplied whole, which is faster than pair by pair.
        """
        rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        exact = self.norms[at].max() * block.norms.max() < EXACT
        kind = np.float64 if exact else np.int64
        left, right = self.vectors[at[rows]].astype(kind), block.vectors[columns].astype(kind)
        wanted = mask[np.ix_(rows, columns)]
        if mask.sum() >= DENSE * wanted.size:
            score = left @ right.T
            i, j = np.nonzero(wanted & (score >= least[rows, None]))
            return at[rows[i]], columns[j], score[i, j].astype(np.int64)
        i, j = np.nonzero(wanted)
        return at[rows[i]], columns[j], np.einsum("ij,ij->i", left[i], right[j]).astype(np.int64)

    def offer(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        """Merge rows into the best ones of their slots."""
        if not len(slot):
            return
        touched = np.unique(slot)
        old = self.score[touched] > LOWEST
        slots = np.concatenate((np.repeat(touched, old.sum(1)), slot))
        scores = np.concatenate((self.score[touched][old], scores))
        ids = np.concatenate((self.found[touched][old], ids))
        order = np.lexsort((ids, ~scores, slots))  # ~x falls as x rises, and no whole number overflows
        slots, scores, ids = slots[order], scores[order], ids[order]
        first = np.concatenate(([True], slots[1:] != slots[:-1]))
        rank = np.arange(len(slots)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = rank < self.k
        self.score[touched], self.found[touched] = LOWEST, 0
        self.score[slots[kept], rank[kept]] = scores[kept]
        self.found[slots[kept], rank[kept]] = ids[kept]

    def meet(self, block: Block):
        """Look through one block for rows inside the anchors' windows."""
        if not len(self.ids) or not len(block.ids) or not self.low.shape[1]:
            return
        everyone = np.arange(len(self.ids))
        self.pairs += len(everyone) * len(block.ids)
        open_ = self.low <= self.high
        low, high = self.reach(everyone, block)
        needed = self.needed()
        live = (open_ & (high[:, None] >= needed) & (low[:, None] <= self.high)).any(1)
        for home in np.unique(self.home[live]):
            group = everyone[live & (self.home == home)]
            for start in range(0, len(group), CHUNK):
                self.compare(group[start : start + CHUNK], block, {int(home), block.home})

    def compare(self, at: np.ndarray, block: Block, references: set):
        alike = self.labels[at][:, None] == block.labels
        mask = (alike if self.same else ~alike) & (self.ids[at][:, None] != block.ids)
        low, high = self.bounds(at, block, slice(None), references)
        needed, top = self.needed()[at], self.high[at]
        overlap = np.zeros_like(mask)
        for slot in range(needed.shape[1]):
            some = needed[:, slot] <= top[:, slot]
            overlap[some] |= (high[some] >= needed[some, slot, None]) & (low[some] <= top[some, slot, None])
        mask &= overlap
        if not mask.any():
            return
        self.scored += int(mask.sum())
        least = np.where(needed <= top, needed, -(LOWEST + 1)).min(1)
        anchor, row, score = self.scores(at, block, mask, least)
        needed = self.needed()
        slots = self.low.shape[1]
        for slot in range(slots):
            fits = (score >= needed[anchor, slot]) & (score <= self.high[anchor, slot])
            self.offer(anchor[fits] * slots + slot, block.ids[row[fits]], score[fits])

    def hits(self):
        """Number of the anchor, slot, row and score of all rows kept."""
        at, rank = np.nonzero(self.score > LOWEST)
        slots = self.low.shape[1]
        return self.numbers[at // max(slots, 1)], at % max(slots, 1), self.found[at, rank], self.score[at, rank]


def block_at(batch, r: int) -> tuple[int, Block]:
    row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
    dim, n = row["dim"].as_py(), row["rows"].as_py()
    read = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind)
    vectors = read("vectors", row["kind"].as_py()).reshape(n, dim)
    return dim, Block(read("ids", np.int64), read("labels", np.int64), vectors, read("norms", float), read("angles", np.float32).astype(float).reshape(n, -1), row["home"].as_py())


def searched(index: DataFrame, anchors: dict[int, Anchors], k: int) -> DataFrame:
    """anchor, slot, rank, vec_id, score of the best ``k`` rows of every window."""
    import pyarrow as pa

    def run(batches):
        groups = anchors  # a copy of the task's own
        for batch in batches:
            for r in range(batch.num_rows):
                dim, block = block_at(batch, r)
                if dim in groups:
                    groups[dim].meet(block)
        for a in groups.values():
            columns = zip(a.hits(), (pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)
            yield pa.record_batch([pa.array(x, t) for x, t in columns], names=[c.split()[0] for c in HITS.split(", ")])

    hits = index.where(F.col("dim").isin(sorted(anchors))).mapInArrow(run, HITS)
    rank = F.expr("row_number() OVER (PARTITION BY anchor, slot ORDER BY score DESC, vec_id)").alias("rank")
    return hits.select("anchor", "slot", rank, "vec_id", "score").where(F.col("rank") <= k)


def seeded(anchors: Anchors, sample: Sample, dim: int) -> Anchors:
    """Windows whose low end is the k-th best score among the sample's rows: at least ``k`` rows reach it."""
    if dim in sample.ids:
        norms = norms_of(sample.vectors[dim])
        trial = Anchors(**{f: getattr(anchors, f) for f in ("numbers", "ids", "labels", "vectors", "directions", "k", "same", "low", "high")})
        trial.meet(Block(sample.ids[dim], sample.labels[dim], sample.vectors[dim], norms, angles_to(sample.toward(dim), sample.vectors[dim]), 0))
        anchors.low = trial.needed()
    return anchors


def positive_windows(round_: dict, sample: Sample, k: int) -> dict[int, Anchors]:
    out = {}
    for dim, (numbers, ids, labels, vectors) in round_.items():
        low, high = np.full((len(ids), 1), LOWEST + 1, np.int64), np.full((len(ids), 1), -(LOWEST + 1), np.int64)
        out[dim] = seeded(Anchors(numbers, ids, labels, vectors, sample.toward(dim), k, True, low, high), sample, dim)
    return out


def negative_windows(round_: dict, positives: dict, sample: Sample, n_positives: int, k: int, share: tuple[int, int]) -> dict[int, Anchors]:
    """One window per positive: from ``share`` of its score, rounded up, to its score."""
    out = {}
    for dim, (numbers, ids, labels, vectors) in round_.items():
        low, high = np.ones((len(ids), n_positives), np.int64), np.zeros((len(ids), n_positives), np.int64)
        for i, number in enumerate(numbers):
            for slot, (_, score) in positives.get(int(number), {}).items():
                if score >= 0:
                    low[i, slot], high[i, slot] = -(-score * share[0] // share[1]), score
        out[dim] = seeded(Anchors(numbers, ids, labels, vectors, sample.toward(dim), k, False, low, high), sample, dim)
    return out


def gathered(anchors: DataFrame) -> dict:
    """The anchors of one round by vector length: numbers, ids, labels, vectors."""
    return {dim: (numbers, ids, labels, found) for dim, numbers, ids, labels, found in by_length(anchors)}


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, k: int = 5, share: tuple[int, int] = (80, 100), scale: int = 256, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` needs vec_id, embedding and label; ``is_anchor`` marks the rows to answer.  Positives are the ``n_positives`` rows of
    the anchor's label with the largest scores; for each, the ``k`` best rows of other labels whose score is at most the positive's and at
    least ``share`` of it.  Components are scaled and rounded down to whole numbers first.
    """
    spark = vectors.sparkSession
    rows = whole_numbers(vectors, is_anchor, scale)
    total = rows.count()
    sample = Sample.draw(rows, total)
    index = build_index(rows, total, sample)
    anchors = rows.where("is_anchor").select("vec_id", "label", "dim", "vector", "salt")
    size = anchors.agg(F.sum(F.col("dim").cast("long") * 8 + 64)).first()[0] or 0
    rounds = -(-size // round_bytes)
    result = fresh_folder(spark, "negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(result)
    for number in range(rounds):
        part = gathered(anchors.where(F.pmod(F.xxhash64("salt"), F.lit(rounds)) == number))
        if not part:
            continue
        positives: dict = {}
        for r in searched(index, positive_windows(part, sample, n_positives), n_positives).collect():
            positives.setdefault(r.anchor, {})[r["rank"] - 1] = (r.vec_id, r.score)
        pairs = [(a, slot, int(anchor_id), p, s) for _, (numbers, ids, _, _) in part.items() for a, anchor_id in zip(numbers.tolist(), ids.tolist(), strict=True) for slot, (p, s) in positives.get(a, {}).items()]
        if not pairs:
            continue
        named = spark.createDataFrame(pairs, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        found = searched(index, negative_windows(part, positives, sample, n_positives, k, share), k)
        joined = found.join(F.broadcast(named), ["anchor", "slot"])  # a round's pairs are bounded by round_bytes
        final = joined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        final.write.mode("append").parquet(result)
    return spark.read.schema(schema).parquet(result)
