"""Best-fit packing of tokenised documents into training sequences with three capacities."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .encode import encoder

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and how much each residual counts when bins are compared.

    ``attention`` bounds the sum of squared lengths (documents attend to themselves only).  None: what
    ``tokens`` implies.  The weights apply to residuals as shares of their capacity.
    """

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.02, 0.02)
    rule: str = "norm"  # or "dot"

    def longest(self) -> int:
        """Tokens of the longest piece that fits an empty sequence."""
        return self.tokens if self.attention is None else min(self.tokens, math.isqrt(self.attention))

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], float)


def pack(length: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and order number of each item.  Items go longest first to the fitting bin that is best by
    residual norm (smallest left over) or by weighted dot product of item and residual (largest)."""
    limit = capacity.vector()
    weight = np.array(capacity.weights)
    n = len(length)
    where, place = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.empty((3, max(n, 1)))
    name = np.empty(max(n, 1), np.int64)
    used, opened = 0, 0
    order = np.argsort(-length, kind="stable")
    smallest = length.min(initial=0) / limit[0]
    held = np.zeros(max(n, 1), np.int64)
    tiny = 1e-9
    for i in order:
        item = np.array([length[i], 1.0, float(length[i]) ** 2]) / limit
        now = left[:, :used]
        rest = now - item[:, None]
        fits = (rest >= -tiny).all(0)
        at = -1
        if fits.any():
            if capacity.rule == "dot":
                score = np.where(fits, (weight * item) @ now, -1.0)
                at = int(score.argmax())
            else:
                score = np.where(fits, weight @ (rest * rest), np.inf)
                at = int(score.argmin())
        if at < 0:
            if (item > 1 + tiny).any():
                raise ValueError(f"an item of {length[i]} tokens fits no sequence")
            if used == left.shape[1]:
                left = np.concatenate((left, np.empty_like(left)), 1)
                name = np.concatenate((name, np.empty_like(name)))
            at, used = used, used + 1
            left[:, at] = 1.0
            name[at] = opened
            opened += 1
        left[:, at] -= item
        where[i], place[i] = name[at], held[name[at]]
        held[name[at]] += 1
        if left[0, at] < smallest - tiny or left[1, at] < 1 / limit[1] - tiny:  # full: the last bin takes its row
            used -= 1
            left[:, at], name[at] = left[:, used], name[used]
    return where, place


def pieces_of(path: str, tokens: int, separator: int, with_ids: bool):
    """Task function: the pieces of each document, cut at ``tokens`` ids, the separator included."""
    import pyarrow as pa

    end = int(separator).to_bytes(4, "little")

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            rows: list[tuple] = []
            for k, (doc, text) in enumerate(zip(docs, texts, strict=True)):
                ids = encode.ids(text.as_py() or b"") + end
                for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                    part = ids[at : at + 4 * tokens]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                if len(rows) > 5000 or k == len(docs) - 1:
                    columns = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                    yield pa.record_batch(arrays[: 5 + with_ids], names=names[: 5 + with_ids])
                    rows = []

    return run


def packed_bucket(capacity: Capacity):
    """Task function: sequence and offset of each piece of one bucket."""
    import pyarrow as pa

    def run(table):
        length = np.asarray(table.column("length"), np.int64)
        rid = np.asarray(table.column("rid"), np.int64)
        by_id = np.argsort(rid)  # the same result in whatever order rows arrive
        table, length, rid = table.take(pa.array(by_id)), length[by_id], rid[by_id]
        where, place = pack(length, capacity)
        order = np.lexsort((place, where))
        before = np.cumsum(length[order]) - length[order]
        new = np.ones(len(order), bool)
        new[1:] = where[order][1:] != where[order][:-1]
        offset = np.empty(len(order), np.int64)
        offset[order] = before - np.repeat(before[new], np.diff(np.append(np.flatnonzero(new), len(order))))
        bucket = np.asarray(table.column("bucket"), np.int64)
        sequence = ((bucket << 24) | where) << 1
        table = table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return table.drop_columns(["bucket", "rid"])

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: Capacity | None = None,
    separator: int = 0,
    bucket_pieces: int = 4096,
    with_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its place: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are ignored.  A document is its ids and one separator, so NULL, empty
    and blank texts are the separator alone; each row is packed, repeated ones too.  Documents beyond the token
    capacity, or beyond the length whose square the attention capacity holds, are cut into full pieces and a last one.
    Pieces that fill the token capacity are sequences of their own; the others are dealt at
    random over buckets of about ``bucket_pieces`` (a hash of the row, so that no key can be hot) and packed
    there.  A bucket leaves a few bins partly empty, far below one in a hundred.
    """
    capacity = capacity or Capacity()
    longest = capacity.longest()
    if longest < 1:
        raise ValueError("the capacities hold no token")
    schema = PIECE + (", ids binary" if with_ids else "")
    pieces = docs.select("doc_id", "text").mapInArrow(pieces_of(tokenizer, longest, separator, with_ids), schema)
    pieces = written(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in pieces.columns if c != "rid"]
    short = F.col("length") < capacity.tokens
    n = pieces.where(short).count()
    buckets = max(1, round(n / bucket_pieces))
    dealt = pieces.where(short).withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    out = schema + ", sequence_id long, offset long"
    packed = dealt.groupBy("bucket").applyInArrow(packed_bucket(capacity), out)
    alone = pieces.where(~short).select(*columns, (F.col("rid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)
