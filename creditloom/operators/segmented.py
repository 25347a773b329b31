"""Ordered groups of any size cut into pieces, so that a running value is scanned on three levels.

A window over a group (an account's day, a borrower's slot) puts the group into one task.  Groups that hold more than
their share of all rows are cut by their order into pieces first; a scan then has a level of groups, a level of pieces
inside the group and a level of rows inside the piece.

A group is cut when it holds more than ``limit = max(min_rows, rows / SPLITS)`` rows.  At most ``SPLITS`` groups can
do that, and together they get about ``SPLITS`` pieces: the table of cuts is bounded whatever the input, and it
is the only one that is broadcast.  Cuts come from a hash sample of the order columns.  They decide where a
piece ends and never what a row gets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

SPLITS = 4096
MIN_ROWS = 100_000
DRAWS = 32  # sampled rows a piece
COARSE = 32  # cuts passed over at once
PIECE = "_piece"
_HASHES = 1 << 31


def counted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))


def cuts(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: float) -> DataFrame:
    """(keys, cuts) of every group of more than ``limit`` rows: the first place of each piece but the first, ascending."""
    n = F.col("_n")
    large = counted(df, keys).where(n > limit).select(*keys, (_HASHES * DRAWS * F.ceil(n / limit) / n).alias("_share"))
    place = F.struct(*order)
    drawn = (
        df.join(F.broadcast(large), list(keys))
        .where(F.pmod(F.xxhash64(*order), F.lit(_HASHES)) < F.col("_share"))
        .select(*keys, place.alias("_at"))
        .distinct()
    )
    every = F.filter(F.array_sort(F.collect_list("_at")), lambda _, i: (i % DRAWS == 0) & (i > 0))
    return drawn.groupBy(*keys).agg(every.alias("_cuts"))


def _reached(found: Column, place: Column) -> Column:
    """How many of the ascending cuts are not after the place: whole runs of ``COARSE`` first, then single ones."""
    runs = F.size(F.filter(found, lambda c, i: (i % COARSE == 0) & (c <= place)))
    skipped = F.greatest(runs - 1, F.lit(0)) * COARSE
    return skipped + F.size(F.filter(F.slice(found, skipped + 1, F.lit(COARSE)), lambda c: c <= place))


def with_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows with the number of their piece in ``_piece``; pieces ascend with the order inside their group.

    Rows of one group with equal order columns share a piece.  Pieces are counted from 1; groups that need no cut are one
    piece, 0, and so are groups with a NULL key.  One job counts the groups; where one is too large, the cuts are made
    once as a table of their own.
    """
    size = counted(df, keys).agg(F.max("_n").alias("largest"), F.sum("_n").alias("rows")).first()
    limit = max(float(min_rows), (size.rows or 0) / SPLITS)
    if (size.largest or 0) <= limit:
        return df.withColumn(PIECE, F.lit(0))
    found = cut_lineage(cuts(df, keys, order, limit))
    piece = F.coalesce(F.when(F.col("_cuts").isNotNull(), _reached(F.col("_cuts"), F.struct(*order)) + 1), F.lit(0))
    return df.join(F.broadcast(found), list(keys), "left").withColumn(PIECE, piece).drop("_cuts")
