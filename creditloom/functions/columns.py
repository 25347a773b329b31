"""Small column helpers shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column, digits: int) -> Column:
    """Half-up rounding by plain IEEE steps, so that every engine agrees bit for bit."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def cents(c: str | Column) -> Column:
    """Money as whole cents: integer sums do not depend on the order of rows."""
    return F.round(col(c) * 100).cast("bigint")


def number(c: str | Column) -> Column:
    """Double or NULL; NaN and infinities count as missing."""
    v = col(c).try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)


def stable_hash(c: str | Column) -> Column:
    """Non-negative hash of a key that is the same in every engine and every run."""
    return F.conv(F.substring(F.md5(col(c).cast("string")), 1, 8), 16, 10).cast("bigint")


def ratio(top: Column, bottom: Column, default: float | None) -> Column:
    """top / bottom, or ``default`` where the denominator is zero."""
    return F.when(bottom == 0, F.lit(default)).otherwise(F.try_divide(top, bottom))


def ladder(c: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """First label whose upper bound exceeds the value; the last bound is open."""
    out = F.lit(steps[-1][1])
    for bound, label in reversed(steps[:-1]):
        out = F.when(c < bound, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def one_of_regex(words: Iterable[str]) -> str:
    """One alternation that matches where any of the words is a substring."""
    return "|".join(map(quoted, words))


def quoted(word: str) -> str:
    """A pattern that matches the word itself."""
    special = set(r".^$*+?{}[]\|()-")
    return "".join("\\" + ch if ch in special else ch for ch in word)


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def compact(*items: Column) -> Column:
    """Array of the items that are not NULL, in order."""
    return F.array_compact(F.array(*items))


def first_or_null(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def computed_once(df: DataFrame, keep: Sequence[str], *columns: Column) -> DataFrame:
    """Select ``keep`` plus costly columns so that later filters reuse their values.

    A plain projection is inlined into every filter above it, which would repeat
    the regular expressions of a document once per reference.  Generating exactly
    one row per input row keeps the values as attributes; nothing is shuffled.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*columns))))
