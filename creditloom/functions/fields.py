"""Recognisers for dates, amounts, keywords and identifiers, and typed parsing."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .columns import col, first_or_null, quoted, strings
from .vocab import AMOUNT_PATTERN, DATE_PATTERNS, NUMBER_TOKEN_PATTERN, PAN_PATTERN

#: Matches wherever one of DATE_PATTERNS does, and fails fast elsewhere (amounts included).
DATE_HINT = r"\d(?:[/\-.]\d{1,2}[/\-.]\d\d|[\s\-]\s*[jfmasondJFMASOND])|\s\d{1,2},?\s+\d{4}"


def _from_digit(pattern: str) -> str:
    """The same pattern, given up at once where no digit starts; for patterns whose matches all start with one."""
    return rf"(?=[0-9])(?:{pattern})"


#: What Spark searches for; the patterns of the vocabulary are shared with SQL, which knows no look-ahead.
_DATES = [p if p.startswith(r"(?i)\b(?:") else _from_digit(p) for p in DATE_PATTERNS]
_AMOUNT = _from_digit(AMOUNT_PATTERN)


def may_have_date(c: str | Column) -> Column:
    """True for every text with a date, and for few others."""
    return has_digit(c) & col(c).rlike(DATE_HINT)


def find_date(c: str | Column, tested: bool = False) -> Column:
    """First match of the first pattern family that matches anywhere; ``tested`` texts have passed may_have_date."""
    hits = [first_or_null(F.regexp_extract_all(col(c), F.lit(p), F.lit(0))) for p in _DATES]
    found = F.coalesce(*hits)
    return found if tested else F.when(may_have_date(c), found)


def has_digit(c: str | Column) -> Column:
    """Cheap test in front of every date and amount pattern."""
    return col(c).rlike("[0-9]")


def has_date(c: str | Column) -> Column:
    return may_have_date(c) & col(c).rlike("|".join(f"(?:{p})" for p in _DATES))


def _numbers(c: str | Column) -> Column:
    hits = F.regexp_extract_all(col(c), F.lit(_AMOUNT), F.lit(0))
    return F.transform(hits, lambda h: F.replace(h, F.lit(","), F.lit("")).try_cast("double"))


def amounts(c: str | Column) -> Column:
    """All amounts, largest first."""
    found = F.sort_array(F.array_compact(_numbers(c)), asc=False)
    return F.when(has_digit(c), found).otherwise(F.array().cast("array<double>"))


def has_amount(c: str | Column) -> Column:
    return col(c).rlike(_AMOUNT)


def max_amount(c: str | Column) -> Column:
    return F.when(has_digit(c), F.array_max(_numbers(c)))


def clean_amount(c: str | Column) -> Column:
    digits = F.regexp_replace(col(c).cast("string"), r"[^0-9.]", "")
    return F.when(col(c).cast("string") != "", digits.try_cast("double"))


def has_any(c: str | Column, words: Iterable[str]) -> Column:
    """Any of the words as a substring; words that contain another listed word add nothing."""
    words = list(dict.fromkeys(words))
    short = [w for w in words if not any(v != w and v in w for v in words)]
    out = col(c).contains(short[0])
    for w in short[1:]:
        out = out | col(c).contains(w)
    return out


def count_words(c: str | Column, words: Iterable[str]) -> Column:
    """How many of the words occur as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + col(c).contains(w).cast("int")
    return total


def _tree(words: Iterable[str]) -> str:
    """Pattern of the longest of the words that starts at a place: words share their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = heads.pop("", None) is not None
    out = [quoted(head) + _tree(rest) for head, rest in heads.items()]
    if not out:
        return ""
    if len(out) == 1 and not ends:
        return out[0]
    return f"(?:{'|'.join(out)})" + ("?" if ends else "")


def _by_heads(words: Iterable[str], letters: int = 4) -> str:
    """The same as _tree, tested against few first letters at a time."""
    words = sorted(set(words))
    heads = sorted({w[0] for w in words})
    some = [heads[at : at + letters] for at in range(0, len(heads), letters)]
    return "|".join(f"(?=[{''.join(map(quoted, h))}]){_tree(w for w in words if w[0] in h)}" for h in some)


@dataclass(frozen=True)
class WordScan:
    """Which of many words occur in a text as substrings, found in one pass whatever the number of words.

    The longest word at each place is kept; the words that start there as well are its beginnings.
    """

    words: frozenset[str]

    def found(self, c: str | Column) -> Column:
        longest = F.lit(f"(?=({_by_heads(self.words)}))")
        return F.array_distinct(F.regexp_extract_all(col(c), longest, F.lit(1)))

    def _shown(self, word: str) -> list[str]:
        """The words kept at a place where this one is."""
        if word not in self.words:
            raise ValueError(f"{word!r} is not looked for")
        return sorted(w for w in self.words if w.startswith(word))

    def any(self, found: Column, words: Iterable[str]) -> Column:
        return F.arrays_overlap(found, strings(sorted({v for w in words for v in self._shown(w)})))

    def count(self, found: Column, words: Iterable[str]) -> Column:
        """How many of the words, none listed twice, occur."""
        alone = [w for w in words if len(self._shown(w)) == 1]
        total = F.size(F.array_intersect(found, strings(alone)))
        for w in words:
            if w not in alone:
                total = total + self.any(found, [w]).cast("int")
        return total


def first_offset(c: str | Column, words: Iterable[str]) -> Column:
    """Zero-based offset of the earliest of the words, or NULL."""
    return F.array_min(F.filter(F.array(*[F.instr(col(c), w) for w in words]), lambda at: at > 0)) - 1


def first_pan(c: str | Column) -> Column:
    hit = F.regexp_extract(col(c), PAN_PATTERN, 0)
    return F.when(hit == "", "NOT_FOUND").otherwise(hit)


def number_on_labelled_line(c: str | Column, words: Iterable[str], low: int, high: int) -> Column:
    """First ``low``..``high``-digit number on a line that carries one of the words."""
    pattern = rf"\b\d{{{low},{high}}}\b"
    hits = F.transform(
        F.filter(F.split(col(c), "\n"), lambda s: has_any(F.lower(s), words)),
        lambda s: F.nullif(F.regexp_extract(s, pattern, 0), F.lit("")),
    )
    return first_or_null(F.array_compact(hits))


def narration(line: Column, date: Column) -> Column:
    """A transaction line without its date and without its number tokens."""
    rest = F.trim(F.replace(line, date, F.lit("")))
    return F.trim(F.regexp_replace(rest, NUMBER_TOKEN_PATTERN, ""))


# Date formats accepted by the row checks: (guard, pattern), tried in this order.
_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
)


def parse_date(c: str | Column) -> Column:
    """Date by the first fitting format; two-digit years pivot at 69."""
    s = F.trim(col(c).cast("string"))
    tries = []
    for guard, pattern in _FORMATS:
        d = F.try_to_date(F.when(s.rlike(guard), s), pattern)
        if pattern.endswith("yy") and not pattern.endswith("yyyy"):
            d = F.when(F.year(d) > 2068, F.add_months(d, -1200)).otherwise(d)
        tries.append(d)
    return F.coalesce(*tries)


def is_float(c: str | Column) -> Column:
    return F.replace(col(c).cast("string"), F.lit(","), F.lit("")).try_cast("double").isNotNull()


def is_crdr(c: str | Column) -> Column:
    return F.coalesce(F.upper(col(c).cast("string")).isin("CR", "DR"), F.lit(False))


def is_text(c: str | Column) -> Column:
    return F.coalesce(F.trim(col(c).cast("string")) != "", F.lit(False))


def number_or_zero(c: str | Column) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))
