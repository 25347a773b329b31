"""Text clean-up as column functions (Column -> Column), all evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .columns import col
from .vocab import GROUPED_NUMBER_PATTERN, MONTHS

# Word boundaries that hold for letters of every script.  Patterns start with a cheap
# test of their first character, so that most positions fail before any look-behind.
_LEFT = r"(?<![\p{L}\p{N}_])"
_RIGHT = r"(?![\p{L}\p{N}_])"
_DIGIT = rf"(?=\d){_LEFT}"
# White space: inside one line (Unicode spaces included), and with the line feed.
BLANKS = "\t\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0" + "".join(
    chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
SPACES = "\n" + BLANKS
_SPACE = r"[\n\t\x0B\f\r \x1C-\x1F\x85\p{Z}]"

MONTH_DATE_PATTERN = (
    rf"(?i){_DIGIT}(\d{{1,2}})\s+({'|'.join(MONTHS)})[a-z]*\s+(\d{{4}}){_RIGHT}"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def if_digits(value: Column, body: Callable[[Column], Column]) -> Column:
    """Apply a clean-up that can only change text with digits in it."""
    return let(value, lambda t: F.when(t.rlike("[0-9]"), body(t)).otherwise(t))


def rewrite_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match by a function of the match: split into gaps and matches, then zip."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rewrite)
    gaps = F.split(text, pattern, -1)
    closed = F.concat(found, F.array(F.lit("")))
    return F.array_join(F.zip_with(gaps, closed, lambda gap, hit: F.concat(gap, hit)), "")


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(SPACES))


def drop_invisible(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"[\p{C}&&[^\n\t ]]", "")


def fix_ocr(c: str | Column) -> Column:
    t = F.regexp_replace(col(c), rf"O(?<![\p{{L}}\p{{N}}_]O){_RIGHT}", "0")

    def between_digits(x: Column) -> Column:
        for glyph, digit in (("O", "0"), ("l", "1"), ("I", "1"), ("S", "5")):
            x = F.regexp_replace(x, rf"{glyph}(?<=\d{glyph})(?=\d)", digit)
        return x

    return if_digits(t, between_digits)


def unify_linebreaks(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"\r\n|\r", "\n"), r"\n{3,}", "\n\n")


def squeeze_spaces(c: str | Column) -> Column:
    t = F.regexp_replace(col(c), r"[ \t]{2,}|\t", " ")
    rows = F.transform(F.split(t, "\n"), lambda s: F.btrim(s, F.lit(BLANKS)))
    return F.array_join(rows, "\n")


def unify_dates(c: str | Column) -> Column:
    return if_digits(col(c), _slashed_dates)


def _slashed_dates(t: Column) -> Column:
    t = F.regexp_replace(t, rf"{_DIGIT}(\d{{1,2}})[-.](\d{{1,2}})[-.](\d{{4}}){_RIGHT}", "$1/$2/$3")
    t = F.regexp_replace(t, rf"{_DIGIT}(\d{{4}})-(\d{{2}})-(\d{{2}}){_RIGHT}", "$3/$2/$1")
    number_of = F.create_map(
        *[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m.lower(), f"{i:02d}")]
    )

    def slashed(hit: Column) -> Column:
        word = F.lower(F.regexp_extract(hit, r"([A-Za-z]{3})", 1))
        return F.concat(
            F.lpad(F.regexp_extract(hit, r"^(\d{1,2})", 1), 2, "0"),
            F.lit("/"),
            number_of[word],
            F.lit("/"),
            F.regexp_extract(hit, r"(\d{4})$", 1),
        )

    return let(
        t,
        lambda x: F.when(
            x.rlike(MONTH_DATE_PATTERN), rewrite_matches(x, MONTH_DATE_PATTERN, slashed)
        ).otherwise(x),
    )


def strip_currency(c: str | Column) -> Column:
    mark = rf"(?=[RrIiUuEe$₹€])(?i:Rs\.?|INR|₹|USD|\$|EUR|€){_SPACE}*"
    plain = lambda hit: F.replace(hit, F.lit(","), F.lit(""))
    return let(
        F.regexp_replace(col(c), mark, ""),
        lambda t: F.when(
            t.rlike(r"\d,\d\d"), rewrite_matches(t, GROUPED_NUMBER_PATTERN, plain)
        ).otherwise(t),
    )


def european_decimals(c: str | Column) -> Column:
    return F.regexp_replace(
        col(c), rf"{_DIGIT}(\d{{1,3}})\.(\d{{3}}),(\d{{2}}){_RIGHT}", "$1$2.$3"
    )


def join_hyphenated(c: str | Column) -> Column:
    return let(
        col(c),
        lambda t: F.when(
            t.contains("-\n"), F.regexp_replace(t, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
        ).otherwise(t),
    )


def normalise(c: str | Column) -> Column:
    """The full clean-up chain, in its fixed order."""
    t = col(c)
    for step in (
        drop_invisible,
        fix_ocr,
        unify_linebreaks,
        squeeze_spaces,
        unify_dates,
        strip_currency,
        european_decimals,
        join_hyphenated,
        strip,
    ):
        t = step(t)
    return t


def normalise_light(c: str | Column, strict: bool = False) -> Column:
    """Short chain of the live path; ``strict`` keeps currency letters inside words."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\x{80}-\x{10FFFF}&&[^₹°]]", " ")
    edge = r"\b" if strict else ""
    t = F.regexp_replace(t, rf"(?=[RrIi₹])(?i:{edge}Rs\.?|{edge}INR|₹)\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, " {2,}", " "), r"\n{2,}", "\n")
    return strip(join_hyphenated(t))


def squeeze_ocr(c: str | Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(c), " {2,}", " "), r"\n{2,}", "\n"))


def ascii_only(c: str | Column) -> Column:
    t = F.regexp_replace(col(c), r"[\x{80}-\x{10FFFF}]+", " ")
    return strip(F.regexp_replace(t, r"\n{2,}", "\n"))
