"""Repair of JSON text that arrives with fences, comments or unevaluated arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import col
from .text import rewrite_matches, strip

# What a JSON pair looks like, what a sound value is, what arithmetic is.
PAIR_PATTERN = r"""("\w+"\s*:\s*)([^\n\]}"']+)"""
SOUND_VALUE = r'^(null|true|false|"[^"]*"|-?\d+(\.\d+)?|\[.*\]|\{.*\})$'
OPERATION = r"\w\s*[+\-*/]\s*\w"
BARE_ARITHMETIC = r"\d+\s*\+\s*\d+|\d+\s*\*\s*\d+|\d+\s*/\s*\d+|\d+\s+-\s+\d+"
QUOTED = r'"[^"\\]*(?:\\.[^"\\]*)*"'


def strip_fences(c: str | Column) -> Column:
    t = strip(F.regexp_replace(col(c), "```(?:json)?", ""))
    return strip(F.regexp_replace(t, r"^`+|`+\z", ""))


def strip_comments(c: str | Column) -> Column:
    t = F.regexp_replace(col(c), r'(?d)(?<!["\w])//.*', "")
    return F.regexp_replace(t, r"(?s)/\*.*?\*/", "")


def null_arithmetic(c: str | Column) -> Column:
    """Values that are bare arithmetic become ``null``; a trailing comma stays."""

    def fix(hit: Column) -> Column:
        key = F.regexp_extract(hit, PAIR_PATTERN, 1)
        value = F.substring(hit, F.length(key) + 1, F.length(hit))
        clean = F.regexp_replace(F.trim(value), ",+$", "")
        comma = F.when(F.regexp_replace(value, r"\s+\z", "").endswith(","), ",").otherwise("")
        bad = ~clean.rlike("(?s)" + SOUND_VALUE) & clean.rlike(OPERATION)
        return F.when(bad, F.concat(key, F.lit(" null"), comma)).otherwise(hit)

    return rewrite_matches(col(c), PAIR_PATTERN, fix)


def has_arithmetic(c: str | Column) -> Column:
    return F.regexp_replace(col(c), "(?s)" + QUOTED, '""').rlike(BARE_ARITHMETIC)


def clean(c: str | Column) -> Column:
    return null_arithmetic(strip_comments(strip_fences(c)))
