"""Routing of incoming documents by suffix, text length and page density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocab as V
from ..functions.text import strip



def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def source_kind(path: Column) -> Column:
    """text, pdf or image by suffix; NULL for unsupported files."""
    s = suffix_of(path)
    return (
        F.when(s.isin(*V.TEXT_SUFFIXES), "text")
        .when(s.isin(*V.PDF_SUFFIXES), "pdf")
        .when(s.isin(*V.IMAGE_SUFFIXES), "image")
    )


def split_by_support(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(supported files with their kind, reject table with the reason)."""
    tagged = files.withColumn("kind", source_kind(F.col(path)))
    bad = tagged.where(F.col("kind").isNull()).withColumn(
        "reason", F.concat(F.lit("Unsupported file type: "), suffix_of(F.col(path)))
    )
    return tagged.where(F.col("kind").isNotNull()), bad


def length_cascade(text: Column) -> dict[str, Column]:
    """Whether a text is too short to trust, long enough to skip OCR, or empty."""
    n = F.length(strip(text))
    return {
        "chars": n,
        "needs_next": n < V.CASCADE_MIN_CHARS,
        "ocr_accepts": n > V.OCR_ACCEPT_CHARS,
        "rejected": n == 0,
    }


def first_long_enough(*texts: Column) -> Column:
    """First candidate text of at least 50 characters, else the last candidate."""
    tries = [F.when(F.length(strip(t)) >= V.CASCADE_MIN_CHARS, t) for t in texts[:-1]]
    return F.coalesce(*tries, texts[-1])


def page_method(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Per document: page count, mean characters per page, native or ocr."""
    density = pages.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_pages"), F.avg(F.length(page)).alias("chars_per_page")
    )
    return density.withColumn(
        "method", F.when(F.col("chars_per_page") >= V.NATIVE_CHARS_PER_PAGE, "native").otherwise("ocr")
    )


def route_pages(pages: DataFrame, doc: str, page: str) -> DataFrame:
    """Every page with the method of its document.

    Pages stay rows: a document of very many pages is never gathered into one value.
    """
    return pages.join(page_method(pages, doc, page), doc)


def joined_text(pages: DataFrame, doc: str, number: str, page: str) -> DataFrame:
    """Pages of each document in order, joined by a blank line: one text per document, as long as the document is."""
    items = F.array_sort(F.collect_list(F.struct(number, page)))
    text = F.concat_ws("\n\n", F.transform(items, lambda x: x[page]))
    return pages.groupBy(doc).agg(text.alias("raw_text"))
