"""Text clean-up as SQL text for the comparison engine (no look-around there)."""

from __future__ import annotations

from ..functions import vocab as V

WORD = r"\p{L}\p{N}_"
BLANK = r"[\t\x0B\f\r \x1C-\x1F\x{85}\p{Z}]"
SPACE = r"[\n\t\x0B\f\r \x1C-\x1F\x{85}\p{Z}]"
EDGE_L, EDGE_R = rf"(^|[^{WORD}])", rf"($|[^{WORD}])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(t: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(to)}, 'g')"


def twice(t: str, pattern: str, to: str) -> str:
    return sub(sub(t, pattern, to), pattern, to)


def zipped(t: str, pattern: str, hit: str) -> str:
    """Rewrite every match: ``hit`` is SQL over the variable m."""
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({t}, {q(pattern)}), "
        f"list_transform(regexp_extract_all({t}, {q(pattern)}), lambda m: {hit})), "
        "lambda z: z[1] || coalesce(z[2], '')), '')"
    )


def strip(t: str) -> str:
    return sub(t, rf"^{SPACE}+|{SPACE}+$")


def invisible(t: str) -> str:
    return sub(t, r"[^\P{C}\n\t ]")


def ocr_fix(t: str) -> str:
    t = twice(t, f"{EDGE_L}O{EDGE_R}", r"\g<1>0\2").replace(r"\g<1>", r"\1")
    for a, b in (("O", "0"), ("l", "1"), ("I", "1"), ("S", "5")):
        t = twice(t, rf"(\d){a}(\d)", rf"\1{b}\2")
    return t


def linebreaks(t: str) -> str:
    return sub(sub(t, r"\r\n|\r", "\n"), r"\n{3,}", "\n\n")


def spaces(t: str) -> str:
    return sub(sub(t, r"[ \t]+", " "), rf"(?m)^{BLANK}+|{BLANK}+$")


def dates(t: str) -> str:
    t = twice(t, rf"{EDGE_L}(\d{{1,2}})[-.](\d{{1,2}})[-.](\d{{4}}){EDGE_R}", r"\1\2/\3/\4\5")
    t = twice(t, rf"{EDGE_L}(\d{{4}})-(\d{{2}})-(\d{{2}}){EDGE_R}", r"\1\4/\3/\2\5")
    for i, m in enumerate(V.MONTHS, 1):
        for day, pad in ((r"\d", "0"), (r"\d\d", "")):
            t = twice(
                t, rf"(?i){EDGE_L}({day})\s+{m}[a-z]*\s+(\d{{4}}){EDGE_R}", rf"\1{pad}\2/{i:02d}/\3\4"
            )
    return t


def currency(t: str) -> str:
    t = sub(t, rf"(?i)(?:Rs\.?|INR|₹|USD|\$|EUR|€){SPACE}*")
    return zipped(t, V.GROUPED_NUMBER_PATTERN, "replace(m, ',', '')")


def euro(t: str) -> str:
    return twice(t, rf"{EDGE_L}(\d{{1,3}})\.(\d{{3}}),(\d{{2}}){EDGE_R}", r"\1\2\3.\4\5")


def dehyphen(t: str) -> str:
    return sub(t, rf"([{WORD}])-\n([{WORD}])", r"\1\2")


def light(t: str) -> str:
    t = sub(f"coalesce({t},'')", r"[^\x00-\x7F₹%°]", " ")
    t = sub(t, r"(?i)(Rs\.?|INR|₹)\s*")
    t = sub(sub(t, " +", " "), r"\n+", "\n")
    return strip(sub(t, r"(\w)-\n(\w)", r"\1\2"))


def amounts(t: str) -> str:
    """All amounts of a text, largest first."""
    return (
        f"list_reverse_sort(list_transform(regexp_extract_all({t}, {q(V.AMOUNT_PATTERN)}), "
        "lambda m: TRY_CAST(replace(m, ',', '') AS DOUBLE)))"
    )


def find_date(t: str) -> str:
    return "coalesce(" + ",".join(f"nullif(regexp_extract({t}, {q(p)}),'')" for p in V.DATE_PATTERNS) + ")"


def any_word(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def n_words(t: str, words) -> str:
    return "(" + "+".join(f"contains({t}, {q(w)})::INT" for w in words) + ")"


def _register_documents() -> None:
    from .sqlviews import view

    view("noisy", """
SELECT 'documents' AS src, doc_id AS id, text FROM documents
UNION ALL SELECT 'pages', page_id, html FROM pages""")
    view("light", f"SELECT src, id, {light('text')} AS text FROM noisy", "noisy")
    view("document_docs", f"SELECT 'D' || doc_id AS doc_id, {light('text')} AS text FROM documents")
    view("all_docs", """
SELECT doc_id, 'bank_statement' AS doc_type, text FROM statements
UNION ALL SELECT doc_id, 'salary_slip', text FROM slip_docs
UNION ALL SELECT doc_id, 'utility_bill', text FROM bill_docs
UNION ALL SELECT doc_id, 'unknown', text FROM document_docs""", "statements", "slip_docs", "bill_docs", "document_docs")


_register_documents()
