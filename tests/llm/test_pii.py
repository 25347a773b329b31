"""Spans against the plain patterns of Python's re, and masking."""

import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import SMALL
from creditloom.llm import pii
from llm.helpers import LONG, no_docs, odd_docs, texts_of

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]
HARD = [
    "a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "999.1.1.1.2.3.4.5", "+1 (2) 3 4 5 6 7 8 9 ", "4111 1111 1111 1111",
    "4111-1111-1111-1111 x 4111111111111112", "x" * 50_000 + "@", "9" * 60_000, "é 4111111111111111 ü a@b.co", "+1+2+34567890123",
    "a@b@c.d", "..@a.b a@b.c.d@e.f", "00000.0255.1.1", "12345678901234567890 1234", "\U0001f600 1.1.1.1", "1.2.3.4@x.yy 1.1.1.1",
    " ".join(["4111111111111111 x"] * 2000),
]


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0
    return True


def base_spans(text):
    found = [(m.start(), r, k, m.end()) for r, (k, p) in enumerate(PLAIN) for m in p.finditer(text or "") if passes(k, m.group())]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def compare(rows, texts):
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == name for k, _, _ in spans) for name, _ in PLAIN]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_documents(spark):
    compare(pii.report(spark.read.parquet(f"{SMALL}/documents.parquet")).collect(), texts_of(spark, SMALL))


def test_hard_texts(spark):
    texts = dict(enumerate(HARD))
    compare(pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="01 23-.4+(5)@ab_%é", max_size=40), min_size=60, max_size=60))
def test_random_texts(spark, texts):
    compare(pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect(), dict(enumerate(texts)))


def test_accounts_and_context(spark):
    texts = {1: "my iban is GB82 WEST 1234 5698 7654 32 ok", 2: "DE89370400440532013000", 3: "DE89370400440532013001", 4: "call +1 (017) 555-7713 now"}
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert rows[1].spans == "iban:11:38" and float(rows[1].scores) > float(rows[2].scores)
    assert rows[2].spans == "iban:0:22" and rows[3].spans == ""
    assert rows[4].spans == "phone:5:22" and float(rows[4].scores) == 0.85


def test_accounts_before_other_words(spark):
    german, british = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    spaced = "DE89 3704 0044 0532 0130 00"
    texts = {
        1: f"IBAN {german} Thanks", 2: f"IBAN {spaced} BIC COBADEFF", 3: "pay GB82WEST12345698765432 2 times", 4: f"{german} {british} X",
        5: f"é {german} 12 34 {german}", 6: f"{german}Thanks", 7: f"x{german}", 8: "DE89370400440532013001 Thanks", 9: f"AB12 CD34 EF56 {german} OK",
        10: "XX90 0000 0000 0000 000 BIC", 11: f"{british}7 a", 12: "NO9386011117947 A" + "B" * 40, 13: "AB12CD34 " * 20_000 + german + " Q1",
    }
    rows = {r.doc_id: r for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    found = {k: [texts[k][int(a) : int(b)] for kind, a, b in (x.split(":") for x in r.spans.split(",") if x) if kind == "iban"] for k, r in rows.items()}
    assert [found[k] for k in (1, 2, 3)] == [[german], [spaced], ["GB82WEST12345698765432"]]
    assert found[4] == [german, british] and found[5] == [german, german] and found[9] == found[13] == [german]
    assert found[6] == found[7] == found[8] == found[11] == [] and found[12] == ["NO9386011117947"]
    assert found[10] == ["XX90 0000 0000 0000 000"]  # of no listed country
    masked = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert masked[1] == "IBAN [IBAN] Thanks" and masked[2] == "IBAN [IBAN] BIC COBADEFF" and masked[4] == "[IBAN] [IBAN] X"


def test_masks(spark):
    texts = {1: "a@b.co, 1.2.3.4!", 2: "1.2.3.4@x.yy end", 3: None, 4: "nothing"}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(docs).collect()}
    assert out == {1: ("[EMAIL], [IP]!", 14), 2: ("[EMAIL] end", 11), 3: (None, 0), 4: ("nothing", 7)}
    assert pii.redact(docs).columns == docs.columns


def test_many_spans_in_one_text(spark):
    account, n = "DE89370400440532013000", 4000
    text = "".join(f"é write u{i}@a.bc or {account} Now {i % 256}.1.2.3\n" for i in range(n))
    docs = spark.createDataFrame([(1, text), (2, "x" * 5000 + " a@b.co " + "y" * 5000)], "doc_id long, text string")
    compare(pii.report(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
    row = pii.report(docs.where("doc_id = 1")).first()
    assert row.spans.count("iban") == n
    scores = dict(zip(row.spans.split(","), row.scores.split(","), strict=True))
    low = text.lower()
    for k in range(0, 3 * n, 611):
        span = row.spans.split(",")[k]
        kind, a, b = span.split(":")
        near = low[max(int(a) - 40, 0) : int(a)] + " " + low[int(b) : int(b) + 25]
        rule = next(x for x in pii.KINDS if x.name == kind)
        hit = [bool(words) and re.search(r"\b(?:" + "|".join(words) + ")", near) is not None for words in (rule.words, rule.against)]
        assert abs(float(scores[span]) - min(1.0, rule.score + 0.15 * hit[0] - 0.15 * hit[1])) < 0.006
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[1] == "é write [EMAIL] or [IBAN] Now [IP]\n" * n
    assert masked[2] == "x" * 5000 + " [EMAIL] " + "y" * 5000


def test_odd_and_no_rows(spark):
    docs = odd_docs(spark)
    assert len(pii.report(docs).collect()) == 11
    masked = pii.redact(docs).collect()
    assert len(masked) == 11 and LONG in [r.text for r in masked] and masked[0].asDict().keys() == set(docs.columns)
    assert pii.report(no_docs(spark)).collect() == [] and pii.redact(no_docs(spark)).collect() == []
