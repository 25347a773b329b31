"""Literal samples for clean-up, recognisers and JSON repair."""

import pytest
from pyspark.sql import functions as F

from creditloom.functions import fields as X, jsontext as J, text as T, vocab as V


def run(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn("t").alias("x")).first().x


@pytest.mark.parametrize(
    ("fn", "given", "wanted"),
    [
        (T.fix_ocr, "1O2 and O, 3l4 5I6 7S8", "102 and 0, 314 516 758"),
        (T.fix_ocr, "1O2O3", "10203"),
        (T.unify_linebreaks, "a\r\nb\rc\n\n\n\nd", "a\nb\nc\n\nd"),
        (T.squeeze_spaces, " a \t b  \n  c\t", "a b\nc"),
        (T.unify_dates, "2024-03-09", "09/03/2024"),
        (T.unify_dates, "7 Mar 2024 and 12.11.2023", "07/03/2024 and 12/11/2023"),
        (T.unify_dates, "7 march 2024", "07/03/2024"),
        (T.strip_currency, "Rs. 1,00,000.50 or ₹ 20,000", "100000.50 or 20000"),
        (T.strip_currency, "1.000,50", "1.00050"),
        (T.european_decimals, "1.000,50", "1000.50"),
        (T.join_hyphenated, "transac-\ntion", "transaction"),
        (T.drop_invisible, "a​b\r\n\tc", "ab\n\tc"),
        (T.normalise_light, "Transfers\n500 hours", "Transfe500 hou"),
        (lambda c: T.normalise_light(c, strict=True), "Transfers\n500 Rs. 7", "Transfers\n500 7"),
        (T.ascii_only, "é a\n\n\nb ", "a\nb"),
        (T.squeeze_ocr, "  a   b\n\n\nc ", "a b\nc"),
        (X.find_date, "paid 2024-01-02 or 3 Jan 2024", "3 Jan 2024"),
        (X.find_date, "no date", None),
        (X.first_pan, "id ABCDE1234F.", "ABCDE1234F"),
        (X.first_pan, "nothing", "NOT_FOUND"),
        (X.clean_amount, "Rs 1,234.50", 1234.5),
        (X.clean_amount, "", None),
        (X.clean_amount, "1.2.3", None),
        (J.has_arithmetic, '{"a": 3 - 4}', True),
        (J.has_arithmetic, '{"a": "2024-01-02"}', False),
        (J.strip_fences, "```json\n{}\n```", "{}"),
    ],
)
def test_samples(spark, fn, given, wanted):
    assert run(spark, given, fn) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("1,00,000.50", [100000.5]),
        ("100,000", [100.0, 0.0]),
        ("01.02.2024", [1.02]),
        ("10000.00", [10000.0]),
        ("1234567.89", []),
        ("none", []),
    ],
)
def test_amounts(spark, given, wanted):
    assert run(spark, given, X.amounts) == wanted


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("05/01/24", "2024-01-05"),
        ("5/1/2024", "2024-01-05"),
        ("05/01/85", "1985-01-05"),
        ("05-01-2024", "2024-01-05"),
        ("2024-01-05", "2024-01-05"),
        ("31/02/2024", None),
        ("soon", None),
    ],
)
def test_parse_date(spark, given, wanted):
    got = run(spark, given, X.parse_date)
    assert (got and got.isoformat()) == wanted


def test_json_repair(spark):
    raw = '```json\n{"gross_salary": 45000.00,\n"net_salary": 40500 - 4229, // note\n"name": "A - B"\n}\n```'
    assert run(spark, raw, J.clean) == '{"gross_salary": 45000.00,\n"net_salary":  null,\n"name": "A - B"\n}'


def test_narration(spark):
    df = spark.createDataFrame([("05/01/2024 NEFT SALARY 45,000.00 61,250.50",)], "line string")
    got = df.select(X.narration(F.col("line"), X.find_date("line")).alias("x")).first().x
    assert got == "NEFT SALARY"


def test_words_of_many_lists_are_found_in_one_scan(spark):
    words = ["pf", "epf", "pf deduction", "due", "due date", "due by", "a/c no", "acc no.", "ca no", "no"]
    texts = ["epf deduction", "due dat", "overdue date a/c no", "acc noo ca no", "", "pf\ndeduction due\nby", None, "xpf deductionepf"]
    scan = X.WordScan(frozenset(words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("f", scan.found("t"))
    flags = [scan.any(F.col("f"), [w]).alias(f"w{k}") for k, w in enumerate(words)]
    rows = df.select("t", scan.any(F.col("f"), words).alias("any"), scan.count(F.col("f"), words).alias("n"), *flags).collect()
    for r in rows:
        expected = None if r.t is None else [w in r.t for w in words]
        assert [r[f"w{k}"] for k in range(len(words))] == (expected or [None] * len(words))
        assert r.any == (None if expected is None else any(expected))
        if expected is not None:
            assert r.n == sum(expected)
    assert "Contains(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_date_hint_passes_every_date(spark):
    lines = ["1/2/2024", "on 01-02-24.", "3 jan 24", "03\t JANUARY.  2024", "4-Mar-99", "2024-05-06", "Sept. 7, 2024", "oct 7 2024", "12.50", "May 2024"]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    plain = F.coalesce(*[F.nullif(F.regexp_extract("s", p, 0), F.lit("")) for p in V.DATE_PATTERNS])
    assert [r.a for r in df.select(X.find_date("s").alias("a")).collect()] == [r.a for r in df.select(plain.alias("a")).collect()]


def test_labels_of_documents_are_looked_for_once(spark):
    from creditloom.operators import extract as E

    plan = E.document_facts(spark.createDataFrame([("a", "x")], "doc_id string, text string"))._jdf.queryExecution().optimizedPlan()
    assert "Contains(low" not in plan.toString()


def test_max_amount_is_the_first_of_all_amounts(spark):
    lines = ["1,234.50 and 99.10", "12 345", "no", "", None, "0.00 7.5", "1.23 1.24"]
    df = spark.createDataFrame([(s,) for s in lines], "s string")
    for r in df.select(X.max_amount("s").alias("a"), F.try_element_at(X.amounts("s"), F.lit(1)).alias("b")).collect():
        assert r.a == r.b
