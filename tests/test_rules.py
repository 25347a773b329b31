"""Small labelled tables with known results."""

from pyspark.sql import functions as F

from creditloom.operators import assembly as A, evaluation as E, quality as Q, rules as U, scoring as S

FRAUD = """1 50000 300000 1 1 0|4 200000 300000 0 1 1|6 250000 300000 0 0 1|1 80000 500000 1 1 0|2 100000 500000 1 1 0
5 150000 200000 0 0 1|3 120000 200000 1 0 1|1 60000 400000 1 1 0|2 70000 400000 1 1 0|7 300000 250000 0 0 1
6 280000 250000 0 1 1|1 90000 600000 1 1 0|2 110000 600000 1 1 0|4 200000 180000 0 0 1|5 220000 180000 0 0 1
1 50000 350000 1 1 0|2 55000 350000 1 1 0|3 100000 300000 1 1 0|5 200000 300000 0 0 1|6 250000 150000 0 0 1"""
BEHAVIOUR = """2000 0 0 0|15000 12 3 1|3000 1 1 0|20000 15 4 1|2500 0 0 0|18000 10 2 1|4000 2 1 0|22000 18 5 1|5000 3 1 0|25000 20 4 1
3000 1 0 0|27000 25 6 1|2000 0 0 0|23000 14 3 1|4000 2 1 0|20000 12 2 1|3500 1 0 0|28000 22 5 1|3000 0 0 0|30000 30 7 1"""
TRUTH = "02 FGHIJ5678K|03 KLMNO9012P|01 ABCDE1234F|02 FGHIJ5678K|03 KLMNO9012P|04 PQRST3456U|05 UVWXY7890Z|06 ZXCVB1122Q|07 ASDFG3344L"
READ = "01 ABCDE1234F|02 NOT_FOUND|03 NOT_FOUND|04 PORST3456U|05 VINXY7890Z|06 NOT_FOUND|07 ASDFG3344L"


def rows(text):
    return [tuple(float(x) for x in r.split()) for line in text.split("\n") for r in line.split("|")]


def counts(df):
    r = E.confusion(df, "label", "guess").first()
    return r.tp, r.tn, r.fp, r.fn


def test_fraud_votes(spark):
    cols = "loan_count_30d double, avg_loan_amount double, income double, location_match double, employment_stability double, label double"
    df = spark.createDataFrame(rows(FRAUD), cols).withColumn("guess", U.fraud_votes())
    assert counts(df) == (10, 10, 0, 0)


def test_behaviour_votes(spark):
    cols = "variance_income double, bill_delay_days double, job_changes double, label double"
    df = spark.createDataFrame(rows(BEHAVIOUR), cols).withColumn("guess", U.behaviour_votes())
    assert counts(df) == (9, 10, 0, 1)
    assert E.errors(df, "label", "guess").first().error == "false negative"


def test_field_and_char_accuracy(spark):
    truth = spark.createDataFrame([tuple(x.split()) for x in TRUTH.split("|")], "image string, pan string")
    read = spark.createDataFrame([tuple(x.split()) for x in READ.split("|")], "image string, guess string")
    j = truth.join(read, "image")
    r = j.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("pan") == F.col("guess")).cast("int")).alias("field"),
        F.avg(E.same_chars("pan", "guess")).alias("chars"),
    ).first()
    assert (r.n, round(r.field, 2), round(r.chars, 2)) == (9, 0.22, 0.40)


def test_same_chars_of_empty_text(spark):
    df = spark.createDataFrame([("", "ab"), ("", ""), ("abc", "abd")], "a string, b string")
    assert [r.x for r in df.select(E.same_chars("a", "b").alias("x")).collect()] == [0.0, None, 2 / 3]


def test_product_confidence(spark):
    cases = [(1.0, 1.0, 0.95, 0.08), (0.6, 0.6, 0.70, 0.45), (1.0, 1.0, 0.40, 0.49)]
    df = spark.createDataFrame(cases, "c double, q double, f double, p double")
    pct, band = S.confidence_product(F.col("c"), F.col("q"), F.col("f"), F.col("p"))
    got = [(r.pct, r.band.split(" Conf")[0]) for r in df.select(pct.alias("pct"), band.alias("band")).collect()]
    assert got == [(79.8, "Moderate"), (2.52, "Very Low"), (0.8, "Very Low")]


def test_stacking_missing_counts_once(spark):
    flag, score, reasons = U.loan_stacking(F.col("n"))
    df = spark.createDataFrame([(None,), (3,), (4,)], "n int").select(flag.alias("f"), score.alias("s"), reasons.alias("r"))
    assert [(r.f, r.s, r.r) for r in df.collect()] == [(False, 0.1, []), (False, 0.1, []), (True, 0.9, ["loan_stacking"])]


def test_quality_ranges_are_optional(spark):
    df = spark.createDataFrame([("1,200", "50", None), ("10", "600", "x")], "gross_salary string, net_salary string, pf string")
    lenient = Q.check_rows(df, "salary").select("confidence_score", "issues").collect()
    assert [(r[0], r[1]) for r in lenient] == [(0.9333, ""), (0.8333, "pf not numeric")]
    strict = Q.check_rows(df, "salary", enforce_ranges=True).select("issues").collect()
    assert [r[0] for r in strict] == ["net_salary not numeric", "gross_salary not numeric; pf not numeric"]


def test_reject_inference(spark):
    labeled = spark.createDataFrame([(1, 0)], "id int, default int")
    assert A.with_reject_inference(labeled, None) is labeled
    out = A.with_reject_inference(labeled, spark.createDataFrame([(2,)], "id int"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0), (2, -1)]
    try:
        A.with_reject_inference(labeled, labeled, "fuzzy")
    except ValueError:
        return
    raise AssertionError("unknown strategy accepted")


def test_clean_nonfinite(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")]), (2.0, [])], "a double, b array<double>")
    assert [tuple(r) for r in A.clean_nonfinite(df).collect()] == [(None, [1.0, None]), (2.0, [])]
