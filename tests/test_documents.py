"""Extraction on small hand-written documents."""

import pytest
from pyspark.sql import functions as F

from creditloom.functions import fields as X, vocab as V
from creditloom.operators import canonical as C, extract as E, routing as R
from creditloom.sources import files


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_transactions_without_header(spark):
    text = "05/01/2024 deposit 100.00 900.00\n06/01/2024 atm fee DR 20.00\n07/01/2024 misc 30.00 870.00\n08/01/2024 only 5.00\nno date 9.00"
    rows = E.typed_transactions(E.transactions(docs(spark, a=text))).orderBy("pos").collect()
    got = [(r.date, r.amount, r.type, r.closing_balance) for r in rows]
    assert got == [
        ("05/01/2024", 900.0, "CR", 100.0), ("06/01/2024", 20.0, "DR", 20.0),
        ("07/01/2024", 870.0, "DR", 30.0), ("08/01/2024", 0.0, None, 5.0),
    ]
    last = E.transactions(docs(spark, a=text), balance="last_token").orderBy("pos").first()
    assert last.closing_balance == 900.0


def test_header_order_decides_the_columns(spark):
    text = "Date       Credit         Debit\n05/01/2024 10.00\n06/01/2024                20.00"
    rows = E.transactions(docs(spark, a=text)).orderBy("pos").collect()
    assert [(r.credit, r.debit) for r in rows] == [(10.0, None), (None, 20.0)]


def test_header_beyond_forty_lines_is_ignored(spark):
    text = "\n".join(["x"] * 40 + ["Debit Credit"])
    assert docs(spark, a=text).select(E.header_columns().alias("h")).first().h is None


def test_utility_words_suppress_the_bank_reading(spark):
    text = "Electricity bill\nMeter No 12\n05/01/2024 payment 100.00\nAmount due 250.00"
    r = E.validate_best(E.choose_best(E.extract_all(docs(spark, a=text)))).first()
    assert r.bank.confidence == 0.05 and r.best.doc_type == "UTILITY" and r.fail_level is None


def test_rejection_names_all_diagnostics(spark):
    r = E.choose_best(E.extract_all(docs(spark, a="hello")), threshold=0.9).first()
    assert E.NO_ROWS in r.reject_reason and E.NO_SALARY in r.reject_reason


def entity(name, raw=None, number=None, conf=1.0, pos=0, doc="d"):
    return (doc, name, raw, number, conf, pos)


ENTITY = "doc_id string, entity string, raw_value string, numeric_value double, confidence double, pos int"


def test_best_entity_first_wins_ties(spark):
    rows = [entity("net_salary", number=1.0, conf=0.5), entity("net_salary", number=2.0, conf=0.5, pos=1), entity("due_date", raw="")]
    r = C.canonical(spark.createDataFrame(rows, ENTITY)).first()
    assert r.net_salary == 1.0 and r.due_date is None and r.entity_confidences == {"net_salary": 0.5}


def test_unpaid_contains_paid(spark):
    rows = [entity("payment_status", raw="Unpaid"), entity("bill_amount", number=9.0)]
    d = C.canonical(spark.createDataFrame(rows, ENTITY))
    assert d.select(C.utility_feature_struct().alias("u")).first().u.payment_discipline_flag == 1
    assert d.select(C.utility_feature_struct(word_boundary=True).alias("u")).first().u.payment_discipline_flag == 0


def test_net_above_gross_swaps(spark):
    rows = [entity("net_salary", number=90.0), entity("gross_salary", number=60.0)]
    u = C.evaluate(C.canonical(spark.createDataFrame(rows, ENTITY))).first().salary_features
    assert (u.gross_salary, u.net_salary, u.net_to_gross_ratio) == (90.0, 60.0, 0.6667)


def test_nothing_found_is_rejected_at_level_one(spark):
    rows = [entity("transaction_description", raw="hello")]
    r = C.gate(C.choose(C.evaluate(C.canonical(spark.createDataFrame(rows, ENTITY))))).first()
    assert (r.level_reached, r.passed) == (1, False) and r.failure_reason.count(";") == 4


def test_lists_of_entities_fold_like_their_rows(spark):
    """Lists of one document in several rows, a document without id and an empty list included."""
    rows = [
        entity("credit_amount", "5.0", 5.0, 0.5, 1), entity("credit_amount", "7.0", 7.0, 0.9, 0), entity("due_date", "1/2/2020", conf=0.2),
        entity("due_date", "3/2/2020", conf=0.4, pos=2), entity("net_salary", None, None, 0.3, doc=None), entity("pay_period", "May", doc=None),
    ]
    flat = spark.createDataFrame(rows, ENTITY)
    item = F.struct("entity", "raw_value", "numeric_value", "confidence", "pos")
    lists = flat.groupBy("doc_id", F.col("pos") % 2).agg(F.collect_list(item).alias("items")).select("doc_id", "items")
    lists = lists.unionByName(lists.limit(1).select(F.lit("d").alias("doc_id"), F.slice("items", 1, 0).alias("items")))
    found = C.canonical(lists)
    assert sorted(map(str, found.collect())) == sorted(map(str, C.canonical(flat).collect()))
    assert found.where("doc_id = 'd'").select("credit_amounts", "due_date").first() == ([7.0, 5.0], "3/2/2020")
    assert sorted(map(str, C.entity_rows(lists).collect())) == sorted(map(str, flat.collect()))


def test_features_of_one_kind_gather_no_lists_of_another(spark):
    flat = spark.createDataFrame([entity("net_salary", number=1.0)], ENTITY)
    plan = C.evaluate(C.canonical(flat)).select("doc_id", "salary_features.*")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "net_salary" in plan


def test_dates_and_amounts_inside_words_and_numbers(spark):
    lines = ["x12/03/2020", "on 12/03/2020 ok", "5 Jan 2020 and 1/2/20", "Jan 5, 2020", "a1,234.50b", "1,23,456.78 or 12.50", "2020-01-02", "no", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string").orderBy("i")
    plain = F.regexp_extract_all("s", F.lit(V.AMOUNT_PATTERN), F.lit(0))
    found = df.select(X.find_date("s").alias("date"), X.has_date("s").alias("dated"), X.amounts("s").alias("amounts"), plain.alias("plain")).collect()
    assert [r.date for r in found] == [None, "12/03/2020", "1/2/20", "Jan 5, 2020", None, None, "2020-01-02", None, None]
    assert [bool(r.dated) for r in found] == [bool(r.date) for r in found]
    assert [r.amounts for r in found] == [sorted((float(x.replace(",", "")) for x in r.plain or []), reverse=True) for r in found]


def test_suffix_routing(spark):
    df = spark.createDataFrame([("/a/b.TXT",), ("/a/b.pdf",), ("/a.d/c.jpeg",), ("/a/x.docx",)], "path string")
    ok, bad = R.split_by_support(df)
    assert sorted(r.kind for r in ok.collect()) == ["image", "pdf", "text"]
    assert bad.first().reason == "Unsupported file type: .docx"


def test_joined_pages(spark):
    df = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one")], "doc string, no int, page string")
    assert R.joined_text(df, "doc", "no", "page").first().raw_text == "one\n\ntwo"


def test_bad_bytes_do_not_stop_the_text_scan(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok\nbad \xff byte\n")
    rows = files.read_text_lines(spark, str(tmp_path)).orderBy("value").collect()
    assert len(rows) == 2 and rows[0].suffix == ".txt"


def test_glued_header_is_skipped(spark, tmp_path):
    (tmp_path / "truth.csv").write_text("image_name,panx,1\nimg_2,pan,N,P2,,,clean\n")
    df = files.read_csv(spark, str(tmp_path), files.CSV_SCHEMAS["ground_truth"])
    assert [(r.image_name, r.pan, r.label) for r in df.collect()] == [("img_2", "P2", "clean")]


def test_scorecard_survives_saving(spark, tmp_path):
    from creditloom.sources.applicants import fixed_card

    files.save_scorecard(spark, fixed_card(), str(tmp_path / "card"))
    assert files.load_scorecard(spark, str(tmp_path / "card")) == fixed_card()


def test_artifact_versions(spark, tmp_path):
    """Versions stay as published, the latest one is the default, and a run without its commit row is not seen."""
    from dataclasses import replace

    from creditloom.operators import learners as L
    from creditloom.sources.applicants import fixed_card
    from creditloom.sources.artifacts import ArtifactStore

    store = ArtifactStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="nothing is published"):
        store.card()
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), i % 2) for i in range(60)], "id int, a double, b double, y int")
    data = L._assembled(df, ["a", "b"]).select("id", "features", "y")
    model = L.boosted("y", rounds=3).fit(data)
    one, two = fixed_card(), replace(fixed_card(), intercept=0.5)
    assert store.publish(one, {"rows": df}, {"trees": model}) == 1
    assert store.publish(two, {"rows": df.where("id < 10")}) == 2
    (tmp_path / "store" / "version-3-left-behind").mkdir()
    assert store.card() == two and store.card(1) == one
    assert store.table("rows", 1).count() == 60 and store.table("rows").count() == 10
    probs = lambda m: [(r.id, r.probability) for r in m.transform(data).orderBy("id").collect()]
    assert probs(store.model("trees", 1)) == probs(model)
    for wrong in (lambda: store.card(3), lambda: store.model("trees"), lambda: store.table("none", 1)):
        with pytest.raises(ValueError):
            wrong()


def test_prompts_hold_the_whole_text(spark):
    from creditloom.sources import documents as D

    text = "x" * 20000
    df = spark.createDataFrame([("salary_slip", text, "{broken", 612, 0.25)], "kind string, text string, raw string, score int, pd double")
    r = df.select(
        D.extraction_prompt("kind", "text").alias("ask"),
        D.repair_prompt(F.lit("bad value"), F.col("raw"), "kind", "text").alias("fix"),
        D.explanation_prompt(F.col("score"), F.lit("Medium Risk"), F.col("pd"), F.struct("pd"), F.struct("score")).alias("say"),
    ).first()
    assert r.ask.endswith(text) and "salary slip" in r.ask
    assert "bad value" in r.fix and "{broken" in r.fix and r.fix.endswith(text)
    assert "612" in r.say and "Medium Risk" in r.say


def test_weak_features_are_reported(spark):
    from creditloom.operators.binning import weak_features

    df = spark.createDataFrame([("a", 0.01), ("a", 0.005), ("b", 0.5)], "feature string, iv double")
    assert [r.feature for r in weak_features(df).collect()] == ["a"]
