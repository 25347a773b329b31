"""Document views: prose, pages, and financial documents rendered from the credit views.

Statements are rendered per account *page*.  An account may own a third of all
transactions, so its rows are dealt by a hash over as many pages as it needs; every
row lands on exactly one page and a page holds about ``LINES_PER_PAGE`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import col, computed_once, rnd, stable_hash
from ..functions.fields import find_date
from ..functions.text import normalise_light
from ..operators import canonical, extract
from . import views
from .tables import spread, table

LINES_PER_PAGE = 200
SALTS = 16
STATEMENT_HEAD = "Statement of Account - Branch NEFT UPI"


def printed(c: str | Column) -> Column:
    """Money with two decimals, or NULL."""
    return F.when(col(c).isNotNull(), F.format_string("%.2f", col(c)))


def noisy(spark: SparkSession, d: str) -> DataFrame:
    """Prose documents and raw web pages as (src, id, text)."""
    docs = spread(table(spark, d, "documents")).select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text"
    )
    pages = spread(table(spark, d, "pages")).select(
        F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    return docs.unionByName(pages)


def light(spark: SparkSession, d: str) -> DataFrame:
    return noisy(spark, d).select("src", "id", normalise_light("text").alias("text"))


def prose(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select(
        F.concat(F.lit("D"), "doc_id").alias("doc_id"), normalise_light("text").alias("text")
    )


def statement_lines(spark: SparkSession, d: str) -> DataFrame:
    """Ledger rows with the statement page they are printed on.

    The number of pages is counted in two steps and joined by account and salt, so that the
    rows of one busy account are spread over SALTS tasks.
    """
    salt = (stable_hash("txn_id") % SALTS).alias("salt")
    lines = views.ledger_lines(spark, d).select("*", salt)
    parts = lines.groupBy("account_id", "salt").agg(F.count(F.lit(1)).alias("n"))
    pages = parts.groupBy("account_id").agg(F.ceil(F.sum("n") / LINES_PER_PAGE).alias("n_pages"))
    pages = pages.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return lines.join(pages, ["account_id", "salt"]).select(
        F.concat(F.lit("S"), "account_id", F.lit("-"), stable_hash("txn_id") % F.col("n_pages")).alias("doc_id"),
        "account_id", "txn_id", "txn_date", "amount", "txn_type", "narration",
    )


def _pages(lines: DataFrame, entry: Column) -> DataFrame:
    """Entries of each page in (date, id) order, grouped by the page alone: pages of one account go to different tasks."""
    item = F.struct("txn_date", "txn_id", entry.alias("entry"))
    return lines.groupBy("doc_id").agg(F.max("account_id").alias("account_id"), F.array_sort(F.collect_list(item)).alias("items"))


def statements(spark: SparkSession, d: str) -> DataFrame:
    """Fixed-width statement text: date, narration, debit column, credit column."""
    money = printed("amount")
    debit = F.when(F.col("txn_type") == "DR", money).otherwise("")
    credit = F.when(F.col("txn_type") == "CR", money).otherwise("")
    line = F.concat(
        F.rpad(F.date_format("txn_date", "dd/MM/yyyy"), 11, " "), F.rpad("narration", 20, " "),
        F.rpad(debit, 15, " "), credit,
    )
    head = F.concat(
        F.lit(STATEMENT_HEAD + "\nAccount No: "), F.lpad(F.col("account_id").cast("string"), 12, "0"),
        F.lit("\n" + "Date".ljust(11) + "Narration".ljust(20) + "Debit".ljust(15) + "Credit"),
    )
    return _pages(statement_lines(spark, d), line).select(
        "doc_id", "account_id",
        F.concat_ws("\n", head, F.transform("items", lambda i: i["entry"])).alias("text"),
    )


def statement_json(spark: SparkSession, d: str) -> DataFrame:
    """The same statements as nested JSON."""
    entry = F.struct(
        F.date_format("txn_date", "dd/MM/yyyy").alias("date"),
        F.col("narration").alias("description"),
        F.when(F.col("txn_type") == "DR", F.col("amount")).alias("debit"),
        F.when(F.col("txn_type") == "CR", F.col("amount")).alias("credit"),
    )
    return _pages(statement_lines(spark, d), entry).select(
        "doc_id",
        F.to_json(F.struct(F.transform("items", lambda i: i["entry"]).alias("transactions"))).alias("raw"),
    )


def pan_of(key: Column) -> Column:
    five = F.lpad(key.cast("string"), 5, "0")
    letters = F.translate(F.substring(five, 1, 5), "0123456789", "ABCDEFGHIJ")
    return F.concat(letters, F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("K"))


def slip_documents(spark: SparkSession, d: str) -> DataFrame:
    gross = F.col("gross_salary")
    return views.slips(spark, d).select(
        F.concat(F.lit("P"), "account_id").alias("doc_id"),
        "account_id",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Salary slip for the month of "), "pay_period"),
            F.concat(F.lit("PAN: "), pan_of(F.col("account_id"))),
            F.concat(F.lit("Gross Salary: "), printed(gross)),
            F.concat(F.lit("Basic Pay: "), printed(rnd(gross * 0.5, 2))),
            F.concat(F.lit("HRA: "), printed(rnd(gross * 0.2, 2))),
            F.concat(F.lit("PF Deduction: "), printed("pf")),
            F.concat(F.lit("Net Salary: "), printed("net_salary")),
        ).alias("text"),
    )


def bill_documents(spark: SparkSession, d: str) -> DataFrame:
    """One bill text per bill; a missed bill is printed as due."""
    on = F.to_date("ts")
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    e = spread(views.events(spark, d).where(F.col("event_type").isin("purchase", "error")))
    paid = F.col("event_type") == "purchase"
    return e.select(
        F.concat(F.lit("B"), "event_id").alias("doc_id"),
        F.col("user_id").alias("account_id"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("Electricity Bill Consumer No: "), F.lpad(F.col("user_id").cast("string"), 10, "0")),
            F.concat(F.lit("Bill Date: "), day(on)),
            F.concat(F.lit("Due Date: "), day(F.date_add(on, 15))),
            F.concat(F.lit("Units Consumed: "), F.format_string("%.2f", F.col("k").cast("double"))),
            F.concat(F.lit("Total Amount: "), F.format_string("%.2f", "value")),
            F.concat(F.lit("Status: "), F.when(paid, "paid").otherwise("outstanding")),
        ).alias("text"),
    )


def all_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document of every kind as (doc_id, doc_type, text)."""
    kinds = {
        "bank_statement": statements(spark, d),
        "salary_slip": slip_documents(spark, d),
        "utility_bill": bill_documents(spark, d),
        "unknown": prose(spark, d),
    }
    parts = [df.select("doc_id", F.lit(k).alias("doc_type"), "text") for k, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Typed schemas of the four JSON document kinds, all fields nullable.
JSON_SCHEMAS = {
    "salary": (
        "employee_name string, employee_id string, employer string, designation string, "
        "department string, salary_month string, salary_date string, gross_salary double, "
        "basic_salary double, hra double, other_allowances double, deductions double, "
        "pf_deduction double, professional_tax double, tds double, net_salary double, "
        "bank_account string, pan string"
    ),
    "bank": (
        "account_holder_name string, account_number string, ifsc_code string, bank_name string, "
        "branch string, statement_period struct<from:string,to:string>, opening_balance double, "
        "closing_balance double, transactions array<struct<date:string,description:string,"
        "debit:double,credit:double,balance:double,mode:string>>"
    ),
    "utility": (
        "consumer_name string, consumer_number string, service_address string, "
        "utility_type string, provider string, bill_number string, bill_date string, "
        "due_date string, billing_period struct<from:string,to:string>, amount_due double, "
        "previous_dues double, current_charges double, total_amount double, "
        "payment_status string, payment_date string"
    ),
    "bureau": (
        "bureau_name string, report_date string, consumer_name string, pan string, "
        "date_of_birth string, credit_score double, total_accounts int, active_accounts int, "
        "closed_accounts int, overdue_accounts int, total_outstanding double, "
        "total_credit_limit double, enquiries_last_6m int, enquiries_last_12m int, "
        "accounts array<struct<lender:string,account_type:string,account_number:string,"
        "opened_date:string,status:string,sanctioned_amount:double,current_balance:double,"
        "overdue_amount:double,emi_amount:double,dpd_current:double,dpd_history:string>>"
    ),
}


def parse_json(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Typed ``data`` struct; unreadable text is kept in ``bad_text`` for the reject table."""
    schema = JSON_SCHEMAS[kind] + ", _corrupt_record string"
    data = F.from_json(
        F.col(column), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    )
    return df.withColumn("data", data).withColumn("bad_text", F.col("data._corrupt_record"))


def slip_json(spark: SparkSession, d: str) -> DataFrame:
    """Slips as the raw answer of an extraction step: fenced, commented, with arithmetic."""
    gross, net = F.col("gross_salary"), F.col("net_salary")
    worked = F.concat(printed(gross), F.lit(" - "), printed(gross - net))
    return views.slips(spark, d).select(
        "account_id",
        F.concat(
            F.lit('```json\n{"employee_id": "'), "account_id", F.lit('", // id\n"gross_salary": '),
            printed(gross), F.lit(',\n"net_salary": '),
            F.when(F.col("pf").isNull(), printed(net)).otherwise(worked),
            F.lit(', /* as\nprinted */\n"pf_deduction": '),
            F.coalesce(printed("pf"), F.lit("null")), F.lit("\n}\n```"),
        ).alias("raw"),
    )


# Prompt texts by document type; the model itself is not part of this library.
PROMPT_SUBJECTS = {
    "salary_slip": ("salary slip", "salary"),
    "bank_statement": ("bank statement", "bank"),
    "utility_bill": ("utility bill", "utility"),
    "bureau_report": ("bureau report", "bureau"),
    "unknown": ("financial document", None),
}


def _prompt_head(doc_type: str) -> str:
    subject, schema = PROMPT_SUBJECTS[doc_type]
    fields = f" with the fields {JSON_SCHEMAS[schema]}" if schema else ""
    return (
        f"Read the {subject} below and answer with one JSON object{fields}. "
        "Copy numbers as printed, never calculate, use null for what is missing.\n\n"
    )


def extraction_prompt(doc_type: str | Column, text: str | Column) -> Column:
    """Prompt of the document's own type around its whole text."""
    head = F.lit(_prompt_head("unknown"))
    for kind in PROMPT_SUBJECTS:
        if kind != "unknown":
            head = F.when(col(doc_type) == kind, F.lit(_prompt_head(kind))).otherwise(head)
    return F.concat(head, col(text))


def repair_prompt(error: Column, broken: Column, doc_type: str | Column, text: str | Column) -> Column:
    """Prompt that asks for a corrected answer, given the parse error and the source text."""
    return F.concat(
        F.lit("This JSON could not be read: "), error, F.lit("\n\n"), broken,
        F.lit("\n\nCorrect it.\n"), extraction_prompt(doc_type, text),
    )


def explanation_prompt(score: Column, tier: Column, pd: Column, facts: Column, reasons: Column) -> Column:
    """Prompt that asks for one plain sentence per reason code."""
    return F.concat(
        F.lit("Explain this credit decision in plain words, one sentence per reason.\nScore: "),
        score.cast("string"), F.lit("\nTier: "), tier, F.lit("\nPD: "), pd.cast("string"),
        F.lit("\nFeatures: "), F.to_json(facts), F.lit("\nReasons: "), F.to_json(reasons),
    )


def prompt_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN '{k}' THEN {quote(_prompt_head(k))}" for k in PROMPT_SUBJECTS)
    return f"(CASE doc_type {whens} END) || text"


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Entity table read out of every document's text, as lists (doc_id, items); ``canonical.entity_rows`` unfolds them."""
    slips = extract.salary_fields(slip_documents(spark, d))
    gross, net, pf = F.col("gross_salary"), F.col("net_salary"), F.col("pf_contribution_flag")
    slip_rows = canonical.entity_lists(
        slips,
        ("gross_salary", None, F.when(pf, gross), 0),
        ("net_salary", None, net, 0),
        ("net_salary", None, gross, 1),
        ("total_deductions", None, rnd(gross - net, 2), 2),
        ("pf_contribution", None, F.when(pf, rnd(gross * 0.12, 2)), 3),
        ("pay_period", F.col("pay_period"), None, 0),
        ("employer_name", F.when(pf, F.lit("registered employer")), None, 4),
    )
    bills = extract.utility_fields(bill_documents(spark, d))
    paid = F.col("payment_discipline_flag")
    bill_rows = canonical.entity_lists(
        bills,
        ("bill_amount", None, F.col("bill_amount"), 0),
        ("bill_amount", None, F.col("units_consumed"), 2),
        ("due_date", F.col("due_date"), None, 1),
        ("payment_status", F.when(paid, "paid").otherwise("overdue"), None, 0),
        ("units_consumed", None, F.col("units_consumed"), 1),
        ("consumer_number", F.col("consumer_number"), None, 1),
    )
    line_items = lambda s, i: F.array(
        *[
            canonical.entity(name, raw, F.lit(None), 1.0 / (1 + i), i)
            for name, raw in (("transaction_description", s), ("transaction_date", find_date(s)))
        ]
    )
    items = F.flatten(F.transform(F.split("text", "\n"), line_items))
    present = F.filter(items, lambda i: i["raw_value"].isNotNull())
    prose_rows = computed_once(prose(spark, d), ["doc_id"], present.alias("items")).where(F.size("items") > 0)
    out = canonical.statement_entities(statements(spark, d).select("doc_id", "text"))
    for rows in (slip_rows, bill_rows, prose_rows):
        out = out.unionByName(rows)
    return out
