"""Entity table -> canonical document -> three feature sets -> best one -> gate.

The entity table has (doc_id, entity, raw_value, numeric_value, confidence, pos),
as rows or as lists of items.  Sources give a list per line of a statement and per
other document.  One aggregation per document folds it into lists and best values; a
document is one statement page, slip or bill, so its lists are small.  All that
follows are expressions on that one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import compact, computed_once, ratio, rnd
from ..functions.fields import has_any
from ..functions.vocab import PAID_KEYWORDS
from . import extract as X

# Entity names by the way they are folded.
LIST_ENTITIES = {
    "credit_amount": "credit_amounts",
    "debit_amount": "debit_amounts",
    "running_balance": "running_balances",
}
TEXT_LISTS = {
    "transaction_date": "transaction_dates",
    "transaction_description": "transaction_descriptions",
}
BEST_NUMBERS = (
    "gross_salary", "net_salary", "pf_contribution", "tax_deduction", "total_deductions",
    "bill_amount", "units_consumed",
)
BEST_TEXTS = (
    "employee_name", "employer_name", "pay_period", "due_date", "payment_status",
    "billing_period", "consumer_number",
)
# Fixed values: (entity, diagnostic when it is missing), in report order.
BANK_NEEDS = (
    ("credit_amount", "Credit/deposit values not detected"),
    ("debit_amount", "Debit/withdrawal values not detected"),
    ("running_balance", "Running balance not detected"),
    ("transaction_date", "Transaction dates not detected"),
)
SALARY_NEEDS = (
    ("gross_salary", "Gross salary not detected"),
    ("net_salary", "Net/take-home salary not detected"),
    ("pay_period", "Pay period not detected"),
)
UTILITY_NEEDS = (
    ("bill_amount", "Bill/payable amount not detected"),
    ("due_date", "Due date not detected"),
    ("payment_status", "Payment status not detected"),
)
NO_FINANCE = "Document does not appear to contain financial information"
MIN_CONFIDENCE = 0.20
MIN_QUALITY = 0.25
REASONS_SHOWN, MISSING_SHOWN = 5, 3


def entity(name: str, raw: Column, number: Column, confidence: Column, pos: Column) -> Column:
    """One item of a document's list."""
    return F.struct(
        F.lit(name).alias("entity"), raw.cast("string").alias("raw_value"), number.cast("double").alias("numeric_value"),
        confidence.alias("confidence"), pos.alias("pos"),
    )


def statement_entities(statements: DataFrame) -> DataFrame:
    """Entities of statement texts as a list per line: amounts, balances, date and narration."""
    t = X.typed_transactions(X.transactions(statements))
    row = lambda name, raw, number: entity(name, raw, number, 1 / (1 + F.col("pos")), F.col("pos"))
    none = F.lit(None)
    items = compact(
        F.when(F.col("type") == "CR", row("credit_amount", F.col("amount"), F.col("amount"))),
        F.when(F.col("type") == "DR", row("debit_amount", F.col("amount"), F.col("amount"))),
        row("running_balance", F.col("closing_balance"), F.col("closing_balance")),
        row("transaction_date", F.col("date"), none),
        row("transaction_description", F.col("narration"), none),
    )
    return computed_once(t, ["doc_id"], items.alias("items"))


def entity_lists(df: DataFrame, *items: tuple[str, Column | None, Column | None, int]) -> DataFrame:
    """The present items (entity, raw, number, pos) of every input row as a list; rows without any are left out."""
    found = []
    for name, raw, value, pos in items:
        s = entity(name, raw if raw is not None else value, value if value is not None else F.lit(None), F.lit(1.0 / (1 + pos)), F.lit(pos))
        found.append(F.when(s["raw_value"].isNotNull(), s))
    return computed_once(df, ["doc_id"], compact(*found).alias("items")).where(F.size("items") > 0)


def entity_rows(lists: DataFrame) -> DataFrame:
    """The lists as rows of the entity table."""
    return lists.select("doc_id", F.inline("items"))


def canonical(entities: DataFrame) -> DataFrame:
    """One vendor-neutral row per document, from rows of the entity table or from lists of them."""
    if "items" not in entities.columns:
        item = F.struct("entity", "raw_value", "numeric_value", "confidence", "pos")
        entities = entities.select("doc_id", F.array(item).alias("items"))
    lists = computed_once(
        entities, ["doc_id", "items"], F.array_distinct(F.transform("items", lambda i: i["entity"])).alias("names")
    )

    def those(name: str, present=lambda i: F.lit(True)) -> Column:
        """The items of one name; lists without that name are not searched."""
        found = F.filter("items", lambda i: (i["entity"] == name) & present(i))
        return F.when(F.array_contains("names", name), found)

    def gathered(name: str, field: str, present) -> Column:
        pairs = F.transform(those(name, present), lambda i: F.struct(i["pos"].alias("pos"), i[field].alias("v")))
        return F.transform(F.array_sort(F.flatten(F.collect_list(pairs))), lambda i: i["v"])

    def best(name: str, *fields: str) -> Column:
        """The most confident item, of equal ones the first."""
        ranked = F.transform(
            those(name), lambda i: F.struct(i["confidence"].alias("c"), (-i["pos"]).alias("p"), F.struct(*[i[f].alias(f) for f in fields]).alias("v"))
        )
        return F.max(F.array_max(ranked))["v"]

    number = lambda i: i["numeric_value"].isNotNull()
    aggs = [gathered(e, "numeric_value", number).alias(c) for e, c in LIST_ENTITIES.items()]
    aggs += [gathered(e, "raw_value", lambda i: i["raw_value"] != "").alias(c) for e, c in TEXT_LISTS.items()]
    aggs += [F.max(F.array_max(F.transform(those(e, number), lambda i: i["confidence"]))).alias(f"c_{e}") for e in LIST_ENTITIES]
    aggs += [best(e, "numeric_value", "confidence").alias(e) for e in BEST_NUMBERS]
    aggs += [best(e, "raw_value").alias(e) for e in BEST_TEXTS]
    d = lists.groupBy("doc_id").agg(*aggs)
    entry = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
    confidences = F.map_from_entries(
        compact(
            *[entry(e, F.col(f"c_{e}")) for e in LIST_ENTITIES],
            *[entry(e, F.when(F.col(e)["numeric_value"].isNotNull(), F.col(e)["confidence"])) for e in BEST_NUMBERS],
        )
    )
    flat = d.select(
        "doc_id", *LIST_ENTITIES.values(), *TEXT_LISTS.values(),
        *[F.col(e)["numeric_value"].alias(e) for e in BEST_NUMBERS],
        *[F.nullif(F.col(e)["raw_value"], F.lit("")).alias(e) for e in BEST_TEXTS],
        confidences.alias("entity_confidences"),
    )
    return flat.withColumn("gross_salary", inferred_gross())


def inferred_gross() -> Column:
    """Gross salary, or net plus deductions where only those are known."""
    gross, net, cut = F.col("gross_salary"), F.col("net_salary"), F.col("total_deductions")
    return F.when(~given(gross) & given(net) & given(cut), net + cut).otherwise(gross)


def given(c: Column) -> Column:
    """Present and not zero."""
    return F.coalesce(c != 0, F.lit(False))


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def bank_feature_struct() -> Column:
    credits, debits, balances = F.col("credit_amounts"), F.col("debit_amounts"), F.col("running_balances")
    paid_in, paid_out = _total(credits), _total(debits)
    flow_ratio = F.when(paid_out > 0, F.try_divide(paid_in, paid_out)).when(paid_in > 0, 1.0).otherwise(0.0)
    zero = F.lit(0.0)
    net = F.zip_with(credits, debits, lambda a, b: F.coalesce(a, zero) - F.coalesce(b, zero))
    n = F.size(net)
    mean = F.try_divide(_total(net), n)
    spread = F.aggregate(
        net, F.struct(zero.alias("m"), zero.alias("s"), zero.alias("k")), _welford,
        lambda acc: F.sqrt(F.try_divide(acc["s"], acc["k"] - 1)),
    )
    cv = F.when(n < 2, 0.0).when(mean == 0, 1.0).otherwise(F.abs(F.try_divide(spread, mean)))
    parts = F.transform("transaction_dates", lambda x: F.split(x, "/"))
    months = F.array_distinct(
        F.transform(F.filter(parts, lambda p: F.size(p) == 3), lambda p: F.concat(p[1], F.lit("/"), p[2]))
    )
    n_months = F.greatest(F.size(months), F.lit(1))
    return F.struct(
        rnd(flow_ratio, 4).alias("credit_debit_ratio"),
        rnd(cv, 4).alias("cashflow_cv"),
        rnd(F.coalesce(F.try_divide(_total(balances), F.size(balances)), zero), 2).alias("average_monthly_balance"),
        rnd(F.coalesce(F.array_min(balances), zero), 2).alias("minimum_balance"),
        rnd(F.least(F.size(credits), n_months) / n_months, 4).alias("inflow_consistency"),
    )


def _welford(acc: Column, x: Column) -> Column:
    k = acc["k"] + 1
    step = x - acc["m"]
    m = acc["m"] + step / k
    return F.struct(m.alias("m"), (acc["s"] + step * (x - m)).alias("s"), k.alias("k"))


def salary_feature_struct() -> Column:
    """Gross and net swap places where net exceeds gross; the ratio stays in [0, 1]."""
    gross, net = F.col("gross_salary"), F.col("net_salary")
    swap = given(gross) & given(net) & (net > gross)
    zero = F.lit(0.0)
    g = F.coalesce(F.when(swap, net).otherwise(gross), zero)
    n = F.coalesce(F.when(swap, gross).otherwise(net), zero)
    share = F.when(g > 0, F.greatest(zero, F.least(F.lit(1.0), F.try_divide(n, g)))).otherwise(0.0)
    return F.struct(
        rnd(g, 2).alias("gross_salary"),
        rnd(n, 2).alias("net_salary"),
        rnd(share, 4).alias("net_to_gross_ratio"),
        F.when(F.col("pf_contribution") > 0, 1).otherwise(0).alias("pf_contribution_flag"),
        F.when(F.col("employer_name").isNotNull(), 1.0).otherwise(0.5).alias("employer_consistency"),
    )


def utility_feature_struct(word_boundary: bool = False) -> Column:
    """``word_boundary`` keeps "unpaid" from counting as paid."""
    status = F.lower(F.trim(F.coalesce("payment_status", F.lit(""))))
    if word_boundary:
        paid = status.rlike(r"\b(" + "|".join(PAID_KEYWORDS) + r")\b") & ~status.contains("not paid")
    else:
        paid = has_any(status, PAID_KEYWORDS)
    return F.struct(
        F.when(paid, 1).otherwise(0).alias("payment_discipline_flag"),
        F.when(paid, 1.0).otherwise(0.0).alias("utility_stability"),
        F.when(paid, 0).when(status.contains("overdue"), 30).otherwise(0).alias("payment_delay"),
        rnd(F.coalesce("bill_amount", F.lit(0.0)), 2).alias("average_bill"),
    )


def _found(needs, present: dict[str, Column], extra: dict[str, Column]) -> tuple[Column, Column, Column]:
    name = lambda ok, text: F.when(ok, F.lit(text))
    found = compact(
        *[name(present[e], e) for e, _ in needs], *[name(ok, e) for e, ok in extra.items()]
    )
    missing = compact(*[name(~present[e], e) for e, _ in needs])
    notes = compact(*[name(~present[e], note) for e, note in needs])
    return found, missing, notes


def evaluate(docs: DataFrame) -> DataFrame:
    """All three feature sets per canonical document, each with confidence and quality."""
    full = lambda c: F.size(c) > 0
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    as_double = lambda c: c.cast("double")
    there = {
        "credit_amount": full("credit_amounts"), "debit_amount": full("debit_amounts"),
        "running_balance": full("running_balances"), "transaction_date": full("transaction_dates"),
    }
    credit, debit, balance = there["credit_amount"], there["debit_amount"], there["running_balance"]
    b_found, b_missing, b_notes = _found(BANK_NEEDS, there, {})
    b_share = F.size(b_found) / len(BANK_NEEDS)
    few = F.size("credit_amounts") + F.size("debit_amounts") < 3
    b_conf = clamp(
        b_share + F.when(credit & debit, 0.1).otherwise(0.0) + F.when(balance, 0.1).otherwise(0.0)
        - F.when(few, 0.15).otherwise(0.0)
    )
    slip = {
        "gross_salary": given(F.col("gross_salary")), "net_salary": given(F.col("net_salary")),
        "pay_period": F.col("pay_period").isNotNull(),
    }
    employer = F.col("employer_name").isNotNull()
    s_found, s_missing, s_notes = _found(
        SALARY_NEEDS, slip,
        {"pf_contribution": F.coalesce(F.col("pf_contribution") > 0, F.lit(False)), "employer_name": employer},
    )
    earned = lambda name: F.when(slip[name] & (F.col(name) > 0), 0.45).otherwise(0.0)
    s_conf = F.least(
        F.lit(1.0),
        earned("gross_salary") + earned("net_salary")
        + F.when(slip["pay_period"], 0.05).otherwise(0.0) + F.when(employer, 0.05).otherwise(0.0),
    )
    bill = {
        "bill_amount": given(F.col("bill_amount")), "due_date": F.col("due_date").isNotNull(),
        "payment_status": F.trim(F.coalesce("payment_status", F.lit(""))) != "",
    }
    u_found, u_missing, u_notes = _found(UTILITY_NEEDS, bill, {"units_consumed": given(F.col("units_consumed"))})
    u_share = F.size(u_found) / len(UTILITY_NEEDS)
    u_conf = F.least(F.lit(1.0), F.when(bill["bill_amount"], u_share).otherwise(u_share * 0.3))
    required = lambda flags: sum((as_double(f.cast("int")) for f in flags.values()), F.lit(0.0)) / len(flags)

    def result(kind: str, conf: Column, quality: Column, found: Column, missing: Column, notes: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("doc_type"), conf.alias("confidence"), quality.alias("quality"),
            found.alias("found"), missing.alias("missing"), notes.alias("diagnostics"),
        )

    return docs.select(
        "doc_id",
        bank_feature_struct().alias("bank_features"),
        salary_feature_struct().alias("salary_features"),
        utility_feature_struct().alias("utility_features"),
        result("bank", b_conf, b_share, b_found, b_missing, b_notes).alias("bank"),
        result("salary", s_conf, required(slip), s_found, s_missing, s_notes).alias("salary"),
        result("utility", u_conf, required(bill), u_found, u_missing, u_notes).alias("utility"),
    )


def distinct_notes() -> Column:
    """Diagnostics of all three results, each once, in order."""
    return F.array_distinct(F.concat("bank.diagnostics", "salary.diagnostics", "utility.diagnostics"))


def choose(evaluated: DataFrame) -> DataFrame:
    """Best of three (ties: bank, salary, utility); rejected only if all are below the minimum."""
    b, s, u = (F.col(f"{k}.confidence") for k in ("bank", "salary", "utility"))
    best = F.when((b >= s) & (b >= u), F.col("bank")).when(s >= u, F.col("salary")).otherwise(F.col("utility"))
    reason = F.coalesce(
        F.nullif(F.array_join(F.slice(distinct_notes(), 1, REASONS_SHOWN), "; "), F.lit("")), F.lit(NO_FINANCE)
    )
    rejected = F.greatest(b, s, u) < MIN_CONFIDENCE
    return evaluated.withColumn("best", best).withColumn("rejected", rejected).withColumn(
        "rejection_reason", F.when(rejected, reason)
    )


def gate(chosen: DataFrame, zero_is_missing: bool = True) -> DataFrame:
    """Five levels: readable, entities, quality, required features, passed."""
    kind, best = F.col("best.doc_type"), F.col("best")
    lacks = (lambda c: ~given(c)) if zero_is_missing else (lambda c: c.isNull())
    need = {
        "bank": ("credit_debit_ratio", "average_monthly_balance"),
        "salary": ("gross_salary", "net_salary"),
        "utility": ("average_bill", "payment_discipline_flag"),
    }
    absent = F.array().cast("array<string>")
    for k, names in need.items():
        gaps = compact(*[F.when(lacks(F.col(f"{k}_features.{n}")), F.lit(n)) for n in names])
        absent = F.when(kind == k, gaps).otherwise(absent)
    level = (
        F.when(F.col("rejected"), 1)
        .when(F.size(best["found"]) == 0, 2)
        .when(best["quality"] < MIN_QUALITY, 3)
        .when(F.size(absent) > 0, 4)
        .otherwise(5)
    )
    reason = (
        F.when(level == 1, F.col("rejection_reason"))
        .when(level == 2, F.lit("No financial entities could be extracted from document text"))
        .when(
            level == 3,
            F.concat(
                F.lit("Insufficient financial data. Missing: "),
                F.array_join(F.slice(best["missing"], 1, MISSING_SHOWN), ", "),
            ),
        )
        .when(level == 4, F.concat(F.lit("Required features not computable: "), F.array_join(absent, ", ")))
    )
    return chosen.select(
        "*", level.alias("level_reached"), (level == 5).alias("passed"), reason.alias("failure_reason")
    )
