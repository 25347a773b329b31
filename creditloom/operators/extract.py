"""Documents to typed records: line facts, three competing extractors, arg-max, checks.

A document is one row, so everything about it is computed from an array of its
lines with higher-order functions.  No document is shuffled: the only operator
that multiplies rows is the transaction explode, and it is narrow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fields as X, vocab as V
from ..functions.columns import compact, computed_once, first_or_null, rnd, strings

# Diagnostics of the extractors.
NO_ROWS = "No date-anchored transaction rows detected."
NO_LINES = (
    "Unable to locate transaction lines. "
    "Possible causes: scanned image, non-standard layout, or wrong document type."
)
NET_ONLY_GROSS = "net_salary not explicitly found; gross_salary detected."
NO_SALARY = (
    "Unable to locate salary amount. "
    "Document may not be a salary slip, or keywords differ from known synonyms."
)
NO_BILL = (
    "Bill amount not detected. "
    "Possible causes: amount on image layer, non-standard label, or wrong document type."
)


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Document -> numbered lines."""
    return docs.select(
        *[c for c in docs.columns if c != text], F.posexplode(F.split(text, "\n")).alias("pos", "line")
    )


def line_facts(text: str = "text") -> Column:
    """Per line: its text, its lower-case text, first date, largest amount."""
    return F.transform(
        F.split(text, "\n"),
        lambda s: F.struct(
            s.alias("line"), F.lower(s).alias("low"), X.find_date(s).alias("date"),
            X.max_amount(s).alias("top"),
        ),
    )


def header_columns(text: str = "text") -> Column:
    """Offsets of the credit and debit columns in the first line that names both.

    Header lines are looked for among the first 40 lines only.
    """
    low = F.transform(F.slice(F.split(text, "\n"), 1, V.HEADER_SEARCH_LINES), F.lower)  # once a line, not once a word
    heads = F.transform(
        low,
        lambda s: F.struct(
            X.first_offset(s, V.HEADER_CREDIT).alias("credit_at"), X.first_offset(s, V.HEADER_DEBIT).alias("debit_at")
        ),
    )
    both = F.filter(heads, lambda h: h["credit_at"].isNotNull() & h["debit_at"].isNotNull())
    return first_or_null(both)


def transactions(docs: DataFrame, balance: str = "smallest") -> DataFrame:
    """Transaction rows of statement texts: lines with a date and at least one amount.

    With a header the line is cut at the right-hand amount column; without one,
    credit and debit words decide.  The balance is the smallest amount of the line
    (``balance="last_token"`` takes the last one instead).
    """
    rows = (
        computed_once(docs, ["doc_id", "text"], header_columns().alias("head"))
        .select("doc_id", "head", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .where(X.may_have_date("line"))
    )
    rows = computed_once(
        rows, ["doc_id", "head", "pos", "line"], X.find_date("line", tested=True).alias("date"), X.amounts("line").alias("amounts")
    ).where(F.col("date").isNotNull() & (F.size("amounts") > 0))
    line, top = F.col("line"), first_or_null(F.col("amounts"))
    credit_at, debit_at = F.col("head.credit_at"), F.col("head.debit_at")
    cut = F.greatest(credit_at, debit_at)
    left = X.max_amount(F.substring(line, F.lit(1), cut))
    right = X.max_amount(F.substring(line, cut + 1, F.length(line)))
    debit_left = debit_at < credit_at
    says_credit = F.upper(line).contains("CR") | X.has_any(F.lower(line), V.BANK_SYNONYMS["credit"])
    says_debit = F.upper(line).contains("DR") | X.has_any(F.lower(line), V.BANK_SYNONYMS["debit"])
    headed = F.col("head").isNotNull()
    credit = F.when(headed, F.when(debit_left, right).otherwise(left)).when(says_credit, top)
    debit = F.when(headed, F.when(debit_left, left).otherwise(right)).when(
        ~says_credit & (says_debit | (F.size("amounts") >= 2)), top
    )
    if balance == "last_token":
        hits = F.regexp_extract_all(line, F.lit(V.AMOUNT_PATTERN), F.lit(0))
        last = F.replace(F.try_element_at(hits, F.lit(-1)), F.lit(","), F.lit("")).try_cast("double")
    else:
        last = F.try_element_at("amounts", F.lit(-1))
    zero_is_null = lambda c: F.nullif(c, F.lit(0.0))
    return rows.select(
        "doc_id",
        "pos",
        "date",
        X.narration(line, F.col("date")).alias("narration"),
        zero_is_null(debit).alias("debit"),
        zero_is_null(credit).alias("credit"),
        zero_is_null(last).alias("closing_balance"),
    )


def typed_transactions(rows: DataFrame) -> DataFrame:
    """Debit and credit columns folded into amount and type; rows without a date go."""
    credit, debit = F.col("credit"), F.col("debit")
    return rows.dropna(subset=["date"]).select(
        "doc_id",
        "pos",
        "date",
        F.when(credit > 0, credit).otherwise(F.coalesce(debit, F.lit(0.0))).alias("amount"),
        F.when(credit > 0, "CR").when(debit > 0, "DR").alias("type"),
        "narration",
        "closing_balance",
    )


def _first_amount(facts: Column, named: Column, words: list[str]) -> Column:
    """Amount of the first line with a label and an amount; documents without a label are skipped."""
    hits = F.filter(facts, lambda f: f["top"].isNotNull() & (f["top"] != 0) & X.has_any(f["low"], words))
    return F.when(named, first_or_null(F.transform(hits, lambda f: f["top"])))


def _first_date(facts: Column, named: Column, words: list[str]) -> Column:
    hits = F.filter(facts, lambda f: f["date"].isNotNull() & X.has_any(f["low"], words))
    return F.when(named, first_or_null(F.transform(hits, lambda f: f["date"])))


def _labelled_number(facts: Column, named: Column, words: list[str], low: int, high: int) -> Column:
    """First ``low``..``high``-digit number on a line that carries one of the words."""
    pattern = rf"\b\d{{{low},{high}}}\b"
    hits = F.filter(facts, lambda f: f["line"].rlike(rf"\d{{{low}}}") & f["line"].rlike(pattern) & X.has_any(f["low"], words))
    return F.when(named, first_or_null(F.transform(hits, lambda f: F.regexp_extract(f["line"], pattern, 0))))


def _with_facts(docs: DataFrame, scan: X.WordScan) -> DataFrame:
    """Per document its line facts and which of the words it holds."""
    return computed_once(docs, ["doc_id"], line_facts().alias("facts"), scan.found(F.lower("text")).alias("held"))


_SAL, _UTL, _ACCOUNT = V.SALARY_SYNONYMS, V.UTILITY_SYNONYMS, V.BANK_SYNONYMS["account_number"]
SALARY_WORDS = X.WordScan(frozenset(w for k in _SAL for w in _SAL[k]))
UTILITY_WORDS = X.WordScan(frozenset(w for k in _UTL for w in _UTL[k]))
ALL_WORDS = X.WordScan(SALARY_WORDS.words | UTILITY_WORDS.words | {*_ACCOUNT, *V.BANK_SIGNALS, *V.UTILITY_SIGNALS})


def salary_fields(docs: DataFrame) -> DataFrame:
    """First amount behind each salary label, deduction flags and pay period."""
    d = _with_facts(docs, SALARY_WORDS)
    facts, words = F.col("facts"), V.SALARY_SYNONYMS
    named = lambda k: SALARY_WORDS.any(F.col("held"), words[k])
    return d.select(
        "doc_id",
        *[_first_amount(facts, named(k), words[k]).alias(k) for k in ("gross_salary", "net_salary", "basic_pay", "hra")],
        named("pf").alias("pf_contribution_flag"),
        named("tax").alias("tax_deduction_flag"),
        _first_date(facts, named("pay_period"), words["pay_period"]).alias("pay_period"),
    )


def utility_fields(docs: DataFrame) -> DataFrame:
    """Bill amount, due date, units, consumer number and the paid flag."""
    d = _with_facts(docs, UTILITY_WORDS)
    facts, words = F.col("facts"), V.UTILITY_SYNONYMS
    named = lambda k: UTILITY_WORDS.any(F.col("held"), words[k])
    return d.select(
        "doc_id",
        _first_amount(facts, named("bill_amount"), words["bill_amount"]).alias("bill_amount"),
        _first_date(facts, named("due_date"), words["due_date"]).alias("due_date"),
        _first_amount(facts, named("units_consumed"), words["units_consumed"]).alias("units_consumed"),
        _labelled_number(facts, named("consumer_number"), words["consumer_number"], 6, 15).alias("consumer_number"),
        named("payment_status").alias("payment_discipline_flag"),
    )


def hit_rates(found: Column, doc_type: str) -> tuple[Column, Column]:
    """(confidence, quality): 0.8 and 0.2 times the hit rates, and the overall hit rate."""
    required, optional = V.EXTRACTOR_ENTITIES[doc_type]
    n_req = F.size(F.array_intersect(found, strings(required)))
    n_opt = F.size(F.array_intersect(found, strings(optional)))
    confidence = n_req / len(required) * 0.8 + n_opt / len(optional) * 0.2
    return rnd(confidence, 3), rnd((n_req + n_opt) / (len(required) + len(optional)), 3)


def document_facts(docs: DataFrame) -> DataFrame:
    """What the three extractors look for, found in one pass over the lines of a document."""
    d = _with_facts(docs, ALL_WORDS)
    facts, held = F.col("facts"), F.col("held")
    sal, utl = V.SALARY_SYNONYMS, V.UTILITY_SYNONYMS
    holds = lambda words: ALL_WORDS.any(held, words)
    amount = lambda words: _first_amount(facts, holds(words), words)
    date = lambda words: _first_date(facts, holds(words), words)
    d = computed_once(
        d,
        ["doc_id"],
        F.size(F.filter(facts, lambda f: f["date"].isNotNull() & f["top"].isNotNull())).alias("n_rows"),
        _labelled_number(facts, holds(_ACCOUNT), _ACCOUNT, 9, 18).alias("account"),
        *[amount(sal[k]).alias(k) for k in ("gross_salary", "net_salary", "basic_pay", "hra")],
        holds(sal["pf"]).alias("pf"),
        date(sal["pay_period"]).alias("pay_period"),
        amount(utl["bill_amount"]).alias("bill_amount"),
        date(utl["due_date"]).alias("due_date"),
        amount(utl["units_consumed"]).alias("units_consumed"),
        _labelled_number(facts, holds(utl["consumer_number"]), utl["consumer_number"], 6, 15).alias("consumer_number"),
        holds(utl["payment_status"]).alias("payment_discipline_flag"),
        ALL_WORDS.count(held, V.BANK_SIGNALS).alias("bank_signals"),
        ALL_WORDS.count(held, V.UTILITY_SIGNALS).alias("utility_signals"),
        ALL_WORDS.count(held, sal["gross_salary"]).alias("gross_words"),
    )
    named = lambda ok, name: F.when(ok, F.lit(name))
    has = lambda name: named(F.col(name).isNotNull(), name)
    rows = F.col("n_rows") > 0
    return d.select(
        "*",
        (F.col("utility_signals") >= 2).alias("suppressed"),
        compact(
            named(rows, "transactions"), named(rows, "closing_balance"),
            named(F.col("account").isNotNull(), "account_number"),
        ).alias("bank_found"),
        compact(
            has("gross_salary"), has("net_salary"), has("basic_pay"), has("hra"),
            named(F.col("pf"), "pf"), has("pay_period"),
        ).alias("salary_found"),
        compact(
            has("bill_amount"), has("due_date"), has("units_consumed"), has("consumer_number"),
            F.lit("payment_discipline_flag"),
        ).alias("utility_found"),
    )


def plain_scores(facts: DataFrame) -> DataFrame:
    """Hit-rate confidence and quality of the three extractors, before boosts."""
    out = [facts["doc_id"], facts["n_rows"], facts["suppressed"], facts["gross_words"], facts["utility_signals"]]
    for kind in ("bank", "salary", "utility"):
        confidence, quality = hit_rates(F.col(f"{kind}_found"), kind.upper())
        out += [confidence.alias(f"{kind}_confidence"), quality.alias(f"{kind}_quality")]
    return facts.select(*out)


def extract_all(docs: DataFrame) -> DataFrame:
    """Run the three extractors on every document: one struct per document type."""
    return computed_once(
        document_facts(docs),
        ["doc_id", "n_rows", "gross_salary", "net_salary", "bill_amount", "due_date", "pay_period",
         "payment_discipline_flag"],
        _bank_result().alias("bank"), _salary_result().alias("salary"), _utility_result().alias("utility"),
    )


def _result(kind: str, confidence: Column, quality: Column, found: Column, missing: Column, notes: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("doc_type"), confidence.alias("confidence"), quality.alias("quality"),
        found.alias("found"), missing.alias("missing"), notes.alias("diagnostics"),
    )


def _bank_result() -> Column:
    base, quality = hit_rates(F.col("bank_found"), "BANK")
    many = F.col("n_rows") >= 5
    boosted = F.when(many & (F.col("bank_signals") >= 2), base + 0.15).when(many, base + 0.05).otherwise(base)
    no_rows = F.col("n_rows") == 0
    missing = compact(
        F.when(no_rows, F.lit("transactions")),
        F.when(F.col("account").isNull(), F.lit("account_number")),
    )
    notes = F.when(no_rows, strings([NO_ROWS, NO_LINES])).otherwise(F.array().cast("array<string>"))
    required, optional = V.EXTRACTOR_ENTITIES["BANK"]
    said = F.concat(
        F.lit("Suppressed BANK confidence: "), F.col("utility_signals"),
        F.lit(" utility-specific signals detected in document."),
    )
    dropped = _result(
        "BANK", F.lit(0.05), F.lit(0.0), F.array().cast("array<string>"), strings(required + optional), F.array(said)
    )
    kept = _result("BANK", F.least(F.lit(1.0), boosted), quality, F.col("bank_found"), missing, notes)
    return F.when(F.col("suppressed"), dropped).otherwise(kept)


def _salary_result() -> Column:
    base, quality = hit_rates(F.col("salary_found"), "SALARY")
    confidence = F.least(F.lit(1.0), F.when(F.col("gross_words") >= 2, base + 0.1).otherwise(base))
    no_net = F.col("net_salary").isNull()
    note = F.when(F.col("gross_salary").isNotNull(), NET_ONLY_GROSS).otherwise(NO_SALARY)
    return _result(
        "SALARY", confidence, quality, F.col("salary_found"),
        compact(F.when(no_net, F.lit("net_salary"))), compact(F.when(no_net, note)),
    )


def _utility_result() -> Column:
    base, quality = hit_rates(F.col("utility_found"), "UTILITY")
    n = F.col("utility_signals")
    confidence = F.least(F.lit(1.0), F.when(n >= 3, base + 0.40).when(n >= 1, base + 0.20).otherwise(base))
    no_bill = F.col("bill_amount").isNull()
    missing = compact(F.when(no_bill, F.lit("bill_amount")), F.when(F.col("due_date").isNull(), F.lit("due_date")))
    said = F.concat(F.lit("Utility classification boosted: "), n, F.lit(" utility-specific signals found."))
    return _result(
        "UTILITY", confidence, quality, F.col("utility_found"), missing,
        compact(F.when(no_bill, F.lit(NO_BILL)), F.when(n > 0, said)),
    )


def choose_best(extracted: DataFrame, threshold: float = V.MIN_EXTRACTOR_CONFIDENCE) -> DataFrame:
    """Most confident extractor; ties go to bank, then salary, then utility.

    Below the threshold the document is rejected with all diagnostics joined.
    """
    ranked = F.array_sort(
        F.array("bank", "salary", "utility"),
        lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0),
    )
    notes = F.concat("bank.diagnostics", "salary.diagnostics", "utility.diagnostics")
    best = F.element_at(ranked, 1)
    return extracted.withColumn("best", best).withColumn(
        "reject_reason",
        F.when(F.col("best.confidence") < threshold, F.array_join(notes, "; ")),
    )


def validate_best(chosen: DataFrame) -> DataFrame:
    """Four checks in order: type known, data present, data not empty, required columns."""
    kind, best = F.col("best.doc_type"), F.col("best")
    empty = (kind == "BANK") & (F.col("n_rows") == 0)
    reason = F.concat(
        F.lit("["), kind, F.lit("] Required financial entities missing: "),
        F.coalesce(F.nullif(F.array_join(best["missing"], ", "), F.lit("")), F.lit("unknown entities")),
        F.lit(". "), F.array_join(best["diagnostics"], "; "),
    )
    level = (
        F.when(F.col("reject_reason").isNotNull(), 1)
        .when(best.isNull(), 2)
        .when(empty, 3)
        .when((kind == "UTILITY") & F.col("payment_discipline_flag").isNull(), 4)
    )
    text = (
        F.when(level == 1, F.lit("Document classification failed: no extractor reached confidence threshold."))
        .when(level == 2, F.lit("Extraction produced no data structure."))
        .when(level == 3, reason)
        .when(level == 4, F.lit("[UTILITY] Could not determine utility payment discipline status."))
    )
    return chosen.withColumn("fail_level", level).withColumn("fail_reason", text)


def split_by_type(chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents of the expected type, documents of another type)."""
    fits = F.col("best.doc_type") == F.col("expected")
    return chosen.where(fits), chosen.where(~fits)
