"""Queries that turn document text into lines, transactions, slips and bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.columns import rnd
from ..operators import extract as E
from ..sources import documents as D
from . import sqltext as S
from .registry import query
from .sqlviews import r, using, view

view("doc_lines", """
SELECT doc_id, generate_subscripts(ls,1)-1 AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM all_docs)""",
     "all_docs")


@query("tx_lines", using("doc_lines", sql="SELECT doc_id, pos, line FROM doc_lines"))
def tx_lines(spark, d):
    return E.lines(D.all_documents(spark, d).drop("doc_type"))


@query("limit_lines", using("doc_lines", sql="SELECT doc_id, pos, line FROM doc_lines WHERE pos < 40"))
def limit_lines(spark, d):
    return E.lines(D.all_documents(spark, d).drop("doc_type")).where(F.col("pos") < V.HEADER_SEARCH_LINES)


def _offset(words):
    return "least(" + ",".join(f"nullif(instr(lower(line), {S.q(w)}),0)" for w in words) + ")-1"


view("heads", f"""
SELECT doc_id, arg_min(credit_at, pos) AS credit_at, arg_min(debit_at, pos) AS debit_at FROM (
 SELECT doc_id, pos, {_offset(V.HEADER_CREDIT)} AS credit_at, {_offset(V.HEADER_DEBIT)} AS debit_at FROM doc_lines WHERE pos<40)
WHERE credit_at IS NOT NULL AND debit_at IS NOT NULL GROUP BY doc_id""", "doc_lines")


@query("tx_header_cols", using("heads", sql="SELECT * FROM heads"))
def tx_header_cols(spark, d):
    h = D.all_documents(spark, d).select("doc_id", E.header_columns().alias("h")).where(F.col("h").isNotNull())
    return h.select("doc_id", "h.credit_at", "h.debit_at")


# The ledger itself is the expected result of reading the rendered statements back.
@query("tx_bank_rows", using("statement_lines", sql="""
SELECT doc_id, pos+3 AS pos, strftime(txn_date,'%d/%m/%Y') AS date, narration,
  CASE WHEN txn_type='DR' THEN amount END AS debit, CASE WHEN txn_type='CR' THEN amount END AS credit, amount AS closing_balance
FROM statement_lines"""))
def tx_bank_rows(spark, d):
    return E.transactions(D.statements(spark, d))


@query("tx_bank_df", using("statement_lines", sql="""
SELECT doc_id, pos+3 AS pos, strftime(txn_date,'%d/%m/%Y') AS date, amount, txn_type AS type, narration, amount AS closing_balance
FROM statement_lines"""))
def tx_bank_df(spark, d):
    return E.typed_transactions(E.transactions(D.statements(spark, d)))


@query("tx_salary", using("slips", sql=f"""
SELECT 'P'||account_id AS doc_id, gross_salary, net_salary, {r('gross_salary*0.5e0',2)} AS basic_pay, {r('gross_salary*0.2e0',2)} AS hra,
  pf IS NOT NULL AS pf_contribution_flag, false AS tax_deduction_flag, pay_period FROM slips"""))
def tx_salary(spark, d):
    return E.salary_fields(D.slip_documents(spark, d))


@query("tx_utility", using("bill_docs", sql="""
SELECT doc_id, nullif(value,0) AS bill_amount, strftime(CAST(ts AS DATE)+15,'%d/%m/%Y') AS due_date, nullif(k::DOUBLE,0) AS units_consumed,
  lpad(CAST(account_id AS VARCHAR),10,'0') AS consumer_number, event_type='purchase' AS payment_discipline_flag FROM bill_docs"""))
def tx_utility(spark, d):
    return E.utility_fields(D.bill_documents(spark, d))


def _when_line(words, extra):
    return f"({S.any_word('low', words)} AND {extra})"


def _first(value, words, extra):
    return f"arg_min({value}, pos) FILTER (WHERE {_when_line(words, extra)})"


_SAL, _UTL = V.SALARY_SYNONYMS, V.UTILITY_SYNONYMS
view("line_facts", f"""
SELECT doc_id, pos, line, lower(line) AS low, {S.find_date('line')} AS date, {S.amounts('line')}[1] AS top FROM doc_lines""", "doc_lines")
view("doc_facts", f"""
SELECT doc_id, count(*) FILTER (WHERE date IS NOT NULL AND top IS NOT NULL) AS n_rows,
  bool_or({S.any_word('low', V.BANK_SYNONYMS['account_number'])} AND regexp_matches(line, '\\b\\d{{9,18}}\\b')) AS acct,
  {', '.join(f"{_first('top', _SAL[k], 'top<>0')} AS {k}" for k in ('gross_salary', 'net_salary', 'basic_pay', 'hra'))},
  {_first('date', _SAL['pay_period'], 'date IS NOT NULL')} AS pay_period,
  bool_or({S.any_word('low', _SAL['pf'])}) AS pf,
  {_first('top', _UTL['bill_amount'], 'top<>0')} AS bill_amount,
  {_first('date', _UTL['due_date'], 'date IS NOT NULL')} AS due_date,
  {_first('top', _UTL['units_consumed'], 'top<>0')} AS units,
  bool_or({S.any_word('low', _UTL['consumer_number'])} AND regexp_matches(line, '\\b\\d{{6,15}}\\b')) AS consumer
FROM line_facts GROUP BY doc_id""", "line_facts")
view("doc_signals", f"""
SELECT doc_id, {S.n_words('lower(text)', V.BANK_SIGNALS)} AS bank_signals, {S.n_words('lower(text)', V.UTILITY_SIGNALS)} AS utility_signals,
  {S.n_words('lower(text)', _SAL['gross_salary'])} AS gross_words FROM all_docs""", "all_docs")
view("raw_scores", f"""
SELECT doc_id, n_rows, bank_signals, utility_signals, gross_words, utility_signals>=2 AS suppressed, bill_amount, due_date, net_salary, gross_salary, acct,
  {r("(CASE WHEN n_rows>0 THEN 1e0 ELSE 0e0 END)*0.8e0+acct::INT/3e0*0.2e0",3)} AS bank_base,
  {r("((n_rows>0)::INT*2+acct::INT)/5e0",3)} AS bank_q,
  {r("(net_salary IS NOT NULL)::INT*0.8e0+n_opt/7e0*0.2e0",3)} AS salary_base,
  {r("((net_salary IS NOT NULL)::INT+n_opt)/8e0",3)} AS salary_q,
  {r("((bill_amount IS NOT NULL)::INT+1)/2e0*0.8e0+n_bill/4e0*0.2e0",3)} AS utility_base,
  {r("((bill_amount IS NOT NULL)::INT+1+n_bill)/6e0",3)} AS utility_q
FROM (SELECT *, (gross_salary IS NOT NULL)::INT+(basic_pay IS NOT NULL)::INT+(hra IS NOT NULL)::INT+pf::INT+(pay_period IS NOT NULL)::INT AS n_opt,
  (due_date IS NOT NULL)::INT+(units IS NOT NULL)::INT+consumer::INT AS n_bill FROM doc_facts JOIN doc_signals USING(doc_id))""",
     "doc_facts", "doc_signals")
view("scores3", """
SELECT *, CASE WHEN suppressed THEN 0.05e0 ELSE least(1e0, bank_base + CASE WHEN n_rows>=5 AND bank_signals>=2 THEN 0.15e0 WHEN n_rows>=5 THEN 0.05e0 ELSE 0e0 END) END AS bank_c,
  CASE WHEN suppressed THEN 0e0 ELSE bank_q END AS bank_quality,
  least(1e0, salary_base + CASE WHEN gross_words>=2 THEN 0.1e0 ELSE 0e0 END) AS salary_c,
  least(1e0, utility_base + CASE WHEN utility_signals>=3 THEN 0.4e0 WHEN utility_signals>=1 THEN 0.2e0 ELSE 0e0 END) AS utility_c
FROM raw_scores""", "raw_scores")


@query("tx_score", using("raw_scores", sql="""
SELECT doc_id, bank_base AS bank_confidence, bank_q AS bank_quality, salary_base AS salary_confidence, salary_q AS salary_quality,
  utility_base AS utility_confidence, utility_q AS utility_quality FROM raw_scores"""))
def tx_score(spark, d):
    s = E.plain_scores(E.document_facts(D.all_documents(spark, d)))
    return s.select(
        "doc_id", *[f"{k}_{v}" for k in ("bank", "salary", "utility") for v in ("confidence", "quality")]
    )


def _scores(spark, d):
    return E.extract_all(D.all_documents(spark, d))


@query("tx_boost", using("scores3", sql=f"""
SELECT doc_id, {r('bank_c',4)} AS bank_confidence, {r('salary_c',4)} AS salary_confidence, {r('utility_c',4)} AS utility_confidence FROM scores3"""))
def tx_boost(spark, d):
    return _scores(spark, d).select(
        "doc_id", *[rnd(F.col(f"{k}.confidence"), 4).alias(f"{k}_confidence") for k in ("bank", "salary", "utility")]
    )


@query("tx_suppress", using("scores3", sql="""
SELECT doc_id, bank_c AS confidence, 'Suppressed BANK confidence: ' || utility_signals || ' utility-specific signals detected in document.' AS note
FROM scores3 WHERE suppressed"""))
def tx_suppress(spark, d):
    s = _scores(spark, d).where(F.try_element_at("bank.diagnostics", F.lit(1)).startswith("Suppressed"))
    return s.select("doc_id", "bank.confidence", F.try_element_at("bank.diagnostics", F.lit(1)).alias("note"))


view("winners", f"""
SELECT doc_id, n_rows, CASE WHEN bank_c>=salary_c AND bank_c>=utility_c THEN 'BANK' WHEN salary_c>=utility_c THEN 'SALARY' ELSE 'UTILITY' END AS doc_type,
  greatest(bank_c, salary_c, utility_c) AS confidence,
  CASE WHEN bank_c>=salary_c AND bank_c>=utility_c THEN bank_quality WHEN salary_c>=utility_c THEN salary_q ELSE utility_q END AS quality
FROM scores3""", "scores3")


@query("tx_argmax", using("winners", sql=f"""
SELECT doc_id, doc_type, {r('confidence',4)} AS confidence, quality, confidence<0.25e0 AS rejected FROM winners"""))
def tx_argmax(spark, d):
    best = E.choose_best(_scores(spark, d))
    return best.select(
        "doc_id", "best.doc_type", rnd(F.col("best.confidence"), 4).alias("confidence"), "best.quality",
        F.col("reject_reason").isNotNull().alias("rejected"),
    )


@query("tx_validate4", using("winners", sql="""
SELECT doc_id, doc_type, CASE WHEN confidence<0.25e0 THEN 1 WHEN doc_type='BANK' AND n_rows=0 THEN 3 ELSE 0 END AS fail_level,
  NOT (confidence<0.25e0 OR (doc_type='BANK' AND n_rows=0)) AS passed FROM winners"""))
def tx_validate4(spark, d):
    v = E.validate_best(E.choose_best(_scores(spark, d)))
    return v.select("doc_id", "best.doc_type", F.coalesce("fail_level", F.lit(0)).alias("fail_level"), F.col("fail_reason").isNull().alias("passed"))


@query("expect_doc_type", using("winners", sql="""
SELECT doc_id, CASE substr(doc_id,1,1) WHEN 'S' THEN 'BANK' WHEN 'P' THEN 'SALARY' WHEN 'B' THEN 'UTILITY' ELSE 'BANK' END AS expected, doc_type,
  doc_type=CASE substr(doc_id,1,1) WHEN 'S' THEN 'BANK' WHEN 'P' THEN 'SALARY' WHEN 'B' THEN 'UTILITY' ELSE 'BANK' END AS accepted FROM winners"""))
def expect_doc_type(spark, d):
    first = F.substring("doc_id", 1, 1)
    expected = F.when(first == "P", "SALARY").when(first == "B", "UTILITY").otherwise("BANK")
    best = E.choose_best(_scores(spark, d)).withColumn("expected", expected)
    kept, refused = E.split_by_type(best)
    shape = lambda df, ok: df.select("doc_id", "expected", "best.doc_type", F.lit(ok).alias("accepted"))
    return shape(kept, True).unionByName(shape(refused, False))
