"""Queries over the entity table and the canonical documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import canonical as C
from ..sources import documents as D
from . import sqltext as S
from .registry import query
from .sqlviews import r, using, view

# The expected canonical rows come from the ledger, slips and bills, not from the text.
view("c_bank", """
SELECT doc_id, list(amount ORDER BY pos) FILTER (WHERE txn_type='CR') AS credits, list(amount ORDER BY pos) FILTER (WHERE txn_type='DR') AS debits,
  list(amount ORDER BY pos) AS balances, list(strftime(txn_date,'%d/%m/%Y') ORDER BY pos) AS dates, list(narration ORDER BY pos) AS words,
  count(DISTINCT date_trunc('month',txn_date)) AS months, max(CASE WHEN txn_type='CR' THEN 1e0/(4+pos) END) AS c_credit FROM statement_lines GROUP BY doc_id""",
     "statement_lines")
view("c_slip", f"""
SELECT 'P'||account_id AS doc_id, CASE WHEN pf IS NULL THEN net_salary+{r('gross_salary-net_salary',2)} ELSE gross_salary END AS gross, net_salary AS net,
  CASE WHEN pf IS NOT NULL THEN {r('gross_salary*0.12e0',2)} END AS pf, pay_period, CASE WHEN pf IS NOT NULL THEN 'registered employer' END AS employer,
  CASE WHEN pf IS NOT NULL THEN gross_salary END AS printed_gross FROM slips""", "slips")
view("c_bill", """
SELECT doc_id, coalesce(nullif(value,0), nullif(k::DOUBLE,0)) AS bill, strftime(CAST(ts AS DATE)+15,'%d/%m/%Y') AS due, nullif(k::DOUBLE,0) AS units,
  CASE WHEN event_type='purchase' THEN 'paid' ELSE 'overdue' END AS status FROM bill_docs""", "bill_docs")
view("c_prose", f"""
SELECT doc_id, list(line ORDER BY i) FILTER (WHERE line<>'') AS words, list(date ORDER BY i) FILTER (WHERE date IS NOT NULL) AS dates,
  count(DISTINCT string_split(date,'/')[2]||'/'||string_split(date,'/')[3]) FILTER (WHERE len(string_split(date,'/'))=3) AS months
FROM (SELECT *, {S.find_date('line')} AS date FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1) AS i FROM document_docs))
GROUP BY doc_id""", "document_docs")


def _money(arr):
    return F.array_join(F.transform(arr, lambda x: F.format_string("%.2f", x)), ",")


@query("cm_collect", using("c_bank", "c_slip", "c_bill", "c_prose", sql="""
SELECT doc_id, coalesce(array_to_string(list_transform(credits, lambda x: printf('%.2f',x)),','),'') AS credits,
 coalesce(array_to_string(list_transform(debits, lambda x: printf('%.2f',x)),','),'') AS debits,
 array_to_string(list_transform(balances, lambda x: printf('%.2f',x)),',') AS balances, array_to_string(dates,',') AS dates, array_to_string(words,',') AS words,
 floor(coalesce(c_credit,0)*1e6+0.5)/1e6 AS credit_confidence FROM c_bank
UNION ALL SELECT doc_id,'','','','','',0e0 FROM c_slip UNION ALL SELECT doc_id,'','','','','',0e0 FROM c_bill
UNION ALL SELECT doc_id,'','','',coalesce(array_to_string(dates,','),''),coalesce(array_to_string(words,','),''),0e0 FROM c_prose WHERE words IS NOT NULL OR dates IS NOT NULL"""))
def cm_collect(spark, d):
    said = F.filter("items", lambda i: i["raw_value"] != "").alias("items")
    c = C.canonical(D.entities(spark, d).select("doc_id", said).where(F.size("items") > 0))
    return c.select(
        "doc_id", _money("credit_amounts").alias("credits"), _money("debit_amounts").alias("debits"),
        _money("running_balances").alias("balances"), F.array_join("transaction_dates", ",").alias("dates"),
        F.array_join("transaction_descriptions", ",").alias("words"),
        rnd(F.coalesce(F.try_element_at("entity_confidences", F.lit("credit_amount")), F.lit(0.0)), 6).alias("credit_confidence"),
    )


view("canon", f"""
SELECT doc_id, credits, debits, balances, dates, months, NULL::DOUBLE AS gross, NULL::DOUBLE AS net, NULL::DOUBLE AS pf, NULL AS pay_period, NULL AS employer,
  NULL::DOUBLE AS bill, NULL AS due, NULL::DOUBLE AS units, NULL AS status FROM c_bank
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 0, gross, net, pf, pay_period, employer, NULL, NULL, NULL, NULL FROM c_slip
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, 0, NULL, NULL, NULL, NULL, NULL, bill, due, units, status FROM c_bill
UNION ALL SELECT doc_id, NULL, NULL, NULL, dates, months,
  NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM c_prose""", "c_bank", "c_slip", "c_bill", "c_prose")


def _canon(spark, d):
    return C.canonical(D.entities(spark, d))


@query("cm_best", using("canon", sql=f"""
SELECT doc_id, {r('gross',2)} AS gross_salary, net AS net_salary, pf AS pf_contribution, pay_period, employer AS employer_name, bill AS bill_amount,
  due AS due_date, units AS units_consumed, status AS payment_status FROM canon"""))
def cm_best(spark, d):
    return _canon(spark, d).select(
        "doc_id", rnd(F.col("gross_salary"), 2).alias("gross_salary"), "net_salary", "pf_contribution", "pay_period",
        "employer_name", "bill_amount", "due_date", "units_consumed", "payment_status",
    )


@query("cm_infer_gross", using("c_slip", sql=f"SELECT doc_id, {r('gross',2)} AS gross_salary FROM c_slip"))
def cm_infer_gross(spark, d):
    return _canon(spark, d).where(F.col("net_salary").isNotNull()).select(
        "doc_id", rnd(F.col("gross_salary"), 2).alias("gross_salary")
    )


def _lens(a):
    return f"coalesce(len({a}),0)"


view("fxb", f"""
SELECT *, coalesce(list_sum(credits),0e0) AS tc, coalesce(list_sum(debits),0e0) AS td,
  list_transform(range(1, greatest({_lens('credits')},{_lens('debits')})+1), lambda i: coalesce(credits[i],0e0)-coalesce(debits[i],0e0)) AS net_flow,
  {_lens('credits')} AS n_c, {_lens('debits')} AS n_d, {_lens('balances')} AS n_b, {_lens('dates')} AS n_t FROM canon""", "canon")


@query("fx_bank", using("fxb", sql=f"""
SELECT doc_id, {r('CASE WHEN td>0 THEN tc/td WHEN tc>0 THEN 1e0 ELSE 0e0 END',4)} AS credit_debit_ratio,
  {r("CASE WHEN len(net_flow)<2 THEN 0e0 WHEN list_sum(net_flow)=0 THEN 1e0 ELSE abs(list_aggregate(net_flow,'stddev_samp')/list_avg(net_flow)) END",4)} AS cashflow_cv,
  {r('coalesce(list_sum(balances)/len(balances),0e0)',2)} AS average_monthly_balance, {r('coalesce(list_min(balances),0e0)',2)} AS minimum_balance,
  {r('CASE WHEN n_c=0 THEN 0e0 ELSE least(n_c, greatest(months,1))/greatest(months,1) END',4)} AS inflow_consistency FROM fxb"""))
def fx_bank(spark, d):
    return C.evaluate(_canon(spark, d)).select("doc_id", "bank_features.*")


@query("fx_salary", using("canon", sql=f"""
SELECT doc_id, {r('g',2)} AS gross_salary, {r('n',2)} AS net_salary, {r('CASE WHEN g>0 THEN greatest(0e0,least(1e0,n/g)) ELSE 0e0 END',4)} AS net_to_gross_ratio,
  CASE WHEN pf>0 THEN 1 ELSE 0 END AS pf_contribution_flag, CASE WHEN employer IS NOT NULL THEN 1e0 ELSE 0.5e0 END AS employer_consistency
FROM (SELECT *, coalesce(CASE WHEN net>gross AND gross<>0 THEN net ELSE gross END,0e0) AS g, coalesce(CASE WHEN net>gross AND gross<>0 THEN gross ELSE net END,0e0) AS n FROM canon)"""))
def fx_salary(spark, d):
    return C.evaluate(_canon(spark, d)).select("doc_id", "salary_features.*")


@query("fx_utility", using("canon", sql="""
SELECT doc_id, CASE WHEN status='paid' THEN 1 ELSE 0 END AS payment_discipline_flag, CASE WHEN status='paid' THEN 1e0 ELSE 0e0 END AS utility_stability,
  CASE WHEN status='overdue' THEN 30 ELSE 0 END AS payment_delay, coalesce(bill,0e0) AS average_bill FROM canon"""))
def fx_utility(spark, d):
    return C.evaluate(_canon(spark, d)).select("doc_id", "utility_features.*")


view("fxc", """
SELECT *, greatest(0e0,least(1e0, bq + CASE WHEN n_c>0 AND n_d>0 THEN 0.1e0 ELSE 0e0 END + CASE WHEN n_b>0 THEN 0.1e0 ELSE 0e0 END - CASE WHEN n_c+n_d<3 THEN 0.15e0 ELSE 0e0 END)) AS bc,
  least(1e0, CASE WHEN gross<>0 THEN 0.45e0 ELSE 0e0 END+CASE WHEN net<>0 THEN 0.45e0 ELSE 0e0 END+CASE WHEN pay_period IS NOT NULL THEN 0.05e0 ELSE 0e0 END+CASE WHEN employer IS NOT NULL THEN 0.05e0 ELSE 0e0 END) AS sc,
  (coalesce(gross<>0,false)::INT+coalesce(net<>0,false)::INT+(pay_period IS NOT NULL)::INT)/3e0 AS sq,
  least(1e0, CASE WHEN coalesce(bill,0)<>0 THEN uf/3e0 ELSE uf/3e0*0.3e0 END) AS uc,
  (coalesce(bill<>0,false)::INT+(due IS NOT NULL)::INT+(status IS NOT NULL)::INT)/3e0 AS uq
FROM (SELECT *, ((n_c>0)::INT+(n_d>0)::INT+(n_b>0)::INT+(n_t>0)::INT)/4e0 AS bq,
  coalesce(bill<>0,false)::INT+(due IS NOT NULL)::INT+(status IS NOT NULL)::INT+coalesce(units<>0,false)::INT AS uf FROM fxb)""", "fxb")


@query("fx_confidence", using("fxc", sql=f"""
SELECT doc_id, {r('bc',4)} AS bank, {r('sc',4)} AS salary, {r('uc',4)} AS utility FROM fxc"""))
def fx_confidence(spark, d):
    e = C.evaluate(_canon(spark, d))
    return e.select("doc_id", *[rnd(F.col(f"{k}.confidence"), 4).alias(k) for k in ("bank", "salary", "utility")])


_NOTES = {
    "n_c=0": C.BANK_NEEDS[0][1], "n_d=0": C.BANK_NEEDS[1][1], "n_b=0": C.BANK_NEEDS[2][1], "n_t=0": C.BANK_NEEDS[3][1],
    "coalesce(gross,0)=0": C.SALARY_NEEDS[0][1], "coalesce(net,0)=0": C.SALARY_NEEDS[1][1], "pay_period IS NULL": C.SALARY_NEEDS[2][1],
    "coalesce(bill,0)=0": C.UTILITY_NEEDS[0][1], "due IS NULL": C.UTILITY_NEEDS[1][1], "status IS NULL": C.UTILITY_NEEDS[2][1],
}
_ALL_NOTES = "list_filter([" + ",".join(f"CASE WHEN {k} THEN {S.q(v)} END" for k, v in _NOTES.items()) + "], lambda x: x IS NOT NULL)"
view("fxe", f"""
SELECT *, CASE WHEN bc>=sc AND bc>=uc THEN 'bank' WHEN sc>=uc THEN 'salary' ELSE 'utility' END AS doc_type, greatest(bc,sc,uc) AS conf,
  CASE WHEN bc>=sc AND bc>=uc THEN bq WHEN sc>=uc THEN sq ELSE uq END AS quality, greatest(bc,sc,uc)<0.2e0 AS rejected, {_ALL_NOTES} AS notes FROM fxc""", "fxc")


@query("set_distinct", using("fxe", sql="SELECT doc_id, array_to_string(notes,'; ') AS notes FROM fxe"))
def set_distinct(spark, d):
    return C.evaluate(_canon(spark, d)).select("doc_id", F.array_join(C.distinct_notes(), "; ").alias("notes"))


@query("fx_evaluate", using("fxe", sql=f"""
SELECT doc_id, doc_type, {r('conf',4)} AS confidence, rejected, CASE WHEN rejected THEN array_to_string(notes[1:5],'; ') END AS rejection_reason FROM fxe"""))
def fx_evaluate(spark, d):
    c = C.choose(C.evaluate(_canon(spark, d)))
    return c.select(
        "doc_id", "best.doc_type", rnd(F.col("best.confidence"), 4).alias("confidence"), "rejected", "rejection_reason"
    )


view("gated", """
SELECT *, CASE WHEN doc_type='bank' THEN CASE WHEN n_c=0 THEN 'credit_debit_ratio' ELSE '' END
   WHEN doc_type='salary' THEN concat_ws(', ', CASE WHEN coalesce(gross,0)=0 THEN 'gross_salary' END, CASE WHEN coalesce(net,0)=0 THEN 'net_salary' END)
   ELSE concat_ws(', ', CASE WHEN coalesce(bill,0)=0 THEN 'average_bill' END, CASE WHEN coalesce(status,'')<>'paid' THEN 'payment_discipline_flag' END) END AS absent
FROM fxe""", "fxe")


@query("fx_gate5", using("gated", sql="""
SELECT doc_id, lvl AS level_reached, lvl=5 AS passed, CASE WHEN lvl=1 THEN array_to_string(notes[1:5],'; ') WHEN lvl=4 THEN 'Required features not computable: '||absent END AS failure_reason
FROM (SELECT *, CASE WHEN rejected THEN 1 WHEN quality<0.25e0 THEN 3 WHEN absent<>'' THEN 4 ELSE 5 END AS lvl FROM gated)"""))
def fx_gate5(spark, d):
    g = C.gate(C.choose(C.evaluate(_canon(spark, d))))
    return g.select("doc_id", "level_reached", "passed", "failure_reason")



@query("limit_missing", using("fxe", sql="""
SELECT doc_id, array_to_string(list_filter([CASE WHEN n_c=0 THEN 'credit_amount' END, CASE WHEN n_d=0 THEN 'debit_amount' END,
  CASE WHEN n_b=0 THEN 'running_balance' END, CASE WHEN n_t=0 THEN 'transaction_date' END], lambda x: x IS NOT NULL)[1:3], ', ') AS shown FROM fxe"""))
def limit_missing(spark, d):
    e = C.evaluate(_canon(spark, d))
    return e.select("doc_id", F.array_join(F.slice("bank.missing", 1, C.MISSING_SHOWN), ", ").alias("shown"))
