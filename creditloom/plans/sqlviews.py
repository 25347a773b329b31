"""The credit views again, as SQL text for the comparison engine."""

from __future__ import annotations


def r(expr: str, digits: int) -> str:
    """Half-up rounding by the same IEEE steps as ``functions.columns.rnd``."""
    return f"(floor(({expr})*1e{digits}+0.5)/1e{digits})"


def c(expr: str) -> str:
    return f"CAST(round(({expr})*100) AS BIGINT)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name] = (needs, body.strip())


def using(*names: str, sql: str) -> str:
    """The query behind a WITH list that holds the named views and all they need."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in VIEWS[n][0]:
            visit(m)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS (\n{VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{sql.strip()}"


view("ledger_lines", """
SELECT o_custkey AS account_id, o_orderkey AS txn_id, CAST(o_orderdate AS DATE) AS txn_date,
       o_totalprice AS amount,
       CASE WHEN o_orderstatus='F' OR (o_orderstatus='P' AND o_orderkey%2=0) THEN 'CR' ELSE 'DR' END AS txn_type,
       CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'SALARY CREDIT' WHEN '2' THEN 'EMI PAYMENT'
            WHEN '3' THEN 'NACH DEBIT' WHEN '4' THEN 'ATM CASH' WHEN '5' THEN 'UPI TRANSFER' END AS narration
FROM orders""")

view("ledger", f"""
SELECT l.*, ({c('c_acctbal')} + CAST(sum(CASE WHEN txn_type='CR' THEN {c('amount')} ELSE -{c('amount')} END)
        OVER (PARTITION BY account_id ORDER BY txn_date, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT))/100.0e0 AS closing_balance
FROM ledger_lines l JOIN customer ON c_custkey=account_id""", "ledger_lines")

SALARY_RE = "salary|sal|payroll|wages"
EMI_RE = "emi|loan|finance|home credit|bajaj|hdfc ergo|axis finance|ecs|nach"

view("bank_months", f"""
SELECT account_id, date_trunc('month', txn_date) AS month, CAST(sum({c('amount')}) AS BIGINT) AS flow,
       CAST(sum(CASE WHEN txn_type='CR' THEN {c('amount')} END) AS BIGINT) AS credit
FROM ledger GROUP BY ALL""", "ledger")

view("bank_month_stats", """
SELECT account_id, CAST(sum(credit) AS BIGINT) AS cr_sum, count(credit) AS cr_n, count(*) AS n,
       avg(flow) AS mean_flow, stddev_samp(flow) AS sd_flow
FROM bank_months GROUP BY account_id""", "bank_months")

view("bank_low", """
SELECT account_id, min(closing_balance) AS low FROM (
  SELECT *, max(txn_date) OVER (PARTITION BY account_id) AS latest FROM ledger)
WHERE txn_date >= latest - INTERVAL 3 MONTH GROUP BY account_id""", "ledger")

view("bank_totals", f"""
SELECT account_id,
   coalesce(CAST(sum(CASE WHEN txn_type='CR' THEN {c('amount')} END) AS BIGINT),0) AS cr,
   coalesce(CAST(sum(CASE WHEN txn_type='DR' THEN {c('amount')} END) AS BIGINT),0) AS dr,
   coalesce(CAST(sum(CASE WHEN txn_type='CR' AND regexp_matches(lower(narration),'{SALARY_RE}') THEN {c('amount')} END) AS BIGINT),0) AS sal,
   count(DISTINCT CASE WHEN regexp_matches(lower(narration),'{SALARY_RE}') THEN date_trunc('month',txn_date) END) AS sal_months,
   count(*) FILTER (WHERE regexp_matches(lower(narration),'{EMI_RE}')) AS n_emi
FROM ledger GROUP BY account_id""", "ledger")

view("bank", f"""
SELECT account_id,
  CASE WHEN cr_n=0 THEN 0e0 ELSE {r('cr_sum/cr_n',0)}/100e0 END AS mean_monthly_credit,
  CASE WHEN n<2 OR mean_flow=0 THEN 0e0 ELSE {r('sd_flow/mean_flow',4)} END AS cashflow_cv,
  {r('low',2)} AS min_balance_l3m,
  CASE WHEN dr=0 THEN 0e0 ELSE {r('cr/dr',4)} END AS credit_debit_ratio,
  sal_months>=3 AS salary_regularity_flag,
  n_emi>0 AS emi_detection_flag,
  CASE WHEN sal=0 THEN 0e0 ELSE {r('cr/sal',4)} END AS income_overstate_ratio
FROM bank_totals JOIN bank_month_stats USING(account_id) JOIN bank_low USING(account_id)""",
     "bank_totals", "bank_month_stats", "bank_low")

view("slips", f"""
SELECT o_custkey AS account_id, max(o_totalprice) AS gross_salary,
  {r('max(o_totalprice)*(1-3*(sum(disc)::BIGINT+sum(tax)::BIGINT)/(100*sum(n)::BIGINT))',2)} AS net_salary,
  CASE WHEN any_value(c_mktsegment) IN ('BUILDING','MACHINERY') THEN {r('max(o_totalprice)*0.12e0',2)} END AS pf,
  strftime(max(o_orderdate),'%d/%m/%Y') AS pay_period
FROM orders JOIN customer ON c_custkey=o_custkey AND c_custkey%10<>0
LEFT JOIN (SELECT l_orderkey, sum(CAST(round(l_discount*100) AS BIGINT)) AS disc,
      sum(CAST(round(l_tax*100) AS BIGINT)) AS tax, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey
GROUP BY o_custkey HAVING sum(n)>0""")

view("salary", f"""
SELECT account_id, CASE WHEN gross_salary=0 THEN 0e0 ELSE net_salary/gross_salary END AS net_to_gross_ratio,
  coalesce(pf,0)>0 AS pf_contribution_flag,
  CASE WHEN net_salary<=0 THEN 0e0 ELSE {r('gross_salary/net_salary',4)} END AS income_overstate_ratio,
  CASE WHEN net_salary>0 THEN 1 ELSE 0 END AS salary_consistency_score
FROM slips""", "slips")

view("ev", "SELECT *, CAST(json_extract(props,'$.k') AS INTEGER) AS k FROM events")

view("bills", """
SELECT user_id AS account_id, event_id AS bill_id, value AS bill_amount,
  CASE WHEN event_type='purchase' THEN CAST(ts AS DATE) END AS payment_date,
  CASE WHEN event_type='purchase' THEN 0 ELSE 1 END AS missed_payments, k%60 AS delay_days
FROM ev WHERE event_type IN ('purchase','error')""", "ev")

view("gap_stats", """
SELECT account_id, CASE WHEN count(gap)=0 THEN 0.5e0 ELSE 1/(1+CASE WHEN avg(gap)=0 THEN 0e0 ELSE stddev_samp(gap)/avg(gap) END) END AS time_consistency
FROM (SELECT account_id, date_diff('day', lag(payment_date) OVER (PARTITION BY account_id ORDER BY payment_date, bill_id), payment_date) AS gap
      FROM bills WHERE payment_date IS NOT NULL) GROUP BY account_id""", "bills")

view("utility", """
SELECT account_id, CASE WHEN avg(delay_days) IS NULL THEN 0.5e0 ELSE greatest(0e0,least(1e0,1-avg(delay_days)/30)) END AS payment_discipline_flag,
  CASE WHEN total IS NOT NULL THEN greatest(0e0,least(1e0, total/3)) END AS utility_stability
FROM (
  SELECT account_id, avg(delay_days) AS delay_days,
    1/(1+CASE WHEN avg(bill_amount)=0 THEN 0e0 ELSE stddev_samp(bill_amount)/avg(bill_amount) END) + 1-avg(missed_payments)
      + coalesce(max(time_consistency), 0.5e0) AS total
  FROM bills LEFT JOIN gap_stats USING(account_id) GROUP BY account_id)
GROUP BY account_id, total""", "bills", "gap_stats")

view("statement_lines", """
SELECT 'S' || account_id || '-' || page AS doc_id, * EXCLUDE (page, n_pages), row_number() OVER (PARTITION BY account_id, page ORDER BY txn_date, txn_id)-1 AS pos
FROM (SELECT *, CAST('0x'||substr(md5(CAST(txn_id AS VARCHAR)),1,8) AS BIGINT) % n_pages AS page FROM ledger_lines l JOIN (SELECT account_id, CAST(ceil(count(*)/200) AS BIGINT) AS n_pages FROM ledger_lines GROUP BY 1) USING(account_id))""",
     "ledger_lines")

view("statements", """
SELECT doc_id, account_id, 'Statement of Account - Branch NEFT UPI' || chr(10) || 'Account No: ' || lpad(CAST(account_id AS VARCHAR),12,'0') || chr(10) ||
  rpad('Date',11,' ') || rpad('Narration',20,' ') || rpad('Debit',15,' ') || 'Credit' || chr(10) ||
  string_agg(rpad(strftime(txn_date,'%d/%m/%Y'),11,' ') || rpad(narration,20,' ') ||
    rpad(CASE WHEN txn_type='DR' THEN printf('%.2f',amount) ELSE '' END,15,' ') || CASE WHEN txn_type='CR' THEN printf('%.2f',amount) ELSE '' END,
    chr(10) ORDER BY pos) AS text
FROM statement_lines GROUP BY doc_id, account_id""", "statement_lines")

view("slip_docs", f"""
SELECT 'P' || account_id AS doc_id, account_id, concat_ws(chr(10), 'Salary slip for the month of ' || pay_period,
  'PAN: ' || translate(substr(lpad(CAST(account_id AS VARCHAR),5,'0'),1,5),'0123456789','ABCDEFGHIJ') || lpad(CAST(account_id%10000 AS VARCHAR),4,'0') || 'K',
  'Gross Salary: ' || printf('%.2f',gross_salary), 'Basic Pay: ' || printf('%.2f',{r('gross_salary*0.5e0',2)}), 'HRA: ' || printf('%.2f',{r('gross_salary*0.2e0',2)}),
  'PF Deduction: ' || printf('%.2f',pf), 'Net Salary: ' || printf('%.2f',net_salary)) AS text
FROM slips""", "slips")

view("bill_docs", """
SELECT 'B' || event_id AS doc_id, user_id AS account_id, concat_ws(chr(10), 'Electricity Bill Consumer No: ' || lpad(CAST(user_id AS VARCHAR),10,'0'),
  'Bill Date: ' || strftime(CAST(ts AS DATE),'%d/%m/%Y'), 'Due Date: ' || strftime(CAST(ts AS DATE)+15,'%d/%m/%Y'),
  'Units Consumed: ' || printf('%.2f',k::DOUBLE), 'Total Amount: ' || printf('%.2f',value),
  'Status: ' || CASE WHEN event_type='purchase' THEN 'paid' ELSE 'outstanding' END) AS text, k, value, ts, event_type
FROM ev WHERE event_type IN ('purchase','error')""", "ev")
