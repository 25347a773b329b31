"""Queries over free text: clean-up chains and recognisers on whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, jsontext as J, text as T, vocab as V
from ..sources import documents as D, views
from . import sqltext as S
from .registry import query
from .sqlviews import r, using, view

CHAINS = {
    "txt_invisible": (T.drop_invisible, S.invisible("text")),
    "txt_ocr_fix": (T.fix_ocr, S.ocr_fix("text")),
    "txt_linebreaks": (T.unify_linebreaks, S.linebreaks("text")),
    "txt_spaces": (T.squeeze_spaces, S.spaces("text")),
    "txt_dates": (T.unify_dates, S.dates("text")),
    "txt_currency": (T.strip_currency, S.currency("text")),
    "txt_euro_decimal": (T.european_decimals, S.euro("text")),
    "txt_dehyphen": (T.join_hyphenated, S.dehyphen("text")),
    "txt_normalise_light": (T.normalise_light, S.light("text")),
    "txt_ocr_ws": (T.squeeze_ocr, S.strip(S.sub(S.sub("text", " +", " "), r"\n+", "\n"))),
    "txt_ascii": (T.ascii_only, S.strip(S.sub(S.sub("text", r"[^\x00-\x7F]+", " "), r"\n+", "\n"))),
}
for _name, (_step, _sql) in CHAINS.items():

    @query(_name, using("noisy", sql=f"SELECT src, id, {_sql} AS text FROM noisy"))
    def _clean(spark, d, step=_step):
        return D.noisy(spark, d).select("src", "id", step("text").alias("text"))


@query("txt_normalise", using("noisy", sql=f"""
SELECT src, id, {S.strip(S.dehyphen(S.euro('t')))} AS text FROM (
SELECT src, id, {S.currency('t')} AS t FROM (
SELECT src, id, {S.dates('t')} AS t FROM (
SELECT src, id, {S.spaces(S.linebreaks('t'))} AS t FROM (
SELECT src, id, {S.ocr_fix('t')} AS t FROM (SELECT src, id, {S.invisible('text')} AS t FROM noisy)))))"""))
def txt_normalise(spark, d):
    return D.noisy(spark, d).select("src", "id", T.normalise("text").alias("text"))


@query("amt_clean", using("ledger_lines", sql="""
SELECT txn_id, amount, CAST(txn_id AS DOUBLE) AS key_number FROM ledger_lines"""))
def amt_clean(spark, d):
    rows = views.ledger_lines(spark, d)
    return rows.select(
        "txn_id",
        fields.clean_amount(F.concat(F.lit("Rs "), F.format_number("amount", 2))).alias("amount"),
        fields.clean_amount(F.concat(F.lit("no-"), F.col("txn_id"))).alias("key_number"),
    )


@query("date_find", using("light", sql=f"SELECT src, id, {S.find_date('text')} AS found FROM light"))
def date_find(spark, d):
    return D.light(spark, d).select("src", "id", fields.find_date("text").alias("found"))


@query("amt_find_all", using("light", sql=f"""
SELECT src, id, generate_subscripts(a,1)-1 AS pos, unnest(a) AS amount FROM (SELECT src, id, {S.amounts('text')} AS a FROM light)"""))
def amt_find_all(spark, d):
    return D.light(spark, d).select("src", "id", F.posexplode(fields.amounts("text")).alias("pos", "amount"))


@query("amt_find_max", using("light", sql=f"SELECT src, id, {S.amounts('text')}[1] AS amount FROM light"))
def amt_find_max(spark, d):
    return D.light(spark, d).select("src", "id", fields.max_amount("text").alias("amount"))


WORD_LISTS = {
    "credit": V.BANK_SYNONYMS["credit"],
    "debit": V.BANK_SYNONYMS["debit"],
    "bank_signals": V.BANK_SIGNALS,
    "gross": V.SALARY_SYNONYMS["gross_salary"],
    "utility_signals": V.UTILITY_SIGNALS,
    "payment_status": V.UTILITY_SYNONYMS["payment_status"],
}


@query("kw_present", using("light", sql="SELECT src, id, " + ", ".join(
    f"{S.any_word('lower(text)', w)} AS {k}" for k, w in WORD_LISTS.items()) + " FROM light"))
def kw_present(spark, d):
    low = F.lower("text")
    return D.light(spark, d).select("src", "id", *[fields.has_any(low, w).alias(k) for k, w in WORD_LISTS.items()])


@query("kw_score", using("light", sql="SELECT src, id, " + ", ".join(
    f"{S.n_words('lower(text)', w)} AS {k}" for k, w in WORD_LISTS.items()) + " FROM light"))
def kw_score(spark, d):
    low = D.light(spark, d).withColumn("low", F.lower("text"))
    return low.select("src", "id", *[fields.count_words("low", w).alias(k) for k, w in WORD_LISTS.items()])


@query("id_pan", using("all_docs", sql=f"""
SELECT doc_id, coalesce(nullif(regexp_extract(text, '{V.PAN_PATTERN}'),''),'NOT_FOUND') AS pan FROM all_docs"""))
def id_pan(spark, d):
    return D.all_documents(spark, d).select("doc_id", fields.first_pan("text").alias("pan"))


@query("id_account", using("statements", "bill_docs", "document_docs", sql="""
SELECT doc_id, lpad(CAST(account_id AS VARCHAR),12,'0') AS account_number, CAST(NULL AS VARCHAR) AS consumer_number FROM statements
UNION ALL SELECT doc_id, CAST(NULL AS VARCHAR), lpad(CAST(account_id AS VARCHAR),10,'0') FROM bill_docs
UNION ALL SELECT doc_id, NULL, NULL FROM document_docs"""))
def id_account(spark, d):
    docs = (
        D.statements(spark, d).select("doc_id", "text")
        .unionByName(D.bill_documents(spark, d).select("doc_id", "text"))
        .unionByName(D.prose(spark, d))
    )
    find = fields.number_on_labelled_line
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id").startswith("B"), None)
        .otherwise(find("text", V.BANK_SYNONYMS["account_number"], 9, 18))
        .alias("account_number"),
        find("text", V.UTILITY_SYNONYMS["consumer_number"], 6, 15).alias("consumer_number"),
    )


@query("narr_clean", using("ledger_lines", sql="""
SELECT txn_id, narration FROM ledger_lines"""))
def narr_clean(spark, d):
    line = F.format_string("%s %s  %.2f", F.date_format("txn_date", "dd/MM/yyyy"), "narration", "amount")
    rows = views.ledger_lines(spark, d).select("txn_id", line.alias("line"))
    rows = rows.select("txn_id", "line", fields.find_date("line").alias("date"))
    return rows.select("txn_id", fields.narration(F.col("line"), F.col("date")).alias("narration"))


@query("date_parse_multi", using("ledger_lines", sql="""
SELECT txn_id, CASE WHEN txn_id%5=4 THEN NULL ELSE strftime(txn_date,'%Y-%m-%d') END AS parsed FROM ledger_lines"""))
def date_parse_multi(spark, d):
    shapes = ["dd/MM/yy", "d/M/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "yyyy/dd/MM"]
    style = F.col("txn_id") % 5
    raw = F.coalesce(*[F.when(style == i, F.date_format("txn_date", p)) for i, p in enumerate(shapes)])
    return views.ledger_lines(spark, d).select(
        "txn_id", F.date_format(fields.parse_date(raw), "yyyy-MM-dd").alias("parsed")
    )


MIXED = "CASE txn_id%4 WHEN 0 THEN '1,234.5' WHEN 1 THEN txn_type WHEN 2 THEN '  ' ELSE narration END"


def _mixed():
    k = F.col("txn_id") % 4
    return (
        F.when(k == 0, F.lit("1,234.5")).when(k == 1, F.col("txn_type")).when(k == 2, F.lit("  "))
        .otherwise(F.col("narration"))
    )


for _name, _test, _sql in (
    ("is_float", fields.is_float, "TRY_CAST(replace(v,',','') AS DOUBLE) IS NOT NULL"),
    ("is_crdr", fields.is_crdr, "upper(v) IN ('CR','DR')"),
    ("is_str", fields.is_text, "trim(v)<>''"),
):

    @query(_name, using("ledger_lines", sql=f"SELECT txn_id, v, {_sql} AS ok FROM (SELECT txn_id, {MIXED} AS v FROM ledger_lines)"))
    def _predicate(spark, d, test=_test):
        rows = views.ledger_lines(spark, d).select("txn_id", _mixed().alias("v"))
        return rows.select("txn_id", "v", test("v").alias("ok"))


# JSON text: every slip as the answer of an extraction step, with its usual defects.
view("slip_json", """
SELECT account_id, '```json' || chr(10) || '{"employee_id": "' || account_id || '", // id' || chr(10) ||
 '"gross_salary": ' || printf('%.2f', gross_salary) || ',' || chr(10) || '"net_salary": ' ||
 CASE WHEN pf IS NULL THEN printf('%.2f', net_salary) ELSE printf('%.2f', gross_salary) || ' - ' || printf('%.2f', gross_salary-net_salary) END ||
 ', /* as' || chr(10) || 'printed */' || chr(10) || '"pf_deduction": ' || coalesce(printf('%.2f', pf), 'null') || chr(10) || '}' || chr(10) || '```' AS raw
FROM slips""", "slips")
_FENCES = S.strip(S.sub(S.strip(S.sub("raw", "```(?:json)?")), "^`+|`+$"))
_COMMENTS = S.sub(S.sub("raw", r'(^|[^"\w])//.*', r"\1"), r"(?s)/\*.*?\*/")
_KEY = r"""^"\w+"\s*:\s*"""
_VALUE = f"substr(m, length(regexp_extract(m, {S.q(_KEY)}))+1)"
_SOUND = S.q("(?s)" + J.SOUND_VALUE)
_NULLED = S.zipped("raw", J.PAIR_PATTERN, f"""
CASE WHEN NOT regexp_matches({S.sub(f'trim({_VALUE})', ',+$')}, {_SOUND}) AND regexp_matches({S.sub(f'trim({_VALUE})', ',+$')}, {S.q(J.OPERATION)})
THEN regexp_extract(m, {S.q(_KEY)}) || ' null' || CASE WHEN suffix({S.sub(_VALUE, r'\s+$')}, ',') THEN ',' ELSE '' END ELSE m END""")
view("fenced", f"SELECT account_id, {_FENCES} AS raw FROM slip_json", "slip_json")
view("commented", f"SELECT account_id, {_COMMENTS} AS raw FROM fenced", "fenced")
view("nulled", f"SELECT account_id, {_NULLED} AS raw FROM commented", "commented")


@query("json_fences", using("fenced", sql="SELECT account_id, raw AS text FROM fenced"))
def json_fences(spark, d):
    return D.slip_json(spark, d).select("account_id", J.strip_fences("raw").alias("text"))


@query("json_comments", using("commented", sql="SELECT account_id, raw AS text FROM commented"))
def json_comments(spark, d):
    return D.slip_json(spark, d).select("account_id", J.strip_comments(J.strip_fences("raw")).alias("text"))


@query("json_arith_null", using("nulled", sql="SELECT account_id, raw AS text FROM nulled"))
def json_arith_null(spark, d):
    return D.slip_json(spark, d).select("account_id", J.clean("raw").alias("text"))


@query("json_arith_check", using("slip_json", "nulled", sql=f"""
SELECT account_id, regexp_matches({S.sub('s.raw', J.QUOTED, '""')}, {S.q(J.BARE_ARITHMETIC)}) AS before_repair,
  regexp_matches({S.sub('n.raw', J.QUOTED, '""')}, {S.q(J.BARE_ARITHMETIC)}) AS after_repair
FROM slip_json s JOIN nulled n USING(account_id)"""))
def json_arith_check(spark, d):
    return D.slip_json(spark, d).select(
        "account_id", J.has_arithmetic("raw").alias("before_repair"), J.has_arithmetic(J.clean("raw")).alias("after_repair")
    )


@query("json_clean_parse", using("slips", sql="""
SELECT account_id, true AS parsed, CAST(account_id AS VARCHAR) AS employee_id, gross_salary,
  CASE WHEN pf IS NULL THEN net_salary END AS net_salary, pf AS pf_deduction FROM slips
UNION ALL SELECT -1-event_id, k>=50, NULL, NULL, NULL, NULL FROM (SELECT event_id, CAST(json_extract(props,'$.k') AS INT) AS k FROM events)"""))
def json_clean_parse(spark, d):
    k = F.col("k")
    broken = views.events(spark, d).select(
        (-1 - F.col("event_id")).alias("account_id"),
        F.when(k >= 50, F.col("props")).otherwise(F.replace("props", F.lit("}"), F.lit(""))).alias("raw"),
    )
    texts = D.slip_json(spark, d).select("account_id", "raw").unionByName(broken)
    parsed = D.parse_json(texts.withColumn("clean", J.clean("raw")), "clean", "salary")
    return parsed.select(
        "account_id", F.col("bad_text").isNull().alias("parsed"),
        "data.employee_id", "data.gross_salary", "data.net_salary", "data.pf_deduction",
    )


@query("json_schema_typed", using("statement_lines", sql="""
SELECT doc_id, pos, strftime(txn_date,'%d/%m/%Y') AS date, narration AS description,
  CASE WHEN txn_type='DR' THEN amount END AS debit, CASE WHEN txn_type='CR' THEN amount END AS credit
FROM statement_lines"""))
def json_schema_typed(spark, d):
    parsed = D.parse_json(D.statement_json(spark, d), "raw", "bank")
    return parsed.select("doc_id", F.posexplode("data.transactions").alias("pos", "t")).select(
        "doc_id", "pos", "t.date", "t.description", "t.debit", "t.credit"
    )


@query("prompt_render", using("all_docs", sql=f"""
SELECT doc_id, {D.prompt_sql()} AS prompt FROM all_docs"""))
def prompt_render(spark, d):
    return D.all_documents(spark, d).select("doc_id", D.extraction_prompt("doc_type", "text").alias("prompt"))
