"""Queries for row quality, rules, consent, evaluation, routing, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.columns import rnd
from ..operators import assembly as A, consent as C, evaluation as E, quality as Q, routing as R, rules as U
from ..sources import applicants as P, documents as D, files, views
from ..sources.tables import table
from . import sqlscore, sqltext as S  # noqa: F401  (registers the SQL views)
from .registry import query
from .sqlviews import r, using, view


# Ledger rows as strings, with the defects a scanned statement shows.
view("raw_rows", """
SELECT txn_id, CASE txn_id%6 WHEN 0 THEN '' WHEN 1 THEN 'soon' ELSE strftime(txn_date,'%d/%m/%Y') END AS date,
  CASE txn_id%7 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE printf('%.2f',amount) END AS amount, CASE txn_id%5 WHEN 0 THEN 'XX' ELSE lower(txn_type) END AS type,
  CASE txn_id%4 WHEN 0 THEN '  ' ELSE narration END AS narration, CASE txn_id%3 WHEN 0 THEN NULL ELSE printf('%.2f',closing_balance) END AS closing_balance FROM ledger""",
     "ledger")


def _raw(spark, d):
    k = F.col("txn_id")
    return views.ledger(spark, d).select(
        "txn_id",
        F.when(k % 6 == 0, "").when(k % 6 == 1, "soon").otherwise(F.date_format("txn_date", "dd/MM/yyyy")).alias("date"),
        F.when(k % 7 == 0, "n/a").when(k % 7 == 1, F.lit(None)).otherwise(D.printed("amount")).alias("amount"),
        F.when(k % 5 == 0, "XX").otherwise(F.lower("txn_type")).alias("type"),
        F.when(k % 4 == 0, "  ").otherwise(F.col("narration")).alias("narration"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(D.printed("closing_balance")).alias("closing_balance"),
    )


view("field_scores", """
SELECT txn_id, 'date' AS field, CASE WHEN date='' THEN 0e0 WHEN date='soon' THEN 0.6e0 ELSE 1e0 END AS score, CASE WHEN date='' THEN 'date missing' WHEN date='soon' THEN 'date invalid date' END AS issue, 1 AS o FROM raw_rows
UNION ALL SELECT txn_id, 'amount', CASE WHEN amount IS NULL THEN 0e0 WHEN amount='n/a' THEN 0.5e0 ELSE 1e0 END, CASE WHEN amount IS NULL THEN 'amount missing' WHEN amount='n/a' THEN 'amount not numeric' END, 2 FROM raw_rows
UNION ALL SELECT txn_id, 'type', CASE WHEN type='XX' THEN 0.6e0 ELSE 1e0 END, CASE WHEN type='XX' THEN 'type must be CR/DR' END, 3 FROM raw_rows
UNION ALL SELECT txn_id, 'narration', CASE WHEN trim(narration)='' THEN 0e0 ELSE 1e0 END, CASE WHEN trim(narration)='' THEN 'narration missing' END, 4 FROM raw_rows
UNION ALL SELECT txn_id, 'closing_balance', CASE WHEN closing_balance IS NULL THEN 0.8e0 ELSE 1e0 END, NULL, 5 FROM raw_rows""", "raw_rows")


@query("dq_field", using("field_scores", sql="SELECT txn_id, field, score, issue FROM field_scores"))
def dq_field(spark, d):
    return Q.field_scores(_raw(spark, d), "bank", "txn_id")


@query("dq_rows", using("field_scores", sql=f"""
SELECT txn_id, conf AS confidence_score, issues, conf<0.6e0 AS review_required FROM (
 SELECT txn_id, {r('list_sum(list(score ORDER BY o))/5',4)} AS conf, coalesce(string_agg(issue,'; ' ORDER BY o),'') AS issues FROM field_scores GROUP BY txn_id)"""))
def dq_rows(spark, d):
    return Q.check_rows(_raw(spark, d), "bank").select("txn_id", "confidence_score", "issues", "review_required")


@query("dq_rules", using("field_scores", "slips", "bills", sql=f"""
SELECT 'bank' AS source, count(*) AS n, {r('avg(conf)',4)} AS mean_confidence, count(*) FILTER (WHERE conf<0.6e0) AS to_review FROM (SELECT {r('list_sum(list(score ORDER BY o))/5',4)} AS conf FROM field_scores GROUP BY txn_id)
UNION ALL SELECT 'salary', count(*), {r('avg(conf)',4)}, count(*) FILTER (WHERE conf<0.6e0) FROM (SELECT {r("(2e0+CASE WHEN pf IS NULL THEN 0.8e0 ELSE 1e0 END)/3",4)} AS conf FROM slips)
UNION ALL SELECT 'utility', count(*), 1e0, 0 FROM bills"""))
def dq_rules(spark, d):
    parts = {"bank": _raw(spark, d), "salary": views.slips(spark, d), "utility": views.bills(spark, d)}
    sums = [
        Q.check_rows(df, k).agg(
            F.lit(k).alias("source"), F.count(F.lit(1)).alias("n"), rnd(F.avg("confidence_score"), 4).alias("mean_confidence"),
            F.count_if("review_required").alias("to_review"),
        )
        for k, df in parts.items()
    ]
    return sums[0].unionByName(sums[1]).unionByName(sums[2])


# Rules.
RISK = """(CASE WHEN expenses>income*0.7e0 THEN 0.3e0 ELSE 0e0 END+CASE WHEN credit_score<600 THEN 0.4e0 WHEN credit_score<700 THEN 0.2e0 ELSE 0e0 END
 +CASE WHEN existing_loans>3 THEN 0.3e0 WHEN existing_loans>1 THEN 0.1e0 ELSE 0e0 END)"""


@query("rule_risk", using("applicants", sql=f"SELECT account_id, {r(RISK,2)} AS risk FROM applicants"))
def rule_risk(spark, d):
    return P.applicants(spark, d).select("account_id", U.risk_points().alias("risk"))


@query("rule_reasons", using("applicants", sql="""
SELECT account_id, concat_ws('; ', CASE WHEN expenses>income*0.7e0 THEN 'High expense to income ratio' END, CASE WHEN credit_score<600 THEN 'Low credit score' WHEN credit_score<700 THEN 'Moderate credit score' END,
 CASE WHEN existing_loans>1 THEN 'Multiple existing loans' END) AS reasons FROM applicants"""))
def rule_reasons(spark, d):
    return P.applicants(spark, d).select("account_id", F.array_join(U.risk_reasons(), "; ").alias("reasons"))


@query("rule_fraud_zero", using("applicants", sql="SELECT account_id, CASE WHEN income=0 OR credit_score=0 THEN 'High' ELSE 'Low' END AS fraud FROM applicants"))
def rule_fraud_zero(spark, d):
    return P.applicants(spark, d).select("account_id", U.zero_check().alias("fraud"))


@query("rule_stacking", using("fraud_in", sql="""
SELECT account_id, loan_count_30d>3 AS fraud_flag, CASE WHEN loan_count_30d>3 THEN 0.9e0 ELSE 0.1e0 END AS fraud_score, CASE WHEN loan_count_30d>3 THEN 'loan_stacking' ELSE '' END AS reasons FROM fraud_in"""))
def rule_stacking(spark, d):
    flag, score, reasons = U.loan_stacking(F.col("loan_count_30d"))
    return P.fraud_inputs(spark, d).select(
        "account_id", flag.alias("fraud_flag"), score.alias("fraud_score"), F.array_join(reasons, ",").alias("reasons")
    )


def _fraud(spark, d):
    return P.fraud_inputs(spark, d).withColumn("guess", U.fraud_votes())


@query("rule_fraud4", using("fraud_out", sql="SELECT account_id, loan_count_30d, avg_loan_amount, income, location_match, employment_stability, guess FROM fraud_out"))
def rule_fraud4(spark, d):
    return _fraud(spark, d).select(
        "account_id", "loan_count_30d", "avg_loan_amount", "income", "location_match", "employment_stability", "guess"
    )


def behaviour(spark, d):
    return P.behaviour_inputs(spark, d).withColumn("guess", U.behaviour_votes())


@query("rule_behaviour", using("behave_out", sql="SELECT account_id, variance_income, bill_delay_days, job_changes, guess FROM behave_out"))
def rule_behaviour(spark, d):
    return behaviour(spark, d).select("account_id", "variance_income", "bill_delay_days", "job_changes", "guess")


# Evaluation.
CONFUSION = """count(*) FILTER (WHERE label=1 AND guess=1) AS tp, count(*) FILTER (WHERE label=0 AND guess=0) AS tn, count(*) FILTER (WHERE label=0 AND guess=1) AS fp, count(*) FILTER (WHERE label=1 AND guess=0) AS fn"""
PRF = f"""{r('(tp+tn)/(tp+tn+fp+fn)',3)} AS accuracy, CASE WHEN tp+fp=0 THEN 0e0 ELSE {r('tp/(tp+fp)',3)} END AS precision,
 CASE WHEN tp+fn=0 THEN 0e0 ELSE {r('tp/(tp+fn)',3)} END AS recall, CASE WHEN 2*tp+fp+fn=0 THEN 0e0 ELSE {r('2*tp/(2*tp+fp+fn)',3)} END AS f1"""
BOTH = "(SELECT 'fraud' AS rule, label, guess FROM fraud_out UNION ALL SELECT 'behaviour', label, guess FROM behave_out)"


def _judged(spark, d):
    a = _fraud(spark, d).select(F.lit("fraud").alias("rule"), "label", "guess")
    return a.unionByName(behaviour(spark, d).select(F.lit("behaviour").alias("rule"), "label", "guess"))


@query("eval_confusion", using("fraud_out", "behave_out", sql=f"SELECT rule, {CONFUSION} FROM {BOTH} GROUP BY rule"))
def eval_confusion(spark, d):
    return E.confusion(_judged(spark, d), "label", "guess", "rule")


@query("eval_prf", using("fraud_out", "behave_out", sql=f"SELECT rule, {PRF} FROM (SELECT rule, {CONFUSION} FROM {BOTH} GROUP BY rule)"))
def eval_prf(spark, d):
    return E.precision_recall(E.confusion(_judged(spark, d), "label", "guess", "rule"))


@query("eval_thresholds", using("train", sql=f"""
SELECT threshold, {PRF} FROM (SELECT t::DOUBLE AS threshold, {CONFUSION} FROM (SELECT t, y AS label, CASE WHEN p>t THEN 1 ELSE 0 END AS guess FROM train, (VALUES (0.5e0),(0.6e0),(0.7e0)) x(t)) GROUP BY t)"""))
def eval_thresholds(spark, d):
    from .model_plans import _train

    return E.at_thresholds(_train(spark, d), "default", "p", (0.5, 0.6, 0.7))


@query("eval_errors", using("fraud_out", sql="""
SELECT account_id, c_name, loan_count_30d, income, CASE WHEN label=0 THEN 'false positive' ELSE 'false negative' END AS error FROM fraud_out WHERE label<>guess"""))
def eval_errors(spark, d):
    return E.errors(_fraud(spark, d), "label", "guess").select("account_id", "c_name", "loan_count_30d", "income", "error")


def _pairs(spark, d):
    ids = P.identity_pairs(spark, d)
    return ids.select("image_name", "truth").join(ids.select("image_name", "folder", "predicted"), "image_name", "inner")


@query("jn_eval", using("ids", sql="SELECT image_name, truth, folder, predicted FROM ids"))
def jn_eval(spark, d):
    return _pairs(spark, d)


@query("eval_field_acc", using("ids", sql=f"SELECT count(*) AS n, {r('avg((truth=predicted)::INT)',4)} AS field_accuracy FROM ids"))
def eval_field_acc(spark, d):
    same = (F.col("truth") == F.col("predicted")).cast("int")
    return _pairs(spark, d).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(same), 4).alias("field_accuracy"))


CHARS = "(list_sum(list_transform(range(1, least(length(truth),length(predicted))+1), lambda i: (truth[i]=predicted[i])::INT))/greatest(length(truth),length(predicted)))"


@query("eval_char_acc", using("ids", sql=f"SELECT folder, count(*) AS n, {r(f'avg({CHARS})',4)} AS char_accuracy FROM ids GROUP BY folder"))
def eval_char_acc(spark, d):
    acc = E.same_chars("truth", "predicted")
    return _pairs(spark, d).groupBy("folder").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(acc), 4).alias("char_accuracy"))


@query("eval_tamper", using("ids", sql=f"""
SELECT {r('avg((label=guess)::INT)',4)} AS accuracy, CASE WHEN count(*) FILTER (WHERE guess)=0 THEN 0e0 ELSE {r('count(*) FILTER (WHERE guess AND label)/count(*) FILTER (WHERE guess)',4)} END AS precision
FROM (SELECT folder='tampered' AS label, truth<>predicted AS guess FROM ids)"""))
def eval_tamper(spark, d):
    label = F.when(F.col("folder") == "tampered", "tampered").otherwise("clean")
    j = _pairs(spark, d).select(label.alias("label"), E.tamper_guess("truth", "predicted").alias("guess"))
    said, hit = F.count_if(F.col("guess") == "tampered"), F.count_if((F.col("guess") == "tampered") & (F.col("label") == "tampered"))
    return j.agg(
        rnd(F.avg((F.col("label") == F.col("guess")).cast("int")), 4).alias("accuracy"),
        F.when(said == 0, 0.0).otherwise(rnd(F.try_divide(hit, said), 4)).alias("precision"),
    )


# Filters and labels on order status.
@query("flt_isin", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F','O')")
def flt_isin(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return o.where(F.col("o_orderstatus").isin("F", "O"))


@query("prj_target", "SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 0 ELSE 1 END AS target FROM orders WHERE o_orderstatus IN ('F','O')")
def prj_target(spark, d):
    return flt_isin(spark, d).select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("target"))


@query("clean_nonfinite", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax=0 THEN NULL ELSE l_discount/l_tax END AS ratio FROM lineitem""")
def clean_nonfinite(spark, d):
    t, x = F.col("l_tax"), F.col("l_discount")
    inf = F.when(x == 0, float("nan")).when(F.col("l_linenumber") % 2 == 0, float("-inf")).otherwise(float("inf"))
    raw = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(t == 0, inf).otherwise(F.try_divide(x, t)).alias("ratio")
    )
    return A.clean_nonfinite(raw)


# Consent.
view("sessions", """
SELECT event_id AS session_id, user_id AS borrower_id, ts AS created_at, (k&2)>0 AS salary, (k&4)>0 AS utility, ((k&1)>0 OR (k&2)>0) AND ((k&8)>0 OR (k&1)>0) AS opened
FROM ev WHERE event_type='signup'""", "ev")
view("matched", """
SELECT u.*, s.session_id, s.salary, s.utility FROM (SELECT event_id AS upload_id, user_id AS borrower_id, ts, ['bank','salary','utility'][k%3+1] AS doc_type FROM ev WHERE event_type IN ('purchase','click','view')) u
LEFT JOIN sessions s ON s.opened AND s.borrower_id=u.borrower_id AND s.created_at<=u.ts AND u.ts<=s.created_at+INTERVAL 60 MINUTE
QUALIFY row_number() OVER (PARTITION BY upload_id ORDER BY s.created_at DESC NULLS LAST, s.session_id DESC)=1""", "ev", "sessions")
view("verdicts", """
SELECT *, CASE WHEN session_id IS NULL THEN 401 WHEN (doc_type='salary' AND NOT salary) OR (doc_type='utility' AND NOT utility) THEN 403 ELSE 200 END AS status FROM matched""", "matched")


CONSENT_SQL = using("verdicts", sql="""
SELECT upload_id, borrower_id, doc_type, CAST(session_id AS VARCHAR) AS session_id, status, CASE status WHEN 401 THEN 'Invalid session' WHEN 403 THEN upper(doc_type[1])||doc_type[2:]||' consent required' END AS reason FROM verdicts""")


@query("jn_consent", CONSENT_SQL)
def jn_consent(spark, d):
    m = C.match_uploads(views.uploads(spark, d), views.consents(spark, d))
    return m.select(
        "upload_id", "borrower_id", "doc_type", F.col("session.session_id").cast("string").alias("session_id"), "status", "reason"
    )


# Routing and text sources.
@query("route_pages", f"""
SELECT conv_id, turn, n_pages, {r('chars_per_page',4)} AS chars_per_page, CASE WHEN chars_per_page>=50 THEN 'native' ELSE 'ocr' END AS method, length(text) AS chars FROM conversations
JOIN (SELECT conv_id, count(*) AS n_pages, avg(length(text)) AS chars_per_page FROM conversations GROUP BY 1) USING(conv_id)""")
def route_pages(spark, d):
    p = R.route_pages(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "text")
    return p.select(
        "conv_id", "turn", "n_pages", rnd(F.col("chars_per_page"), 4).alias("chars_per_page"), "method",
        F.length("text").cast("bigint").alias("chars"),
    )


LEN = f"length({S.strip('text')})"


@query("route_min_chars", using("noisy", sql=f"""
SELECT src, id, {LEN} AS chars, {LEN}<50 AS needs_next, {LEN}>100 AS ocr_accepts, {LEN}=0 AS rejected, CASE WHEN {LEN}>=50 THEN text ELSE {S.light('text')} END AS text FROM noisy"""))
def route_min_chars(spark, d):
    from ..functions.text import normalise_light

    t = F.col("text")
    return D.noisy(spark, d).select(
        "src", "id", *[c.alias(k) for k, c in R.length_cascade(t).items()],
        R.first_long_enough(t, normalise_light(t)).alias("text"),
    )


@query("src_csv", using("ids", sql="SELECT image_name, folder, predicted AS predicted_pan FROM ids"))
def src_csv(spark, d):
    """Predictions written as CSV with a header, scanned back with an explicit schema."""
    path = files.fresh_dir(spark, "predictions")
    files.write_csv(P.identity_pairs(spark, d).select("image_name", "folder", F.col("predicted").alias("predicted_pan")), path)
    return files.read_csv(spark, path, files.CSV_SCHEMAS["predictions"])


@query("sink_csv", using("fraud_out", sql="SELECT account_id, label, guess FROM fraud_out"))
def sink_csv(spark, d):
    path = files.fresh_dir(spark, "guesses")
    files.write_csv(_fraud(spark, d).select("account_id", "label", "guess"), path)
    return files.read_csv(spark, path, "account_id bigint, label int, guess int")


@query("sink_records", using("ledger_lines", sql="SELECT txn_id, account_id, strftime(txn_date,'%Y-%m-%d') AS txn_date, amount, txn_type, narration FROM ledger_lines"))
def sink_records(spark, d):
    path = files.fresh_dir(spark, "records")
    rows = views.ledger_lines(spark, d).withColumn("txn_date", F.date_format("txn_date", "yyyy-MM-dd"))
    files.write_records(rows, path)
    return spark.read.schema("txn_id bigint, account_id bigint, txn_date string, amount double, txn_type string, narration string").json(path)


@query("sink_artifacts", using("scored", sql=f"SELECT account_id, {r('pd',6)} AS pd, risk_score FROM scored"))
def sink_artifacts(spark, d):
    """The scorecard saved, loaded again and applied."""
    from ..operators.scoring import score_batch

    folder = files.fresh_dir(spark, "scorecard")
    files.save_scorecard(spark, P.fixed_card(), folder)
    scored = score_batch(P.features(spark, d), files.load_scorecard(spark, folder))
    return scored.select("account_id", rnd(F.col("pd"), 6).alias("pd"), "risk_score")


@query("src_text", """
SELECT lang, CASE WHEN source=(SELECT min(source) FROM documents) THEN '.gz' ELSE '.txt' END AS suffix, source<>(SELECT min(source) FROM documents) AS supported,
  sum(1+length(text)-length(replace(text,chr(10),'')))::BIGINT AS n_lines, sum(length(replace(text,chr(10),'')))::BIGINT AS n_chars FROM documents GROUP BY ALL""")
def src_text(spark, d):
    """Documents as text files by language, read back as lines; one source arrives with an unsupported suffix."""
    docs = table(spark, d, "documents").select("lang", "source", "text")
    first = docs.agg(F.min("source")).first()[0]
    good, odd = files.fresh_dir(spark, "texts"), files.fresh_dir(spark, "packed")
    docs.where(F.col("source") != first).select("text", "lang").write.partitionBy("lang").text(good)
    docs.where(F.col("source") == first).select("text", "lang").write.partitionBy("lang").option("compression", "gzip").text(odd)
    kept, rejected = R.split_by_support(files.read_text_lines(spark, good).unionByName(files.read_text_lines(spark, odd), allowMissingColumns=True))
    both = kept.withColumn("supported", F.lit(True)).unionByName(rejected.drop("reason").withColumn("supported", F.lit(False)))
    return both.groupBy("lang", "suffix", "supported").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("value")).alias("n_chars")
    )
