"""Queries with iterative learners and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.columns import rnd
from ..operators import assembly as A, learners as L, rules as U, text_risk as T
from ..session import cut_lineage
from ..sources import applicants as P, files, views
from ..sources.tables import table
from ..streaming import consent_stream as CS, feature_stream as FS, runner, scoring_stream as SS
from .registry import query
from .rule_plans import CONSENT_SQL, behaviour
from .sqlscore import CARD
from .sqlviews import r, using, view


def _labelled_texts(spark, d):
    """Documents with label 1 for low quality and their part; read by every step."""
    labels = table(spark, d, "labels").select("doc_id", (1.0 - F.col("quality")).alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")
    return cut_lineage(docs.withColumn("split", P.split_of("doc_id")))


@query("ml_tfidf_lr")
def ml_tfidf_lr(spark, d):
    """Text risk of labelled documents: fitted on the training part, applied to the rest."""
    docs = _labelled_texts(spark, d)
    model = T.fit(docs.where(F.col("split") == "train"))
    out = model.apply(docs.where(F.col("split") == "test"))
    return out.select(
        "doc_id", F.col("label").cast("int").alias("label"), (F.col("prob") > 0.5).cast("int").alias("text_pred"),
        rnd(F.col("prob"), 6).alias("prob"),
    )


STEPS = 3
STOP = ("the", "of", "and", "to", "in", "is", "for", "on", "with", "der", "die", "de", "la")


def _steps_sql(columns: str) -> str:
    """The gradient steps unrolled; ``columns`` of the held-out documents."""
    last, parts = "w0", []
    for k in range(STEPS):
        parts.append(f"""
e{k} AS (SELECT doc_id, 1/(1+exp(-(coalesce(z,0)+b)))-label AS e FROM docs LEFT JOIN (SELECT doc_id, sum(x*w) AS z FROM entries JOIN w{k} USING(term) GROUP BY 1) USING(doc_id), b{k} WHERE split='train'),
w{k + 1} AS (SELECT term, w-rate*(w+coalesce(g,0)) AS w FROM w{k} LEFT JOIN (SELECT term, sum(x*e) AS g FROM entries JOIN e{k} USING(doc_id) GROUP BY 1) USING(term), n),
b{k + 1} AS (SELECT b-rate*(SELECT sum(e) FROM e{k}) AS b FROM b{k}, n)""")
        last = k + 1
    return f"""WITH docs AS (SELECT doc_id, text, 1-quality AS label, CASE WHEN CAST('0x'||substr(md5(CAST(doc_id AS VARCHAR)),1,8) AS BIGINT)%10<8 THEN 'train' ELSE 'test' END AS split FROM documents JOIN labels USING(doc_id)),
n AS (SELECT count(*)::DOUBLE AS n, 1/(count(*)/2e0+1) AS rate FROM docs WHERE split='train'),
tf AS (SELECT doc_id, split, term, count(*) AS tf FROM (SELECT doc_id, split, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM docs) WHERE term NOT IN {STOP} GROUP BY ALL),
idf AS (SELECT term, ln((1+any_value(n))/(1+count(*)))+1 AS idf FROM tf, n WHERE split='train' GROUP BY term),
entries AS (SELECT doc_id, term, v/sqrt(sum(v*v) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, term, tf*idf AS v FROM tf JOIN idf USING(term))),
w0 AS (SELECT term, 0e0 AS w FROM idf), b0 AS (SELECT ln((sum(label)+0.5e0)/(sum(1-label)+0.5e0)) AS b FROM docs WHERE split='train'),{",".join(parts)}
SELECT {columns} FROM docs
LEFT JOIN (SELECT doc_id, sum(x*w) AS z FROM entries JOIN w{last} USING(term) GROUP BY 1) USING(doc_id), b{last} WHERE split='test'"""


CHANCE = "1/(1+exp(-(coalesce(z,0)+b)))"


def _after_steps(spark, d):
    """Held-out documents with prob, and the chance that the steps start from: that of the training labels."""
    docs = _labelled_texts(spark, d)
    known, idf, entries = T.training_tables(docs.where(F.col("split") == "train"), "doc_id", "text", "label", STOP)
    counts = known.agg(F.count_if(F.col("y") == 1).alias("bad"), F.count_if(F.col("y") == 0).alias("good")).first()
    odds = (counts.bad + 0.5) / (counts.good + 0.5)
    try:
        weights, level = T.gradient_steps(known, entries, idf, STEPS, 1 / ((counts.bad + counts.good) / 2 + 1), intercept=math.log(odds))
    finally:
        entries.unpersist()
    return T.TextRisk(weights, level, 0.0, STOP).apply(docs.where(F.col("split") == "test")), odds / (1 + odds)


@query("ml_tfidf_steps", _steps_sql(f"doc_id, CAST(label AS INTEGER) AS label, {r(CHANCE, 8)} AS prob"))
def ml_tfidf_steps(spark, d):
    """The same tables after a few plain gradient steps, which SQL can follow."""
    out, _ = _after_steps(spark, d)
    return out.select("doc_id", F.col("label").cast("int").alias("label"), rnd(F.col("prob"), 8).alias("prob"))


def _fused(spark, d):
    """Held-out borrowers whose document has a text vote: risky where the text or the behaviour says so.

    The text says so where its chance is above that of the training labels.
    """
    out, usual = _after_steps(spark, d)
    text = out.select(F.col("doc_id").alias("account_id"), (F.col("prob") > usual).cast("int").alias("text_pred"))
    return behaviour(spark, d).join(text, "account_id").withColumn("final_pred", U.either(F.col("text_pred"), F.col("guess")))


TEXT_VOTE = f"CASE WHEN {CHANCE}>(SELECT 1/(1+exp(-b)) FROM b0) THEN 1 ELSE 0 END"
view("text_votes", _steps_sql(f"doc_id AS account_id, {TEXT_VOTE} AS text_pred"))
view("fused", "SELECT b.*, text_pred, greatest(b.guess, text_pred) AS final_pred FROM behave_out b JOIN text_votes USING(account_id)", "behave_out", "text_votes")


@query("rule_fusion", using("fused", sql="SELECT account_id, text_pred, guess AS behaviour_pred, final_pred FROM fused"))
def rule_fusion(spark, d):
    return _fused(spark, d).select("account_id", "text_pred", F.col("guess").alias("behaviour_pred"), "final_pred")


@query("agg_portfolio_risk", using("fused", sql=f"SELECT {r('avg(final_pred)',3)} AS portfolio_risk, count(*) AS n FROM fused"))
def agg_portfolio_risk(spark, d):
    return _fused(spark, d).agg(rnd(F.avg("final_pred"), 3).alias("portfolio_risk"), F.count(F.lit(1)).alias("n"))


@query("ml_label_encode", """
SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority)-1)::DOUBLE AS o_orderpriority_code FROM orders""")
def ml_label_encode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return L.label_codes(o, "o_orderpriority").select("o_orderkey", "o_orderpriority_code")


def _tree_frame(spark, d):
    """Raw features; trees see a missing value as -1."""
    filled = {f: F.coalesce(F.col(f), F.lit(-1.0)) for f in V.FEATURES}
    return cut_lineage(P.train(spark, d).withColumns(filled).select("account_id", *V.FEATURES, "default", "split"))


@query("ml_gbt")
def ml_gbt(spark, d):
    df = _tree_frame(spark, d)
    out = L.boosted_predictions(df.where(F.col("split") == "train"), df.where(F.col("split") == "test"), V.FEATURES, "default")
    return out.select("account_id", "default", F.col("prediction").cast("int").alias("prediction"), rnd(F.col("prob"), 6).alias("prob"))


@query("ml_cv")
def ml_cv(spark, d):
    folds = L.cross_validated_auc(_tree_frame(spark, d), V.FEATURES, "default", "account_id")
    mean = sum(auc for _, auc in folds) / len(folds)
    rows = [(fold, round(auc, 6), round(mean, 6)) for fold, auc in folds]
    return spark.createDataFrame(rows, "fold int, auc double, mean_auc double")


def stream_verdicts(spark, d):
    """The consent gate over event streams, read back from its sink: a verdict for every upload."""
    ticks = files.fresh_dir(spark, "clock")

    def start():
        events = views.with_k(CS.stream_table(spark, d, "events"))
        again = views.with_k(CS.stream_table(spark, d, "events"))
        return CS.gate(views.uploads_of(events), views.consents_of(again), CS.clock_folder(spark, ticks))

    last = CS.closing_tick(table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at")))
    return CS.verdicts(start, spark, ticks, last)


@query("st_consent", CONSENT_SQL)
def st_consent(spark, d):
    return stream_verdicts(spark, d).select(
        "upload_id", "borrower_id", "doc_type", F.col("session.session_id").cast("string").alias("session_id"), "status", "reason"
    )


@query("st_score", using("scored", "ev", "verdicts", sql=f"""
SELECT event_id AS upload_id, account_id, {r('pd',6)} AS pd, risk_score, risk_tier FROM ev JOIN scored ON account_id=user_id JOIN (SELECT upload_id FROM verdicts WHERE status=200) ON upload_id=event_id"""))
def st_score(spark, d):
    """Accepted uploads scored as they arrive, against bank features that a stream of ledger rows has kept up to date."""
    accepted = cut_lineage(stream_verdicts(spark, d).where(F.col("status") == 200).select("upload_id"))
    bank = _streamed_bank_features(spark, d)
    sources = {**views.feature_sources(spark, d), "bank": bank}
    features = cut_lineage(A.model_features(A.join_sources(**sources)))
    uploads = views.uploads_of(views.with_k(CS.stream_table(spark, d, "events")))
    out = runner.drain(SS.score_stream(uploads.join(accepted, "upload_id"), features, CARD), "scores").frame
    return out.select("upload_id", "account_id", rnd(F.col("pd"), 6).alias("pd"), "risk_score", "risk_tier")


LEDGER_BATCHES = 4


def _streamed_bank_features(spark, d):
    """Ledger rows as files that a stream takes in batches, a file for each core; every account comes in several of them."""
    lines, folder = files.fresh_dir(spark, "ledger"), files.fresh_dir(spark, "features")
    ledger, cores = views.ledger(spark, d), spark.sparkContext.defaultParallelism
    ledger.repartition(LEDGER_BATCHES * cores, F.xxhash64("txn_id")).write.parquet(lines)
    stream = spark.readStream.schema(ledger.schema).option("maxFilesPerTrigger", cores).parquet(lines)
    features = FS.FeatureTable(spark, folder, fold_after=3)
    FS.maintain(stream, features, f"{folder}/state")
    return features.current()


@query("st_features", using("bank", sql="SELECT * FROM bank"))
def st_features(spark, d):
    """The feature table that the ledger stream has kept, account by account."""
    return _streamed_bank_features(spark, d)
