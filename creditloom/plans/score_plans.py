"""Queries that apply the fixed scorecard to every applicant."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.columns import rnd
from ..operators import assembly as A, explain as X, scoring as S
from ..session import cut_lineage
from ..sources import applicants as P, views
from .registry import query
from .sqlscore import CARD, SCORE, SIGMOID, clip, num, woe_case
from .sqlviews import r, using, view

MODEL = CARD


def Z():
    return F.col("log_odds")


def PD():
    return F.col("pd")



def _scored(spark, d):
    return S.score_batch(P.features(spark, d), MODEL)


F5 = ", ".join(f"{r(f, 6)} AS {f}" for f in V.FEATURES)


def _five(df):
    return [rnd(F.col(f), 6).alias(f) for f in V.FEATURES]


@query("prj_map_features", using("feat", sql=f"SELECT account_id, {F5} FROM feat"))
def prj_map_features(spark, d):
    df = P.features(spark, d)
    return df.select("account_id", *_five(df))


@query("prj_flatten_alt", using("feat", sql=f"""
SELECT account_id, {F5.replace(r('utility_stability',6), r('payment_discipline_flag',6))} FROM feat"""))
def prj_flatten_alt(spark, d):
    df = A.model_features_alt(P.joined(spark, d))
    return df.select("account_id", *_five(df))


@query("jn_features", using("feat", sql=f"SELECT account_id, {F5}, has_bank, has_salary, has_utility FROM feat"))
def jn_features(spark, d):
    df = P.features(spark, d)
    return df.select("account_id", *_five(df), "has_bank", "has_salary", "has_utility")


@query("dispatch_doc_type", using("bank", "salary", "utility", sql=f"""
SELECT account_id, 'bank' AS doc_type, credit_debit_ratio, NULL::DOUBLE AS net_to_gross_ratio, NULL::DOUBLE AS utility_stability FROM bank
UNION ALL SELECT account_id, 'salary', NULL, {r('net_to_gross_ratio',6)}, NULL FROM salary
UNION ALL SELECT account_id, 'utility', NULL, NULL, {r('utility_stability',6)} FROM utility"""))
def dispatch_doc_type(spark, d):
    u = A.by_doc_type(views.feature_sources(spark, d))
    return u.select(
        "account_id", "doc_type", "credit_debit_ratio", rnd(F.col("net_to_gross_ratio"), 6).alias("net_to_gross_ratio"),
        rnd(F.col("utility_stability"), 6).alias("utility_stability"),
    )


WOES = [f + "_woe" for f in V.FEATURES]


def _woe_query(name, missing):
    cases = ", ".join(f"{woe_case(CARD, f, missing)} AS {f}_woe" for f in V.FEATURES)

    @query(name, using("feat", sql=f"SELECT account_id, {cases} FROM feat"))
    def run(spark, d):
        return S.with_woe(P.features(spark, d), MODEL, missing).select("account_id", *WOES)


_woe_query("woe_apply", "neutral")
_woe_query("woe_missing_bin", "empirical")


@query("woe_single", using("feat", sql="SELECT account_id, has_salary, has_utility, " + ", ".join(
    f"{woe_case(CARD, f)} AS {f}_woe" for f in V.FEATURES) + " FROM feat"))
def woe_single(spark, d):
    return S.with_woe(P.features(spark, d), MODEL).select("account_id", "has_salary", "has_utility", *WOES)


view("long_woe", " UNION ALL ".join(
    f"SELECT account_id, '{f}' AS feature, {woe_case(CARD, f)} AS woe, {num(CARD.betas[f])} AS beta FROM feat WHERE {f} IS NOT NULL"
    for f in V.FEATURES), "feat")


def _looked_up(spark, d):
    """Value -> bin -> WoE as a range join on the bins table (a few rows per feature)."""
    long = A.unpivot_features(P.features(spark, d), "account_id").where(F.col("value").isNotNull())
    bins = F.broadcast(MODEL.bins_table(spark))
    hit = (long["feature"] == bins["feature"]) & (long["value"] >= bins["lo"]) & (long["value"] < bins["hi"])
    return long.join(bins, hit).select("account_id", long["feature"], "woe")


@query("jn_woe_lookup", using("long_woe", sql="SELECT account_id, feature, woe FROM long_woe"))
def jn_woe_lookup(spark, d):
    return _looked_up(spark, d)


@query("jn_coef", using("long_woe", sql=f"""
SELECT account_id, {r(f"{num(CARD.intercept)}+sum(woe*beta)", 6)} AS log_odds FROM long_woe GROUP BY account_id"""))
def jn_coef(spark, d):
    betas = F.broadcast(MODEL.coefficients(spark))
    z = _looked_up(spark, d).join(betas, "feature").groupBy("account_id").agg(F.sum(F.col("woe") * F.col("beta")).alias("s"))
    return z.select("account_id", rnd(F.lit(MODEL.intercept) + F.col("s"), 6).alias("log_odds"))


@query("lr_predict", using("scored", sql=f"""
SELECT account_id, {r('pd',6)} AS pd, {r('ln(pd/(1-pd))',6)} AS log_odds FROM scored"""))
def lr_predict(spark, d):
    s = _scored(spark, d)
    return s.select("account_id", rnd(PD(), 6).alias("pd"), rnd(F.log(PD() / (1 - PD())), 6).alias("log_odds"))


REG = clip(SIGMOID, V.PD_FLOOR, V.PD_CAP)


@query("pd_compute", using("scored0", sql=f"SELECT account_id, {r(REG,6)} AS pd FROM scored0"))
def pd_compute(spark, d):
    return _scored(spark, d).select("account_id", rnd(S.regulatory_pd(Z()), 6).alias("pd"))


@query("pd_logodds", using("scored0", sql=f"SELECT account_id, {r('log_odds',6)} AS log_odds FROM scored0"))
def pd_logodds(spark, d):
    return _scored(spark, d).select("account_id", rnd(Z(), 6).alias("log_odds"))


@query("pd_odds", using("scored0", sql=f"SELECT account_id, {r(f'(1-{REG})/{REG}',4)} AS odds FROM scored0"))
def pd_odds(spark, d):
    return _scored(spark, d).select("account_id", rnd(S.good_odds(S.regulatory_pd(Z())), 4).alias("odds"))


@query("pd_from_logodds", using("scored0", sql=f"SELECT account_id, {r('1/(1+exp(-greatest(-500e0,least(500e0,log_odds*100))))',6)} AS pd FROM scored0"))
def pd_from_logodds(spark, d):
    return _scored(spark, d).select("account_id", rnd(S.sigmoid(Z() * 100), 6).alias("pd"))


@query("pd_band", using("scored0", sql=f"""
SELECT account_id, CASE WHEN pd<0.001e0 THEN 'AAA-equivalent  (< 0.1%)' WHEN pd<0.05e0 THEN 'Investment Grade (< 5%)' WHEN pd<0.2e0 THEN 'Sub-investment  (< 20%)'
 WHEN pd<0.4e0 THEN 'Speculative     (< 40%)' ELSE 'Distressed      (≥ 40%)' END AS band FROM (SELECT account_id, {REG} AS pd FROM scored0)"""))
def pd_band(spark, d):
    return _scored(spark, d).select("account_id", S.pd_band(S.regulatory_pd(Z())).alias("band"))


@query("score_scale", using("scored", sql="SELECT account_id, risk_score FROM scored"))
def score_scale(spark, d):
    return _scored(spark, d).select("account_id", "risk_score")


@query("score_scale_alt", using("scored0", sql=f"""
SELECT account_id, CAST(floor(greatest(300e0,least(900e0,{num(V.ALT_OFFSET)}+{num(V.FACTOR)}*log_odds))) AS INTEGER) AS risk_score FROM scored0"""))
def score_scale_alt(spark, d):
    return _scored(spark, d).select("account_id", S.to_score_alt(Z()).alias("risk_score"))


@query("score_points", using("woe5", sql="SELECT account_id, " + ", ".join(
    r(f"{num(-V.FACTOR * CARD.betas[f])}*{f}_woe+{num(V.OFFSET / 5)}", 4) + f" AS {f}" for f in V.FEATURES) + " FROM woe5"))
def score_points(spark, d):
    s = _scored(spark, d)
    return s.select("account_id", *[rnd(S.feature_points(MODEL, f), 4).alias(f) for f in V.FEATURES])


@query("tier", using("scored", sql="SELECT account_id, risk_tier FROM scored"))
def tier(spark, d):
    return _scored(spark, d).select("account_id", "risk_tier")


_BANDS = "CASE " + " ".join(f"WHEN risk_score>={a} AND risk_score<{b} THEN '{a}–{b} {n}'" for a, b, n in V.SCORE_BANDS) + " END"


@query("score_bands", using("scored", sql=f"""
SELECT band, n, {r("100*n/total",1)} AS pct, {r('avg_score',1)} AS avg_score, {r('avg_pd',4)} AS avg_pd FROM (
 SELECT {_BANDS} AS band, count(*) AS n, sum(count(*)) OVER () ::BIGINT AS total, avg(risk_score) AS avg_score, avg(pd) AS avg_pd FROM scored GROUP BY 1) WHERE band IS NOT NULL"""))
def score_bands(spark, d):
    return _bands(_scored(spark, d))


def _bands(scored):
    from ..operators.metrics import score_bands as bands

    return bands(scored, "risk_score", "pd")


@query("agg_describe", using("scored", sql=f"""
SELECT {r('avg(pd)',6)} AS pd_mean, {r('min(pd)',6)} AS pd_min, {r('max(pd)',6)} AS pd_max, {r('stddev_pop(pd)',6)} AS pd_std, count(*) FILTER (WHERE pd>0.4e0) AS pd_over_40,
 {r('avg(risk_score)',4)} AS score_mean, min(risk_score) AS score_min, max(risk_score) AS score_max, {r('stddev_pop(risk_score)',4)} AS score_std FROM scored"""))
def agg_describe(spark, d):
    return _scored(spark, d).agg(
        rnd(F.avg("pd"), 6).alias("pd_mean"), rnd(F.min("pd"), 6).alias("pd_min"), rnd(F.max("pd"), 6).alias("pd_max"),
        rnd(F.stddev_pop("pd"), 6).alias("pd_std"), F.count_if(PD() > 0.4).alias("pd_over_40"),
        rnd(F.avg("risk_score"), 4).alias("score_mean"), F.min("risk_score").alias("score_min"),
        F.max("risk_score").alias("score_max"), rnd(F.stddev_pop("risk_score"), 4).alias("score_std"),
    )


# Explanations. The background means come from the training part of the applicants.
view("means", "SELECT " + ", ".join(f"avg({f}_woe) AS {f}_mean" for f in V.FEATURES) + " FROM woe5 WHERE CAST('0x'||substr(md5(CAST(account_id AS VARCHAR)),1,8) AS BIGINT)%10<8", "woe5")
view("shap", "SELECT account_id, " + ", ".join(
    f"{num(CARD.betas[f])}*({f}_woe-(SELECT {f}_mean FROM means)) AS {f}_shap" for f in V.FEATURES) + " FROM woe5", "woe5", "means")


def _explained(spark, d):
    from dataclasses import replace

    scored = cut_lineage(_scored(spark, d))  # the features are built once, for the means and for the output
    model = replace(MODEL, mean_woe=X.mean_woe(scored.where(P.split_of("account_id") == "train"), MODEL))
    return X.with_shap(scored, model), model


@query("shap_linear", using("shap", sql="SELECT account_id, " + ", ".join(f"{r(f + '_shap', 6)} AS {f}_shap" for f in V.FEATURES) + " FROM shap"))
def shap_linear(spark, d):
    df, _ = _explained(spark, d)
    return df.select("account_id", *[rnd(F.col(f + "_shap"), 6).alias(f + "_shap") for f in V.FEATURES])


view("shap_long", " UNION ALL ".join(
    f"SELECT account_id, {i} AS place, '{f}' AS feature, '{V.FEATURE_LABELS[f]}' AS label, {f}_shap AS v FROM shap" for i, f in enumerate(V.FEATURES)), "shap")


@query("shap_population", using("shap_long", sql=f"""
SELECT *, row_number() OVER (ORDER BY mean_abs_shap DESC, feature)::INTEGER AS rank FROM (
 SELECT feature, label, {r('avg(abs(v))',4)} AS mean_abs_shap, {r('avg(v)',4)} AS mean_shap FROM shap_long GROUP BY 1,2)"""))
def shap_population(spark, d):
    return X.population_summary(*_explained(spark, d))


@query("win_rank_importance", using("shap_long", sql=f"""
SELECT feature, row_number() OVER (ORDER BY mean_abs_shap DESC, feature)::INTEGER AS rank FROM (
 SELECT feature, {r('avg(abs(v))',4)} AS mean_abs_shap FROM shap_long GROUP BY 1)"""))
def win_rank_importance(spark, d):
    return X.population_summary(*_explained(spark, d)).select("feature", "rank")


def _ranked(reasons, n=X.TOP_REASONS):
    return F.posexplode(reasons).alias("place", "r")


view("shap_rank", "SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(v) DESC, place)-1 AS rk FROM shap_long", "shap_long")


@query("reason_codes", using("shap_rank", sql=f"""
SELECT account_id, rk AS place, feature, label, {r('v',4)} AS value, CASE WHEN v>0 THEN 'positive' ELSE 'negative' END AS direction FROM shap_rank WHERE rk<4"""))
def reason_codes(spark, d):
    df, model = _explained(spark, d)
    return df.select("account_id", _ranked(X.shap_reasons(model))).select(
        "account_id", "place", "r.feature", "r.label", "r.value", "r.direction"
    )


@query("sort_features", using("shap_rank", sql="SELECT account_id, string_agg(feature, ' > ' ORDER BY rk) AS drivers FROM shap_rank GROUP BY 1"))
def sort_features(spark, d):
    df, model = _explained(spark, d)
    names = F.transform(X.shap_reasons(model, len(V.FEATURES)), lambda x: x["feature"])
    return df.select("account_id", F.array_join(names, " > ").alias("drivers"))


view("points_long", " UNION ALL ".join(
    f"SELECT account_id, {i} AS place, '{f}' AS feature, '{V.FEATURE_LABELS[f]}' AS label, {f}_woe AS woe, {r(f'{num(-V.FACTOR)}*{num(CARD.betas[f])}*{f}_woe', 2)} AS v FROM woe5"
    for i, f in enumerate(V.FEATURES)), "woe5")
view("points_rank", "SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY abs(v) DESC, place)-1 AS rk FROM points_long", "points_long")


@query("reason_codes_points", using("points_rank", sql="""
SELECT account_id, rk AS place, feature AS factor, woe, v AS score_contribution, CASE WHEN v>0 THEN 'positive' ELSE 'negative' END AS impact FROM points_rank WHERE rk<4"""))
def reason_codes_points(spark, d):
    return _scored(spark, d).select("account_id", _ranked(X.point_reasons(MODEL))).select(
        "account_id", "place", F.col("r.feature").alias("factor"), "r.woe",
        F.col("r.value").alias("score_contribution"), F.col("r.direction").alias("impact"),
    )


@query("topk_reasons", using("points_rank", sql="SELECT account_id, string_agg(feature, ',' ORDER BY rk) AS top4 FROM points_rank WHERE rk<4 GROUP BY 1"))
def topk_reasons(spark, d):
    top = F.transform(X.point_reasons(MODEL), lambda x: x["feature"])
    return _scored(spark, d).select("account_id", F.array_join(top, ",").alias("top4"))


@query("adverse_notice", using("points_rank", sql=f"""
SELECT account_id, '{X.NOTICE_HEAD}' || chr(10) || coalesce(string_agg('  ' || n || '. ' || label || ' (impact: ' || printf('%.4f', v) || ')', chr(10) ORDER BY rk), '{X.NOTICE_NONE}') AS notice FROM (
 SELECT *, CASE WHEN v<=0 THEN row_number() OVER (PARTITION BY account_id, v<=0 ORDER BY rk) END AS n FROM points_rank WHERE rk<4) GROUP BY account_id"""))
def adverse_notice(spark, d):
    s = _scored(spark, d).withColumn("reasons", X.point_reasons(MODEL))
    return s.select("account_id", X.adverse_notice("reasons").alias("notice"))


# Confidence.
COV = "(0.6e0+CASE WHEN has_salary THEN 0.2e0 ELSE 0e0 END+CASE WHEN has_utility THEN 0.2e0 ELSE 0e0 END)"
QUAL = "(((credit_debit_ratio IS NOT NULL)::INT+(cashflow_cv IS NOT NULL)::INT+(net_to_gross_ratio IS NOT NULL)::INT+(utility_stability IS NOT NULL)::INT+(min_balance IS NOT NULL)::INT)/5e0)"
CERT = "(abs(pd-0.5e0)*2)"
def HAS():
    return [F.col(x) for x in ("has_bank", "has_salary", "has_utility")]


@query("conf_coverage", using("feat", sql=f"SELECT account_id, {r(COV,4)} AS coverage FROM feat"))
def conf_coverage(spark, d):
    return P.features(spark, d).select("account_id", rnd(S.coverage(*HAS()), 4).alias("coverage"))


@query("conf_quality", using("feat", sql=f"SELECT account_id, {r(QUAL,4)} AS quality FROM feat"))
def conf_quality(spark, d):
    return P.features(spark, d).select("account_id", rnd(S.data_quality(), 4).alias("quality"))


@query("conf_certainty", using("scored", sql=f"SELECT account_id, {r(CERT,4)} AS certainty FROM scored"))
def conf_certainty(spark, d):
    return _scored(spark, d).select("account_id", rnd(S.certainty(PD()), 4).alias("certainty"))


@query("conf_product", using("scored", sql=f"""
SELECT account_id, pct AS confidence_pct, CASE WHEN pct>=80 THEN 'High Confidence' WHEN pct>=50 THEN 'Moderate Confidence' WHEN pct>=20 THEN 'Low Confidence — Manual Review Recommended'
 ELSE 'Very Low Confidence — Do Not Automate Decision' END AS band FROM (SELECT account_id, {r(f"{COV}*{QUAL}*greatest(0e0,least(1e0,(account_id%12)/10e0))*{CERT}*100", 2)} AS pct FROM scored)"""))
def conf_product(spark, d):
    fraud = (F.col("account_id") % 12) / 10
    pct, band = S.confidence_product(S.coverage(*HAS()), S.data_quality(), fraud, PD())
    return _scored(spark, d).select("account_id", pct.alias("confidence_pct"), band.alias("band"))


WEIGHTED = f"(0.4e0*{COV}+0.3e0*{QUAL}+0.3e0*{CERT})"
WBAND = f"CASE WHEN {WEIGHTED}>=0.75e0 THEN 'High Confidence' WHEN {WEIGHTED}>=0.5e0 THEN 'Moderate Confidence' ELSE 'Low Confidence' END"


@query("conf_weighted", using("scored", sql=f"SELECT account_id, {r(f'{WEIGHTED}*100',2)} AS confidence_pct, {WBAND} AS confidence_band FROM scored"))
def conf_weighted(spark, d):
    return _scored(spark, d).select("account_id", "confidence_pct", "confidence_band")


@query("score_batch", using("scored", sql=f"""
SELECT account_id, {r('log_odds',6)} AS log_odds, {r('pd',6)} AS pd, risk_score, risk_tier, {r(f'{WEIGHTED}*100',2)} AS confidence_pct, {WBAND} AS confidence_band FROM scored"""))
def score_batch(spark, d):
    return _scored(spark, d).select(
        "account_id", rnd(Z(), 6).alias("log_odds"), rnd(PD(), 6).alias("pd"), "risk_score", "risk_tier", "confidence_pct", "confidence_band"
    )


def response(spark, d):
    """The nested answer of an assessment as one JSON document per borrower."""
    s = _scored(spark, d).withColumn("reasons", X.point_reasons(MODEL))
    meta = F.struct(
        F.lit("WoE_Logistic_Scorecard").alias("model_type"), F.lit(V.PDO).alias("pdo"), F.lit(V.BASE_SCORE).alias("base_score"),
        F.lit(V.BASE_ODDS).alias("base_odds"), F.lit(round(V.FACTOR, 4)).alias("factor"), F.lit(round(V.OFFSET, 4)).alias("offset"),
        F.lit("300–900").alias("score_range"),
    )
    reasons = F.transform(
        "reasons",
        lambda x: F.struct(
            x["feature"].alias("factor"), rnd(x["woe"], 4).alias("woe"), x["coefficient"],
            x["value"].alias("score_contribution"), x["direction"].alias("impact"),
        ),
    )
    return s.select(
        "account_id",
        F.to_json(
            F.struct(
                F.lit("success").alias("status"), "risk_score", rnd(PD(), 4).alias("probability_of_default"), "risk_tier",
                rnd(Z(), 4).alias("log_odds"), reasons.alias("reason_codes"),
                F.struct(F.col("confidence_pct"), F.col("confidence_band").alias("band")).alias("confidence"), meta.alias("model_metadata"),
                F.struct(*[rnd(F.col(w), 4).alias(w) for w in WOES]).alias("feature_woe_values"),
                F.struct(*V.FEATURES).alias("features"),
            )
        ).alias("response"),
    )


RESPONSE = (
    "status string, risk_score int, probability_of_default double, risk_tier string, log_odds double, "
    "reason_codes array<struct<factor:string,score_contribution:double,impact:string>>, "
    "confidence struct<confidence_pct:double,band:string>, model_metadata struct<pdo:int,factor:double>"
)


@query("assemble_response", using("scored", "points_rank", sql=f"""
SELECT s.account_id, 'success' AS status, risk_score, {r('pd',4)} AS probability_of_default, risk_tier, {r('log_odds',4)} AS log_odds,
 p.feature AS first_factor, p.v AS first_points, {r(f'{WEIGHTED}*100',2)} AS confidence_pct, 50 AS pdo, {num(round(V.FACTOR, 4))} AS factor
FROM scored s JOIN points_rank p ON p.account_id=s.account_id AND p.rk=0"""))
def assemble_response(spark, d):
    r_ = response(spark, d).withColumn("r", F.from_json("response", RESPONSE))
    return r_.select(
        "account_id", "r.status", "r.risk_score", "r.probability_of_default", "r.risk_tier", "r.log_odds",
        F.col("r.reason_codes")[0]["factor"].alias("first_factor"), F.col("r.reason_codes")[0]["score_contribution"].alias("first_points"),
        "r.confidence.confidence_pct", "r.model_metadata.pdo", "r.model_metadata.factor",
    )


def _over(i):
    s = P.SCENARIOS[i]
    cols = ", ".join(f"{num(s[f])} AS {f}" if f in s else f for f in V.FEATURES)
    woes = ", ".join(f"{woe_case(CARD, f)} AS {f}_woe" for f in V.FEATURES)
    from .sqlscore import TIER, z_of

    return (
        f"SELECT account_id, {i + 1} AS scenario_id, {SCORE} AS new_score, {TIER} AS new_tier FROM (SELECT *, {clip(SIGMOID, V.PROB_EPS, 1 - V.PROB_EPS)} AS pd FROM ("
        f"SELECT *, {z_of()} AS log_odds FROM (SELECT *, {woes} FROM (SELECT account_id, {cols} FROM feat))))"
    )


view("tried", " UNION ALL ".join(_over(i) for i in range(len(P.SCENARIOS))), "feat")


@query("whatif", using("tried", "scored", sql="""
SELECT account_id, scenario_id, risk_score AS base_score, new_score, new_score-risk_score AS delta,
 CASE WHEN risk_tier<>new_tier THEN risk_tier || ' → ' || new_tier END AS delta_tier FROM tried JOIN scored USING(account_id)"""))
def whatif(spark, d):
    return S.what_if(P.features(spark, d), MODEL, P.SCENARIOS)


@query("eval_shap_stable", using("shap", "feat", "means", sql=f"""
SELECT account_id, true AS repeatable, {r('credit_debit_ratio_shap',6)} AS shap_before,
 {r(f"{num(CARD.betas['credit_debit_ratio'])}*({woe_case(CARD,'credit_debit_ratio').replace('WHEN credit_debit_ratio <','WHEN credit_debit_ratio*2 <')}-(SELECT credit_debit_ratio_mean FROM means))",6)} AS shap_doubled
FROM shap JOIN feat USING(account_id)"""))
def eval_shap_stable(spark, d):
    """Explaining twice gives the same values; doubling one feature moves only its own value."""
    df, model = _explained(spark, d)
    f = "credit_debit_ratio"
    again = X.shap_value(model, f)
    doubled = F.lit(model.betas[f]) * (S.woe_of(model, f, value=F.col(f) * 2) - F.lit(model.mean_woe[f]))
    return df.select(
        "account_id", (F.col(f + "_shap") == again).alias("repeatable"), rnd(F.col(f + "_shap"), 6).alias("shap_before"),
        rnd(doubled, 6).alias("shap_doubled"),
    )

