"""Queries for scorecard development and validation."""

from __future__ import annotations

from dataclasses import replace
from itertools import permutations

from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.columns import rnd
from ..operators import assembly as A, binning as B, explain as X, metrics as M, model as L, ordered as O, scoring as S
from ..session import cut_lineage
from ..sources import applicants as P, artifacts as R, files
from .registry import query
from .sqlscore import CARD, SCORE, SIGMOID, clip, num, woe_case
from .sqlviews import r, using, view

MODEL = CARD


def _train(spark, d):
    """Training frame with WoE columns and the probability of the fixed scorecard."""
    df = S.with_woe(P.train(spark, d), MODEL).withColumn("log_odds", S.log_odds(MODEL))
    return df.withColumn("p", S.predict_proba(F.col("log_odds"))).withColumn("everyone", F.lit("all"))


@query("agg_bad_rate", using("train", sql=f"SELECT split, count(*) AS n, sum(y)::BIGINT AS bad, {r('avg(y)',6)} AS bad_rate FROM train GROUP BY split"))
def agg_bad_rate(spark, d):
    y = F.col("default")
    return P.train(spark, d).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("bad"), rnd(F.avg(y), 6).alias("bad_rate")
    )


@query("split_train_test", using("train", sql="SELECT account_id, split FROM train"))
def split_train_test(spark, d):
    return P.train(spark, d).select("account_id", "split")


@query("jn_index", using("train", sql="SELECT account_id, y AS \"default\" FROM train WHERE split='test'"))
def jn_index(spark, d):
    df = P.train(spark, d)
    held_out = df.where(F.col("split") == "test").select("account_id")
    return df.join(held_out, "account_id", "left_semi").select("account_id", "default")


@query("flt_dropna", using("train", sql="SELECT account_id, y AS \"default\" FROM train WHERE net_to_gross_ratio IS NOT NULL AND utility_stability IS NOT NULL"))
def flt_dropna(spark, d):
    return P.train(spark, d).dropna(subset=list(V.FEATURES)).select("account_id", "default")


@query("prj_clip0", using("train", sql="SELECT account_id, " + ", ".join(f"greatest({f},0e0) AS {f}" if f == "min_balance" else f for f in V.FEATURES) + " FROM train"))
def prj_clip0(spark, d):
    clip0 = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))
    return P.train(spark, d).select("account_id", *[clip0(f).alias(f) for f in V.FEATURES])


@query("set_union_reject", using("train", sql="""
SELECT account_id, min_balance, CASE WHEN has_salary THEN y ELSE -1 END AS "default" FROM train"""))
def set_union_reject(spark, d):
    df = P.train(spark, d)
    cols = ["account_id", "min_balance"]
    labeled = df.where(F.col("has_salary")).select(*cols, "default")
    return A.with_reject_inference(labeled, df.where(~F.col("has_salary")).select(*cols))


# Distinct scores with running counts.
view("steps", """
SELECT split, p, n, bad, good, sum(bad) OVER w AS cb, sum(good) OVER w AS cg, sum(bad) OVER (PARTITION BY split) AS tb, sum(good) OVER (PARTITION BY split) AS tg
FROM (SELECT split, p, count(*) AS n, sum(y) AS bad, sum(1-y) AS good FROM (SELECT split, y, p FROM train UNION ALL SELECT 'all', y, p FROM train) GROUP BY 1,2)
WINDOW w AS (PARTITION BY split ORDER BY p DESC)""", "train")


def _with_all(df):
    """Every row once in its split and once under 'all'."""
    return df.withColumn("split", F.explode(F.array("split", F.lit("all"))))


def _table(spark, d):
    return M.label_table(_with_all(_train(spark, d)), "default", "p", "split")


@query("win_cum_ks", using("steps", sql=f"""
SELECT split, {r('p',9)} AS p, {r('cb/(tb+1e-8)',6)} AS cum_bad_share, {r('cg/(tg+1e-8)',6)} AS cum_good_share FROM steps"""))
def win_cum_ks(spark, d):
    c = M.ks_curve(_table(spark, d), "split", "p")
    return c.select("split", rnd(F.col("p"), 9).alias("p"), *[rnd(F.col(x), 6).alias(x) for x in ("cum_bad_share", "cum_good_share")])


KS_SQL = f"SELECT split, {r('max(abs(cb/(tb+1e-8)-cg/(tg+1e-8)))*100',2)} AS ks FROM steps GROUP BY split"
AUC_SQL = "SELECT split, sum(bad*(tg-cg+good/2e0))/(max(tb)*max(tg)) AS auc FROM steps GROUP BY split"


@query("metric_ks", using("steps", sql=KS_SQL))
def metric_ks(spark, d):
    return M.ks(_table(spark, d), "split", "p")


@query("metric_auc_gini", using("steps", sql=f"SELECT split, {r('auc',4)} AS auc, {r('2*auc-1',4)} AS gini FROM ({AUC_SQL})"))
def metric_auc_gini(spark, d):
    return M.gini(_table(spark, d), "split")


view("edges", """
SELECT split, list_sort(list_distinct(quantile_cont(p, [0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS edges
FROM (SELECT split, p FROM train UNION ALL SELECT 'all', p FROM train) GROUP BY split""", "train")
view("binned", """
SELECT s.*, greatest(1, len(list_filter(edges, lambda e: e < p))) AS bin FROM steps s JOIN edges USING(split)""", "steps", "edges")
view("bin_sums", "SELECT split, bin, sum(n) AS n, sum(bad) AS obs, sum(p*n) AS exp FROM binned GROUP BY 1,2", "binned")


@query("win_quantile_bins", using("binned", sql=f"SELECT split, {r('p',9)} AS p, bin FROM binned"))
def win_quantile_bins(spark, d):
    b = M.quantile_bins(_table(spark, d), "split", "p")
    return b.select("split", rnd(F.col("p"), 9).alias("p"), "bin")


CHI_TAIL = "CASE WHEN hl<=0 THEN 1e0 WHEN hl/2>700 THEN 0e0 ELSE greatest(0e0,1-list_sum(list_transform(range(0,2001), lambda n: exp(-hl/2+((bins-2)/2e0+n)*ln(hl/2)-lgamma((bins-2)/2e0+n+1))))) END"
HL_SQL = f"""SELECT split, {r('hl',4)} AS hl_stat, {r('hl_full',4)} AS hl_full, {r(CHI_TAIL,4)} AS p_value, CASE WHEN {CHI_TAIL}>0.05e0 THEN 'GOOD' ELSE 'BAD' END AS calibration
FROM (SELECT split, sum((obs-exp)^2/(exp+1e-8)) AS hl, sum((obs-exp)^2/(exp+1e-8)+(obs-exp)^2/(n-exp+1e-8)) AS hl_full, count(*) AS bins FROM bin_sums GROUP BY split)"""


@query("metric_hl", using("bin_sums", sql=HL_SQL))
def metric_hl(spark, d):
    return M.hosmer_lemeshow(_table(spark, d), "split", "p")


@query("pd_calibration", using("bin_sums", sql=f"""
SELECT split, bin, n::BIGINT AS n, {r('exp/n',4)} AS avg_predicted_pd, {r('obs/n',4)} AS observed_default_rate, {r('obs/n-exp/n',4)} AS difference, abs({r('obs/n-exp/n',4)})<0.05e0 AS calibrated FROM bin_sums"""))
def pd_calibration(spark, d):
    return M.calibration(_table(spark, d), "split", "p")


@query("metric_eval", using("steps", "bin_sums", sql=f"""
SELECT *, {r("max(CASE WHEN split='train' THEN auc END) OVER () - max(CASE WHEN split='test' THEN auc END) OVER ()",4)} AS auc_gap,
  {r("max(CASE WHEN split='train' THEN auc END) OVER () - max(CASE WHEN split='test' THEN auc END) OVER ()",4)}>0.03e0 AS overfit
FROM (SELECT split, {r('auc',4)} AS auc, {r('2*auc-1',4)} AS gini FROM ({AUC_SQL})) JOIN ({KS_SQL}) USING(split) JOIN ({HL_SQL}) USING(split) WHERE split<>'all'"""))
def metric_eval(spark, d):
    return M.report(_train(spark, d), "default", "p")


# Bins counted at the fixed edges.
def _bin_case(f):
    steps = "+".join(f"({f}>={num(e)})::INT" for e in CARD.edges(f))
    return f"coalesce({steps}, -1)"


view("bin_rows", " UNION ALL ".join(f"SELECT '{f}' AS feature, {_bin_case(f)} AS bin_id, y FROM train" for f in V.FEATURES), "train")
view("bins", """
SELECT feature, bin_id, ev AS n_event, nev AS n_nonevent, ln(g/b) AS woe, (g-b)*ln(g/b) AS iv FROM (
 SELECT *, (ev+h)/(sum(ev) OVER (PARTITION BY feature)) AS b, (nev+h)/(sum(nev) OVER (PARTITION BY feature)) AS g FROM (
  SELECT *, CASE WHEN ev=0 OR nev=0 THEN 0.5e0 ELSE 0e0 END AS h FROM (
   SELECT feature, bin_id, sum(y)::BIGINT AS ev, sum(1-y)::BIGINT AS nev FROM bin_rows GROUP BY 1,2)))""", "bin_rows")


def _bins(spark, d):
    return B.bins_at_edges(P.train(spark, d), MODEL)


@query("woe_table", using("bins", sql=f"SELECT feature, bin_id, n_event, n_nonevent, {r('woe',4)} AS woe, {r('iv',4)} AS iv FROM bins"))
def woe_table(spark, d):
    return _bins(spark, d).select(
        "feature", "bin_id", "n_event", "n_nonevent", rnd(F.col("woe"), 4).alias("woe"), rnd(F.col("iv"), 4).alias("iv")
    )


MONOTONE_SQL = """
SELECT feature, bool_and(coalesce(prev<=woe,true)) OR bool_and(coalesce(prev>=woe,true)) AS is_monotone FROM (
 SELECT feature, woe, lag(woe) OVER (PARTITION BY feature ORDER BY bin_id) AS prev FROM bins WHERE bin_id>=0) GROUP BY feature"""


@query("woe_monotone", using("bins", sql=MONOTONE_SQL))
def woe_monotone(spark, d):
    return B.monotone(_bins(spark, d))


@query("win_monotone", using("bins", sql=f"""
SELECT feature, bin_id, {r('woe',6)} AS woe, {r('lag(woe) OVER (PARTITION BY feature ORDER BY bin_id)',6)} AS prev_woe FROM bins WHERE bin_id>=0"""))
def win_monotone(spark, d):
    w = B.W.partitionBy("feature").orderBy("bin_id")
    b = _bins(spark, d).where(F.col("bin_id") >= 0)
    return b.select("feature", "bin_id", rnd(F.col("woe"), 6).alias("woe"), rnd(F.lag("woe").over(w), 6).alias("prev_woe"))


IV_SQL = f"""SELECT feature, {r('sum(iv)',4)} AS iv, count(*) FILTER (WHERE bin_id>=0) AS n_bins,
 CASE WHEN sum(iv)<0.02e0 THEN 'Useless' WHEN sum(iv)<0.1e0 THEN 'Weak' WHEN sum(iv)<0.3e0 THEN 'Medium' ELSE 'Strong' END AS strength FROM bins GROUP BY feature"""


@query("iv_summary", using("bins", sql=IV_SQL))
def iv_summary(spark, d):
    return B.iv_summary(_bins(spark, d))


@query("sort_iv", using("bins", sql=f"SELECT feature, iv, row_number() OVER (ORDER BY iv DESC, feature) AS place FROM ({IV_SQL})"))
def sort_iv(spark, d):
    order = B.W.partitionBy(F.lit(1)).orderBy(F.desc("iv"), "feature")
    return B.iv_summary(_bins(spark, d)).select("feature", "iv", F.row_number().over(order).cast("bigint").alias("place"))


@query("scorecard_table", using("bins", sql=f"""
SELECT feature, bin_id, {r('woe',4)} AS woe, beta, {r(f'{num(-V.FACTOR)}*beta*woe+{num(V.OFFSET / 5)}',1)} AS points
FROM bins JOIN (VALUES {', '.join(f"('{f}', {num(b)})" for f, b in CARD.betas.items())}) AS k(feature, beta) USING(feature)"""))
def scorecard_table(spark, d):
    return B.scorecard_points(_bins(spark, d), MODEL.coefficients(spark))


# Fitted bins: the merge is enumerated in SQL over all monotone cuts of the pre-bins.
PROBS = ",".join(str(i / V.MAX_PREBINS) for i in range(1, V.MAX_PREBINS))
view("long_train", " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, y FROM train" for f in V.FEATURES), "train")
view("pre_edges", f"SELECT feature, list_sort(list_distinct(quantile_cont(value, [{PROBS}]))) AS edges FROM long_train WHERE value IS NOT NULL GROUP BY 1", "long_train")
view("pre", """
SELECT feature, idx, count(*) AS n, sum(y) AS bad, any_value(edges) AS edges FROM (SELECT t.*, edges, len(list_filter(edges, lambda e: e<=value)) AS idx FROM long_train t JOIN pre_edges USING(feature) WHERE value IS NOT NULL) GROUP BY 1,2""",
     "long_train", "pre_edges")
view("cum", """
SELECT feature, row_number() OVER w AS j, sum(n) OVER w AS n, sum(bad) OVER w AS bad, edges[idx] AS lo, edges[idx+1] AS hi FROM pre WINDOW w AS (PARTITION BY feature ORDER BY idx)
UNION ALL SELECT DISTINCT feature, 0, 0, 0, NULL::DOUBLE, NULL::DOUBLE FROM pre""", "pre")
view("tot", "SELECT feature, sum(y)::DOUBLE AS tb, sum(1-y)::DOUBLE AS tg, count(value)::DOUBLE AS tn FROM long_train GROUP BY 1", "long_train")
view("segs", """
SELECT *, ln(g/b) AS woe, (g-b)*ln(g/b) AS iv FROM (SELECT *, (bad+h)/tb AS b, (size-bad+h)/tg AS g FROM (
 SELECT x.feature, x.j AS i, z.j AS j, z.n-x.n AS size, z.bad-x.bad AS bad, tb, tg, CASE WHEN z.bad=x.bad OR z.n-x.n=z.bad-x.bad THEN 0.5e0 ELSE 0e0 END AS h, z.hi AS hi,
   lead_lo.lo AS lo, m
 FROM cum x JOIN cum z ON z.feature=x.feature AND z.j>x.j JOIN cum lead_lo ON lead_lo.feature=x.feature AND lead_lo.j=x.j+1
 JOIN (SELECT feature, max(j) AS m FROM cum GROUP BY 1) mm ON mm.feature=x.feature JOIN tot ON tot.feature=x.feature WHERE z.n-x.n>=0.05e0*tn))""", "cum", "tot")
FIT_SQL = """
, walk AS (
 SELECT feature, dir, j, woe, 1 AS k, iv, [j] AS path FROM segs, (VALUES (1),(-1)) d(dir) WHERE i=0
 UNION ALL SELECT w.feature, dir, s.j, s.woe, k+1, w.iv+s.iv, list_append(path, s.j) FROM walk w JOIN segs s ON s.feature=w.feature AND s.i=w.j AND k<6 AND dir*w.woe<=dir*s.woe),
best AS (SELECT w.feature, path FROM walk w JOIN (SELECT feature, max(j) AS m FROM cum GROUP BY 1) mm ON mm.feature=w.feature AND w.j=m
 QUALIFY row_number() OVER (PARTITION BY w.feature ORDER BY round(iv,9) DESC, k, path)=1),
parts AS (SELECT feature, generate_subscripts(path,1) AS nth, unnest(path) AS j, path FROM best),
fitted AS (
SELECT s.feature, (nth-1)::INTEGER AS bin_id, CASE WHEN s.i=0 THEN '-Infinity'::DOUBLE ELSE lo END AS lo, CASE WHEN s.j=m THEN 'Infinity'::DOUBLE ELSE hi END AS hi,
  s.bad::BIGINT AS n_event, (size-s.bad)::BIGINT AS n_nonevent, woe, iv
FROM parts p JOIN segs s ON s.feature=p.feature AND s.j=p.j AND s.i=CASE WHEN nth=1 THEN 0 ELSE path[nth-1] END
UNION ALL SELECT feature, -1, NULL, NULL, ev::BIGINT, nev::BIGINT, ln(((nev+h)/tg)/((ev+h)/tb)), ((nev+h)/tg-(ev+h)/tb)*ln(((nev+h)/tg)/((ev+h)/tb))
FROM (SELECT *, CASE WHEN ev=0 OR nev=0 THEN 0.5e0 ELSE 0e0 END AS h FROM (SELECT feature, sum(y) AS ev, sum(1-y) AS nev FROM long_train WHERE value IS NULL GROUP BY 1)) JOIN tot USING(feature))
"""


def _fit_sql(select: str) -> str:
    head = using("segs", "cum", "tot", "long_train", "train", sql="")
    return head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + FIT_SQL + select


@query("bin_fit", _fit_sql(f"SELECT feature, bin_id, {r('lo',6)} AS lo, {r('hi',6)} AS hi, n_event, n_nonevent, {r('woe',6)} AS woe, {r('iv',6)} AS iv FROM fitted".replace(
    r('lo', 6), f"CASE WHEN isinf(lo) THEN lo ELSE {r('lo',6)} END").replace(r('hi', 6), f"CASE WHEN isinf(hi) THEN hi ELSE {r('hi',6)} END")))
def bin_fit(spark, d):
    six = lambda c: F.when(F.abs(F.col(c)) == float("inf"), F.col(c)).otherwise(rnd(F.col(c), 6)).alias(c)
    b = B.fit_bins(P.train(spark, d))
    return b.select("feature", "bin_id", six("lo"), six("hi"), "n_event", "n_nonevent", rnd(F.col("woe"), 6).alias("woe"), rnd(F.col("iv"), 6).alias("iv"))


@query("bin_scorecard", _fit_sql("SELECT account_id, " + ", ".join(
    f"(SELECT {r('woe',6)} FROM fitted b WHERE b.feature='{f}' AND CASE WHEN t.{f} IS NULL THEN bin_id=-1 ELSE t.{f}>=lo AND t.{f}<hi END) AS {f}_woe" for f in V.FEATURES) + " FROM train t"))
def bin_scorecard(spark, d):
    """Fit the bins, then encode every applicant with them."""
    df = cut_lineage(P.train(spark, d))
    card = B.to_scorecard(B.fit_bins(df))
    woes = S.with_woe(df, card, "empirical")
    return woes.select("account_id", *[rnd(F.col(f + "_woe"), 6).alias(f + "_woe") for f in card.features])


# Diagnostics at the fixed coefficients: inverses by cofactors in SQL.
def _sign(perm):
    return -1 if sum(perm[i] > perm[j] for i in range(len(perm)) for j in range(i + 1, len(perm))) % 2 else 1


def _det(idx):
    terms = []
    for perm in permutations(range(len(idx))):
        factors = "*".join(f"m{min(idx[i], idx[j])}{max(idx[i], idx[j])}" for i, j in enumerate(perm))
        terms.append(("+" if _sign(perm) > 0 else "-") + factors)
    return "(" + "".join(terms) + ")"


def _inverse_rows():
    rows = []
    for j, f in enumerate(V.FEATURES):
        rest = [i for i in range(5) if i != j]
        rows.append(f"SELECT '{f}' AS feature, {num(CARD.betas[f])} AS coefficient, {_det(rest)}/{_det(list(range(5)))} AS inv FROM mat")
    return " UNION ALL ".join(rows)


def _entries(expr):
    return ", ".join(f"{expr(a, b, i, j)} AS m{i}{j}" for i, a in enumerate(V.FEATURES) for j, b in enumerate(V.FEATURES) if i <= j)


GRAM = _entries(lambda a, b, i, j: f"sum(p*(1-p)*{a}_woe*{b}_woe)" + ("+1e-8" if i == j else ""))
CORR = _entries(lambda a, b, i, j: "1e0" if i == j else f"corr({a}_woe,{b}_woe)")
WALD_TAIL = "CASE WHEN w/2>700 THEN 0e0 ELSE greatest(0e0,1-list_sum(list_transform(range(0,2001), lambda n: exp(-w/2+(0.5e0+n)*ln(w/2)-lgamma(1.5e0+n))))) END"
WALD_SQL = f"""SELECT feature, coefficient, {r('se',6)} AS std_error, {r('w',4)} AS wald_stat, {r(WALD_TAIL,6)} AS p_value, {WALD_TAIL}<0.05e0 AS significant
FROM (SELECT *, (coefficient/(se+1e-8))^2 AS w FROM (SELECT *, sqrt(inv) AS se FROM ({_inverse_rows()})))"""
view("mat", f"SELECT {GRAM} FROM train", "train")


@query("lr_wald", using("mat", sql=WALD_SQL))
def lr_wald(spark, d):
    t = L.wald(_train(spark, d), MODEL.betas, "p")
    return t.select(
        "feature", "coefficient", rnd(F.col("std_error"), 6).alias("std_error"), rnd(F.col("wald_stat"), 4).alias("wald_stat"),
        rnd(F.col("p_value"), 6).alias("p_value"), "significant",
    )


@query("sort_pvalue", using("mat", sql=f"SELECT feature, row_number() OVER (ORDER BY p_value, wald_stat DESC) AS place FROM ({WALD_SQL})"))
def sort_pvalue(spark, d):
    t = L.wald(_train(spark, d), MODEL.betas, "p")
    order = B.W.partitionBy(F.lit(1)).orderBy(rnd(F.col("p_value"), 6), F.desc(rnd(F.col("wald_stat"), 4)))
    return t.select("feature", F.row_number().over(order).cast("bigint").alias("place"))


@query("lr_vif", using("train", sql=f"""
SELECT feature, {r('1/(1/inv+1e-10)',4)} AS vif, CASE WHEN 1/(1/inv+1e-10)<10 THEN 'OK' ELSE 'HIGH' END AS status
FROM ({_inverse_rows().replace('FROM mat', f'FROM (SELECT {CORR} FROM train)')})"""))
def lr_vif(spark, d):
    return L.vif(_train(spark, d))


# Newton's method again in SQL: recursive steps over the same cells, the linear system solved by elimination.
SIZE, SQL_STEPS = len(V.FEATURES) + 1, 12


def _eliminated(source: str) -> str:
    """Solve the symmetric system a x = g of a row, as nested selections; gives the columns d0, d1, ..."""
    upper = [(i, j) for i in range(SIZE) for j in range(i, SIZE)]
    for k in range(SIZE):
        a = [f"a{i}{j}-a{k}{i}/a{k}{k}*a{k}{j} AS a{i}{j}" if i > k else f"a{i}{j}" for i, j in upper]
        g = [f"g{i}-a{k}{i}/a{k}{k}*g{k} AS g{i}" if i > k else f"g{i}" for i in range(SIZE)]
        source = f"(SELECT k, {BETAS}, {', '.join(a + g)} FROM {source})"
    for i in reversed(range(SIZE)):
        known = "".join(f"-a{i}{j}*d{j}" for j in range(i + 1, SIZE))
        source = f"(SELECT *, (g{i}{known})/a{i}{i} AS d{i} FROM {source})"
    return source


BETAS = ", ".join(f"b{i}" for i in range(SIZE))
_X = ["1e0", *[f + "_woe" for f in V.FEATURES]]
_SUMS = ", ".join(
    [f"sum(w*p*(1-p)*{_X[i]}*{_X[j]}){'+1' if i == j and i else ''} AS a{i}{j}" for i in range(SIZE) for j in range(i, SIZE)]
    + [f"sum(w*(p-y)*{_X[i]}){f'+b{i}' if i else ''} AS g{i}" for i in range(SIZE)]
)
_LINEAR = "+".join(f"b{i}*{x}" for i, x in enumerate(_X))
NEWTON_SQL = f"""
, cells AS (
 SELECT y, {", ".join(_X[1:])}, count(*)::DOUBLE AS n FROM (SELECT y, {", ".join(
    f"CASE WHEN {f} IS NULL THEN 0e0 ELSE (SELECT woe FROM fitted b WHERE b.feature='{f}' AND t.{f}>=lo AND t.{f}<hi) END AS {f}_woe" for f in V.FEATURES)} FROM train t) GROUP BY ALL),
weighted AS (SELECT *, n*(SELECT sum(n) FROM cells)/(2*sum(n) OVER (PARTITION BY y)) AS w FROM cells),
newton AS (
 SELECT 0 AS k, {", ".join(f"0e0 AS b{i}" for i in range(SIZE))}
 UNION ALL SELECT k+1, {", ".join(f"b{i}-d{i}" for i in range(SIZE))} FROM {_eliminated(
    f"(SELECT k, {BETAS}, {_SUMS} FROM (SELECT *, 1/(1+exp(-({_LINEAR}))) AS p FROM newton, weighted WHERE k<{SQL_STEPS}) GROUP BY k, {BETAS})")})
"""
_NAMES = ["(intercept)", *V.FEATURES]


def _newton_sql() -> str:
    """Bins and coefficients from the training part only."""
    sql = _fit_sql("").replace("\ntrain AS (", "\nevery_part AS (", 1)
    sql = sql.replace("long_train AS (", "train AS (SELECT * FROM every_part WHERE split='train'),\nlong_train AS (", 1)
    rows = " UNION ALL ".join(f"SELECT '{name}' AS feature, {r(f'b{i}', 6)} AS beta FROM newton WHERE k={SQL_STEPS}" for i, name in enumerate(_NAMES))
    return sql.rstrip() + NEWTON_SQL + rows


@query("lr_fit", _newton_sql())
def lr_fit(spark, d):
    """Bins, WoE and balanced coefficients fitted on the training part."""
    df = cut_lineage(P.train(spark, d).where(F.col("split") == "train"))
    card = B.to_scorecard(B.fit_bins(df))
    intercept, betas = L.fit(S.with_woe(df, card), features=card.features)
    return L.coefficient_rows(spark, intercept, betas)


# Published versions: the fixed card, and the same card with its intercept moved to the default rate of the training part.
_SHAPS = ", ".join(f"{r(f'{num(CARD.betas[f])}*({f}_woe-(SELECT avg({f}_woe) FROM known))', 6)} AS {f}_shap" for f in V.FEATURES)
_MOVED = "CASE version WHEN 2 THEN log_odds+(SELECT ln(avg(y)/(1-avg(y))) FROM known) ELSE log_odds END"


@query("sink_artifact_versions", using("train", sql=f"""
SELECT version, account_id, split, {", ".join(f"{r(f + '_woe', 6)} AS {f}_woe" for f in V.FEATURES)}, {r('pd', 6)} AS pd, {SCORE} AS risk_score, {_SHAPS}
FROM (SELECT *, {clip(SIGMOID, V.PROB_EPS, 1 - V.PROB_EPS)} AS pd FROM (SELECT version, train.* REPLACE ({_MOVED} AS log_odds) FROM train, (VALUES (1), (2)) v(version)))""").replace(
    "\nSELECT version, account_id", ", known AS (SELECT * FROM train WHERE split='train')\nSELECT version, account_id", 1))
def sink_artifact_versions(spark, d):
    """Two scoring runs published and loaded again by version: encoded features, PD, scores and SHAP values."""
    rows = cut_lineage(P.train(spark, d))
    known = rows.where(F.col("split") == "train")
    first = replace(MODEL, mean_woe=X.mean_woe(S.with_woe(known, MODEL), MODEL))
    rate = known.agg(F.avg("default")).first()[0]
    second = replace(first, intercept=L.calibrated_intercept(first.intercept, rate))
    store = R.ArtifactStore(spark, files.fresh_dir(spark, "artifacts"))
    out = None
    for card in (first, second):
        version = store.publish(card, R.run_tables(rows, card))
        woe, pd, scores, shap = (store.table(name, version) for name in ("woe", "pd", "scores", "shap"))
        loaded = woe.join(pd, "account_id").join(scores, "account_id").join(shap, "account_id").select(
            F.lit(version).alias("version"), "account_id", "split", *[rnd(F.col(f + "_woe"), 6).alias(f + "_woe") for f in V.FEATURES],
            rnd(F.col("pd"), 6).alias("pd"), "risk_score", *[rnd(F.col(f + "_shap"), 6).alias(f + "_shap") for f in V.FEATURES],
        )
        out = loaded if out is None else out.unionByName(loaded)
    return out
