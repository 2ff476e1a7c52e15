"""Registered queries: estimators, censoring curves, Gray's test, weights, concordance and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import wilson
from ..operators import censoring, concordance, evaluation, gray, incidence, scans
from ..sources import tables
from . import sql

DAYS = [500.0, 1000.0, 2000.0]
QUERIES, ORACLE_SQL = {}, {}


def register(name: str, text: str):
    def keep(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return keep


def r8(**cols):
    return [F.round(c, 8).alias(n) for n, c in cols.items()]


def _sv(spark, d):
    return tables.shipments(spark, d)


@register("km_survival", f"WITH {sql.SV}, {sql.incidence('grp')} SELECT grp, time, round(sl, 8) AS s_left, round(s, 8) AS s FROM f")
def km_survival(spark, d):
    km = incidence.kaplan_meier(incidence.time_counts(_sv(spark, d), ["grp"]), ["grp"])
    return km.select("grp", "time", *r8(s_left=F.col("s_left"), s=F.col("s")))


@register("nelson_aalen", f"WITH {sql.SV}, {sql.counts('grp')} SELECT grp, time, round(sum(d / y) OVER {sql.sofar('grp')}, 8) AS chf FROM c")
def nelson_aalen(spark, d):
    return incidence.nelson_aalen(incidence.time_counts(_sv(spark, d), ["grp"]), ["grp"]).select("grp", "time", *r8(chf=F.col("chf")))


@register("nelson_aalen_cause", f"WITH {sql.SV}, {sql.counts('grp')} SELECT grp, time, round(sum(d1 / y) OVER {sql.sofar('grp')}, 8) AS chf_1, round(sum(d2 / y) OVER {sql.sofar('grp')}, 8) AS chf_2 FROM c")
def nelson_aalen_cause(spark, d):
    c = incidence.time_counts(_sv(spark, d), ["grp"])
    for k in (1, 2):
        c = incidence.nelson_aalen(c, ["grp"], f"d_{k}", f"chf_{k}")
    return c.select("grp", "time", *r8(chf_1=F.col("chf_1"), chf_2=F.col("chf_2")))


@register("aj_cif_grouped", f"WITH {sql.SV}, {sql.incidence('grp')} SELECT grp, time, round(f1, 8) AS f_1, round(f2, 8) AS f_2 FROM f WHERE d > 0")
def aj_cif_grouped(spark, d):
    f = incidence.cif(incidence.time_counts(_sv(spark, d), ["grp"]), ["grp"])
    return f.where("d > 0").select("grp", "time", *r8(f_1=F.col("f_1"), f_2=F.col("f_2")))


_LONG = "SELECT grp, 1 AS cause, time, f1 AS cif, v1 AS var FROM v WHERE d1 > 0 UNION ALL SELECT grp, 2, time, f2, v2 FROM v WHERE d2 > 0"
_POINTS = f"""WITH {sql.SV}, {sql.variance('grp')}, l AS ({_LONG}), q AS (SELECT unnest([500.0, 1000.0, 2000.0])::DOUBLE AS t)
SELECT grp, cause, t, round(coalesce(max_by(cif, time) FILTER (WHERE time <= t), 0), 8) AS cif, round(coalesce(max_by(var, time) FILTER (WHERE time <= t), 0), 10) AS var
FROM l, q GROUP BY grp, cause, t"""


@register("aj_cif_variance", f"WITH {sql.SV}, {sql.variance('grp')}, l AS ({_LONG}) SELECT grp, cause, time, round(cif, 8) AS cif, round(var, 10) AS var FROM l")
def aj_cif_variance(spark, d):
    c = incidence.CumulativeIncidence().fit(_sv(spark, d), group="grp").curves
    return c.select("grp", "cause", "time", F.round("cif", 8).alias("cif"), F.round("var", 10).alias("var"))


@register("aj_cif_timepoints", _POINTS)
def aj_cif_timepoints(spark, d):
    c = incidence.CumulativeIncidence().fit(_sv(spark, d), group="grp").timepoints(DAYS)
    return c.select("grp", "cause", "t", F.round("cif", 8).alias("cif"), F.round("var", 10).alias("var"))


@register("aj_restricted_causes", f"WITH {sql.SV}, {sql.incidence('grp')} SELECT grp, 2 AS cause, time, round(f2, 8) AS cif FROM f WHERE d2 > 0")
def aj_restricted_causes(spark, d):
    return incidence.CumulativeIncidence([2]).fit(_sv(spark, d), group="grp").curves.select("grp", "cause", "time", F.round("cif", 8).alias("cif"))


@register("aj_signup_outcome", f"WITH {sql.SIGNUP}, {sql.incidence()} SELECT round(time, 6) AS time, round(f1, 8) AS f_1, round(f2, 8) AS f_2 FROM f WHERE d > 0")
def aj_signup_outcome(spark, d):
    f = incidence.cif(incidence.time_counts(tables.signup_outcome(spark, d)))
    return f.where("d > 0").select(F.round("time", 6).alias("time"), *r8(f_1=F.col("f_1"), f_2=F.col("f_2")))


for _name, _kind, _fit in (("km_censor_uno", sql.UNO, censoring.km_censor_uno), ("km_censor_score", sql.SCORE, censoring.km_censor_score), ("km_censor_fg", sql.FG, censoring.km_censor_fg)):
    register(_name, f"WITH {sql.SV}, {sql.censor(*_kind)} SELECT time, round(g, 8) AS g, round(g_left, 8) AS g_left FROM k")(
        lambda spark, d, fit=_fit: fit(_sv(spark, d)).select("time", *r8(g=F.col("g"), g_left=F.col("g_left")))
    )


@register("km_censor_fg_strata", f"WITH {sql.SV}, {sql.censor(*sql.FG, by='grp')} SELECT grp, time, round(g, 8) AS g, round(g_left, 8) AS g_left FROM k")
def km_censor_fg_strata(spark, d):
    return censoring.km_censor_fg(_sv(spark, d), ["grp"]).select("grp", "time", *r8(g=F.col("g"), g_left=F.col("g_left")))


@register("asof_censoring_lookup", f"""WITH {sql.SIGNUP}, {sql.censor(*sql.SCORE)}, q AS (SELECT event_id, value * 1000 AS at FROM sv)
SELECT event_id, round(coalesce((SELECT max_by(g, time) FROM k WHERE k.time <= q.at), 1.0), 8) AS g FROM q""")
def asof_censoring_lookup(spark, d):
    rows = tables.signup_outcome(spark, d)
    asked = rows.select("event_id", (F.col("value") * 1000).alias("at"))
    knots = censoring.km_censor_score(rows).select(F.col("time").alias("at"), "g")
    return scans.asof_join(asked, knots, "at", "g", default=1.0).select("event_id", F.round("g", 8).alias("g"))


# ---- Gray's test ----------------------------------------------------------------------------


def _gray(spark, d, rho):
    return gray.gray_terms(_sv(spark, d), ["F", "O"], 1, rho)


_GRAY = {r: f"WITH {sql.SV}, {sql.gray(r)} " for r in (0, 1)}


@register("gray_score", _GRAY[0] + "SELECT round(score, 6) AS score FROM r")
def gray_score(spark, d):
    return _gray(spark, d, 0).select(F.round("score0", 6).alias("score"))


@register("gray_covariance", _GRAY[0] + "SELECT round(v, 5) AS v FROM r")
def gray_covariance(spark, d):
    return _gray(spark, d, 0).select(F.round("v_0_0", 5).alias("v"))


@register("gray_stat", _GRAY[0] + "SELECT round(score * score / v, 7) AS stat FROM r")
def gray_stat(spark, d):
    return _gray(spark, d, 0).select(F.round(F.col("score0") * F.col("score0") / F.col("v_0_0"), 7).alias("stat"))


@register("gray_rho1", _GRAY[1] + "SELECT round(score, 6) AS score, round(score * score / v, 7) AS stat FROM r")
def gray_rho1(spark, d):
    return _gray(spark, d, 1).select(F.round("score0", 6).alias("score"), F.round(F.col("score0") * F.col("score0") / F.col("v_0_0"), 7).alias("stat"))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("gray_five_groups", f"WITH {sql.SEG}, {sql.gray_many(_SEGMENTS)} SELECT round(stat, 5) AS statistic, round(exp(-stat / 2) * (1 + stat / 2), 7) AS p_value, 4 AS df FROM r")
def gray_five_groups(spark, d):
    result = gray.gray_test(tables.shipments_by_segment(spark, d))
    return spark.createDataFrame([(round(result.statistic, 5), round(result.p_value, 7), result.df)], "statistic double, p_value double, df int")


# ---- weights and concordance -------------------------------------------------------------------

_RISK = "l_extendedprice"


@register("uno_gmin_auto", f"""WITH {sql.SIGNUP}, {sql.censor(*sql.UNO)}, e AS (SELECT g_left AS g, greatest(g_left, 1e-12) AS s, row_number() OVER (ORDER BY g_left) AS i, count(*) OVER () AS n FROM sv JOIN k USING (time) WHERE event <> 0),
t AS (SELECT g, i, n, sum(1 / s ** 2) OVER w AS w1, sum(1 / s ** 4) OVER w AS w2 FROM e WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, least(greatest(20, ceil(0.2 * n)), n) AS target FROM t)
SELECT round(CASE WHEN (SELECT min(g) FROM e) >= 1 - 1e-12 THEN 0 ELSE coalesce(min(g) FILTER (WHERE n - i + 1 >= target AND w1 * w1 / w2 >= target), max(g) FILTER (WHERE n - i + 1 >= target)) END, 8) AS gmin FROM q""")
def uno_gmin_auto(spark, d):
    rows = tables.signup_outcome(spark, d)
    curve = censoring.km_censor_uno(rows).select("time", "g_left")
    g = rows.where("event <> 0").join(curve, "time").groupBy(F.col("g_left").alias("g")).agg(F.count("*").cast("double").alias("n"))
    return spark.createDataFrame([(round(concordance.gmin_auto(g), 8),)], "gmin double")


_W = f"{sql.SIGNUP}, {sql.censor(*sql.UNO)}, u AS (SELECT event_id, event, time, value AS risk, CASE WHEN g_left >= 0.05 THEN 1 / greatest(g_left, 1e-12) ** 2 ELSE 2.220446049250313e-16 END AS w FROM sv JOIN k USING (time))"


@register("uno_weights", f"WITH {_W} SELECT event_id, round(w, 6) AS w FROM u")
def uno_weights(spark, d):
    return concordance.compute_uno_weights(tables.signup_outcome(spark, d), gmin=0.05).select("event_id", F.round("w", 6).alias("w"))


@register("cindex_cause", f"""WITH {sql.SIGNUP}, u AS (SELECT time, event, value AS risk FROM sv)
SELECT CAST(count(*) AS DOUBLE) AS comparable, CAST(sum(CASE WHEN j.risk < i.risk THEN 1 ELSE 0 END) AS DOUBLE) AS concordant, CAST(sum(CASE WHEN j.risk = i.risk THEN 1 ELSE 0 END) AS DOUBLE) AS tied
FROM u i JOIN u j ON j.time > i.time WHERE i.event = 1""")
def cindex_cause(spark, d):
    return concordance.concordance_pairs(tables.signup_outcome(spark, d).withColumnRenamed("value", "risk"))


@register("cindex_shipments", f"""WITH {sql.SV}, u AS (SELECT time, event, round(l_quantity) AS risk, CAST(count(*) AS DOUBLE) AS n FROM sv GROUP BY ALL)
SELECT sum(i.n * j.n) AS comparable, sum(CASE WHEN j.risk < i.risk THEN i.n * j.n ELSE 0 END) AS concordant, sum(CASE WHEN j.risk = i.risk THEN i.n * j.n ELSE 0 END) AS tied
FROM u i JOIN u j ON j.time > i.time WHERE i.event = 1""")
def cindex_shipments(spark, d):
    return concordance.concordance_pairs(_sv(spark, d).withColumn("risk", F.round("l_quantity")))


@register("cindex_uno", f"""WITH {_W},
a AS (SELECT sum(2 * i.w) AS den, sum(2 * i.w * (CASE WHEN j.risk < i.risk THEN 1 WHEN j.risk = i.risk THEN 0.5 ELSE 0 END)) AS num FROM u i JOIN u j ON j.time > i.time OR (j.time = i.time AND j.event = 0) WHERE i.event = 1),
b0 AS (SELECT time, risk, count(*) AS c, sum(w) AS w FROM u WHERE event = 1 GROUP BY time, risk),
b1 AS (SELECT time, sum(c) AS c, sum(w) AS w, sum(CASE WHEN c > 1 THEN (c - 1) * w ELSE 0 END) AS tie FROM b0 GROUP BY time),
b AS (SELECT coalesce(sum((c - 1) * w), 0) AS den, coalesce(sum(0.5 * (c - 1) * w + 0.5 * tie), 0) AS num FROM b1 WHERE c > 1),
x AS (SELECT sum(2 * sqrt(i.w * j.w)) AS den, sum(2 * sqrt(i.w * j.w) * (CASE WHEN j.risk < i.risk THEN 1 WHEN j.risk = i.risk THEN 0.5 ELSE 0 END)) AS num FROM u i JOIN u j ON j.time <= i.time WHERE i.event = 1 AND j.event = 2)
SELECT round((a.num + b.num + x.num) / (a.den + b.den + x.den), 8) AS c FROM a, b, x""")
def cindex_uno(spark, d):
    rows = concordance.compute_uno_weights(tables.signup_outcome(spark, d).withColumnRenamed("value", "risk"), gmin=0.05)
    return concordance.uno_terms(rows).select(F.round(F.col("numer") / F.col("denom"), 8).alias("c"))


# ---- evaluation -------------------------------------------------------------------------------------


def _pred(spark, d):
    """Deterministic predictions of two models at three times."""
    sv = _sv(spark, d)
    cols = {f"{m}_{i}": F.least(F.lit(1.0), F.round(c / s * (t / 2500.0), 6)) for m, c, s in (("price", F.col("l_extendedprice"), 105000.0), ("quantity", F.col("l_quantity"), 50.0)) for i, t in enumerate(DAYS)}
    return evaluation.long_predictions(sv.select("time", "event", *[c.alias(n) for n, c in cols.items()]), {m: [f"{m}_{i}" for i in range(3)] for m in ("price", "quantity")}, DAYS), sv.select("time", "event")


_PRED = f"""{sql.SV}, {sql.censor(*sql.SCORE)}, q AS (SELECT unnest([500.0, 1000.0, 2000.0])::DOUBLE AS t),
p AS (SELECT 'price' AS model, t, time, event, least(1.0, round(l_extendedprice / 105000.0 * (t / 2500.0), 6)) AS p FROM sv, q
      UNION ALL SELECT 'quantity', t, time, event, least(1.0, round(l_quantity / 50.0 * (t / 2500.0), 6)) FROM sv, q)"""
_TERMS = f"""{_PRED}, gt AS (SELECT t, coalesce((SELECT max_by(g, time) FROM k WHERE time <= t), 1.0) AS g FROM q),
w AS (SELECT model, p.t, p, CASE WHEN event = 1 AND time <= p.t THEN 1 / g_left ELSE 0 END AS wc,
       CASE WHEN event = 2 AND time <= p.t THEN 1 / g_left WHEN time > p.t THEN 1 / gt.g ELSE 0 END AS wn
     FROM p JOIN k USING (time) JOIN gt ON gt.t = p.t),
h AS (SELECT model, t, p, sum(wc) AS wc, sum(wn) AS wn, sum(wc * (1 - p) * (1 - p) + wn * p * p) AS sq, count(*) AS n FROM w GROUP BY model, t, p),
l AS (SELECT *, coalesce(sum(wn) OVER (PARTITION BY model, t ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM h),
m AS (SELECT model, t, sum(sq) / sum(n) AS brier, sum(wc * (low + 0.5 * wn)) / (sum(wc) * sum(wn)) AS auc FROM l GROUP BY model, t)"""


@register("brier_ipcw", f"WITH {_TERMS} SELECT model, t, round(brier, 8) AS brier FROM m")
def brier_ipcw(spark, d):
    return evaluation.brier_auc(*_pred(spark, d), DAYS).select("model", "t", F.round("brier", 8).alias("brier"))


@register("auc_ipcw", f"WITH {_TERMS} SELECT model, t, round(auc, 8) AS auc FROM m")
def auc_ipcw(spark, d):
    return evaluation.brier_auc(*_pred(spark, d), DAYS).select("model", "t", F.round("auc", 8).alias("auc"))


_MEAN = "{t}, s AS (SELECT model, t - lag(t) OVER w AS dt, ({c} + lag({c}) OVER w) / 2 AS v, max(t) OVER (PARTITION BY model) - min(t) OVER (PARTITION BY model) AS span FROM m WINDOW w AS (PARTITION BY model ORDER BY t)) SELECT model, round(sum(dt * v) / max(span), 8) AS {n} FROM s GROUP BY model"


@register("ibs", "WITH " + _MEAN.format(t=_TERMS, c="brier", n="ibs"))
def ibs(spark, d):
    return evaluation.time_average(evaluation.brier_auc(*_pred(spark, d), DAYS), "brier").select("model", F.round("brier", 8).alias("ibs"))


@register("iauc", "WITH " + _MEAN.format(t=_TERMS, c="auc", n="iauc"))
def iauc(spark, d):
    return evaluation.time_average(evaluation.brier_auc(*_pred(spark, d), DAYS), "auc").select("model", F.round("auc", 8).alias("iauc"))


_Z = "1.959963984540054"
_CALIB = f"""{_PRED}, br AS (SELECT model, t, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS b FROM p GROUP BY model, t),
bn AS (SELECT p.model || '|' || p.t || '|' || len([x FOR x IN b IF x < p.p]) AS grp, p.model, p.t, len([x FOR x IN b IF x < p.p]) AS bin, p.p, time, event FROM p JOIN br ON br.model = p.model AND br.t = p.t),
{sql.incidence('grp', 'bn')},
o AS (SELECT bn0.grp, coalesce(max_by(f1, time) FILTER (WHERE time <= bn0.t), 0) AS obs FROM (SELECT DISTINCT grp, t FROM bn) bn0 JOIN f ON f.grp = bn0.grp GROUP BY bn0.grp),
a AS (SELECT model, t, bin, grp, CAST(sum(CAST(p AS DECIMAL(38, 12))) AS DOUBLE) / count(*) AS pred, CAST(count(*) AS DOUBLE) AS n FROM bn GROUP BY ALL)"""


#: the predictions have six decimals, so means of them end on 5 at the ninth now and then: these go up on both sides
_UP = 1e-13


@register("calibration_deciles", f"""WITH {_CALIB} SELECT model, t AS times, CAST(bin AS INTEGER) AS bin, round(pred + {_UP}, 8) AS predicted_decile, round(obs, 8) AS observed_freq,
  round(greatest(0, (obs + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(obs * (1 - obs) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 8) AS lower_ci,
  round(least(1, (obs + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(obs * (1 - obs) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 8) AS upper_ci, CAST(n AS BIGINT) AS bin_n FROM a JOIN o USING (grp)""")
def calibration_deciles(spark, d):
    c = evaluation.calibration_cr(_pred(spark, d)[0])
    return c.select("model", "times", "bin", *r8(predicted_decile=F.col("predicted_decile") + _UP, observed_freq=F.col("observed_freq"), lower_ci=F.col("lower_ci"), upper_ci=F.col("upper_ci")), "bin_n")


@register("wilson_ci", f"""WITH x AS (SELECT l_returnflag AS flag, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN l_quantity > 40 THEN 1.0 ELSE 0.0 END) AS p FROM lineitem GROUP BY 1)
SELECT flag, round(greatest(0, ((p + {_Z} * {_Z} / (2 * n)) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 8) AS lower_ci,
       round(least(1, ((p + {_Z} * {_Z} / (2 * n)) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 8) AS upper_ci FROM x""")
def wilson_ci(spark, d):
    x = tables.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").cast("double").alias("n"), F.avg(F.when(F.col("l_quantity") > 40, 1.0).otherwise(0.0)).alias("p"))
    low, high = wilson(F.col("p"), F.col("n"))
    return x.select("flag", *r8(lower_ci=low, upper_ci=high))


_BOOT = f"""{sql.SIGNUP}, f AS (SELECT time, event, least(1.0, abs(value) / 500) AS p, row_number() OVER (ORDER BY event_id) - 1 AS i FROM sv), nn AS (SELECT count(*) AS n FROM f),
dr AS (SELECT rep, CAST(floor((CAST(CAST('0x' || substr(md5('0|' || rep || '|' || j), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496 * n) AS BIGINT) AS i FROM (SELECT unnest(range(1, 21)) AS rep), (SELECT unnest(range(n)) AS j, n FROM nn)),
rw AS (SELECT rep, f.*, m FROM (SELECT rep, i, count(*) AS m FROM dr GROUP BY ALL UNION ALL SELECT 0, i, 1 FROM f) JOIN f USING (i)),
k0 AS (SELECT rep, time, CAST(sum(m) AS DOUBLE) AS n, CAST(sum(CASE WHEN event <> 0 THEN m ELSE 0 END) AS DOUBLE) AS d FROM rw GROUP BY rep, time),
k1 AS (SELECT *, sum(n) OVER (PARTITION BY rep ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM k0),
k2 AS (SELECT *, CASE WHEN y - d > 0 THEN 1 - (n - d) / (y - d) ELSE 1 END AS keep FROM k1),
k AS (SELECT *, product(keep) OVER {sql.sofar('rep')} AS g, coalesce(product(keep) OVER {sql.prior('rep')}, 1.0) AS g_left FROM k2),
gt AS (SELECT rep, t, coalesce(max_by(g, time) FILTER (WHERE time <= t), 1.0) AS g FROM k, (SELECT unnest([20000.0, 60000.0, 120000.0])::DOUBLE AS t) GROUP BY rep, t),
w AS (SELECT rw.rep, t, p, CASE WHEN event = 1 AND rw.time <= t THEN m / g_left ELSE 0 END AS wc, CASE WHEN event = 2 AND rw.time <= t THEN m / g_left WHEN rw.time > t THEN m / gt.g ELSE 0 END AS wn
  FROM rw JOIN k ON k.rep = rw.rep AND k.time = rw.time JOIN gt ON gt.rep = rw.rep),
h AS (SELECT rep, t, p, sum(wc) AS wc, sum(wn) AS wn FROM w GROUP BY ALL),
l AS (SELECT *, coalesce(sum(wn) OVER (PARTITION BY rep, t ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM h),
a AS (SELECT rep, t, sum(wc * (low + 0.5 * wn)) / (sum(wc) * sum(wn)) AS auc FROM l GROUP BY rep, t)"""


@register("score_bootstrap", f"""WITH {_BOOT} SELECT 'value' AS model, t AS times, round(max(auc) FILTER (WHERE rep = 0), 7) AS auc,
  round(quantile_cont(auc, 0.025) FILTER (WHERE rep > 0), 7) AS lower, round(quantile_cont(auc, 0.975) FILTER (WHERE rep > 0), 7) AS upper FROM a GROUP BY t""")
def score_bootstrap(spark, d):
    """Percentile intervals of AUC over 20 replicates (rows of the signup view)."""
    rows = tables.signup_outcome(spark, d).select(F.col("event_id").alias("row_id"), "time", "event", F.least(F.lit(1.0), F.abs("value") / 500).alias("p"))
    times = [float(t) for t in (20000, 60000, 120000)]
    pred = evaluation.long_predictions(rows, {"value": ["p"] * 3}, times, ("row_id", "time", "event"))
    found = evaluation.score_cr(pred, times, n_bootstrap=20).auc
    return found.select("model", "times", *[F.round(c, 7).alias(n) for c, n in (("AUC", "auc"), ("lower", "lower"), ("upper", "upper"))])
