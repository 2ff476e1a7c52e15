"""Registered queries: grids, split search, trees, minimal depth, regression and whole models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import grids, incidence, minimal_depth, risk, splits
from ..operators.forest import CompetingRiskForest
from ..operators.regression import CauseSpecificCox, FineGrayRegression, PenalizedFineGrayRegression, column_scales, penalty_slope, proximal
from ..sources import outcomes, tables
from . import forest_sql, sql

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, text: str = ""):
    def keep(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return keep


def _sv(spark, d):
    return tables.shipments(spark, d)


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- grids -----------------------------------------------------------------------------------------

_EVENT = "e AS (SELECT DISTINCT time AS v FROM sv WHERE event > 0)"
_GRID = "[{}]".format(", ".join(repr(float(x)) for x in np.linspace(0, 1, 20)))
_EIGHTHS = "[0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]"


@register("event_time_grid", f"WITH {sql.SIGNUP}, {_EVENT} SELECT round(v, 6) AS t FROM e")
def event_time_grid(spark, d):
    return _rows(spark, [(round(float(t), 6),) for t in grids.event_time_grid(tables.signup_outcome(spark, d), None)], "t double")


@register("time_grid_quantile", f"WITH {sql.SV}, {_EVENT}, q AS (SELECT unnest(quantile_cont(v, {_GRID})) AS t FROM e) SELECT DISTINCT round(t, 6) AS t FROM q")
def time_grid_quantile(spark, d):
    return _rows(spark, [(round(float(t), 6),) for t in grids.event_time_grid(_sv(spark, d), 20)], "t double")


_G = f"{_EVENT}, g AS (SELECT array_agg(DISTINCT t ORDER BY t) AS g FROM (SELECT unnest(quantile_cont(v, {_GRID})) AS t FROM e))"
_TENTHS = "[{}]".format(", ".join(repr(float(x)) for x in np.linspace(0, 1, 11)))
_COARSE = f"""{_G}, gi AS (SELECT unnest(g) AS t, generate_subscripts(g, 1) - 1 AS i FROM g), br AS (SELECT unnest(b) AS bb, generate_subscripts(b, 1) - 1 AS j FROM (SELECT quantile_cont(t, {_TENTHS}) AS b FROM gi)),
bi AS (SELECT j, (SELECT count(*) FROM gi WHERE gi.t < br.bb) AS s FROM br WHERE j < 10),
gc AS (SELECT gi.i, gi.t, least((SELECT count(*) FROM bi WHERE s <= gi.i) - 1, 9) AS c FROM gi)"""


@register("time_grid_coarse", f"WITH {sql.SV}, {_COARSE} SELECT CAST(i AS INTEGER) AS i, CAST(c AS INTEGER) AS c FROM gc")
def time_grid_coarse(spark, d):
    grid = grids.event_time_grid(_sv(spark, d), 20)
    return _rows(spark, [(i, int(c)) for i, c in enumerate(grids.coarsen_time_grid(grid, 10))], "i int, c int")


_EDGES = f"ed AS (SELECT (SELECT quantile_cont(v, {_EIGHTHS}) FROM (SELECT DISTINCT l_quantity AS v FROM sv)) AS eq, (SELECT quantile_cont(v, {_EIGHTHS}) FROM (SELECT DISTINCT l_extendedprice AS v FROM sv)) AS ep)"
_FEATURES = ["l_quantity", "l_extendedprice"]


@register("feature_bin_edges", f"WITH {sql.SV}, {_EDGES} SELECT 'l_quantity' AS feature, round(unnest(eq), 6) AS edge FROM ed UNION ALL SELECT 'l_extendedprice', round(unnest(ep), 6) FROM ed")
def feature_bin_edges(spark, d):
    found = grids.feature_bin_edges(_sv(spark, d), _FEATURES, 8)
    return _rows(spark, [(c, round(float(e), 6)) for c, es in zip(_FEATURES, found) for e in es], "feature string, edge double")


@register("bin_thresholds", f"WITH {sql.SV}, {_EDGES}, t AS (SELECT unnest(eq) AS e, generate_subscripts(eq, 1) - 1 AS b FROM ed) SELECT CAST(b AS INTEGER) AS bin, round(e, 6) AS threshold FROM t UNION ALL SELECT 7, CAST('inf' AS DOUBLE)")
def bin_thresholds(spark, d):
    edges = grids.feature_bin_edges(_sv(spark, d), _FEATURES, 8)[0]
    return _rows(spark, [(b, round(grids.bin_to_threshold(edges, b), 6)) for b in range(8)], "bin int, threshold double")


_BINNED = f"""{_EDGES}, {_COARSE}, bn AS (
  SELECT len([e FOR e IN eq IF e <= l_quantity]) AS b0, len([e FOR e IN ep IF e <= l_extendedprice]) AS b1, event,
         greatest(len([x FOR x IN g.g IF x <= time]) - 1, 0) AS tf FROM sv, ed, g),
bt AS (SELECT bn.*, gc.c AS t FROM bn JOIN gc ON gc.i = bn.tf)"""


def _binned(spark, d):
    sv = _sv(spark, d)
    grid = grids.event_time_grid(sv, 20)
    return splits.binned_rows(sv, _FEATURES, grids.feature_bin_edges(sv, _FEATURES, 8), grid, grids.coarsen_time_grid(grid, 10)), grid


@register("apply_bins", f"WITH {sql.SV}, {_BINNED} SELECT CAST(b0 AS INTEGER) AS b0, CAST(b1 AS INTEGER) AS b1, CAST(t AS INTEGER) AS t, count(*) AS n FROM bt GROUP BY ALL")
def apply_bins(spark, d):
    return _binned(spark, d)[0].groupBy("b0", "b1", "t").agg(F.count("*").alias("n"))


# ---- split search -------------------------------------------------------------------------------------------

_CELLS = f"""{_BINNED}, lg AS (SELECT 0 AS feature, b0 AS bin, t, event FROM bt UNION ALL SELECT 1, b1, t, event FROM bt),
cg AS (SELECT f.feature, b.bin, t.t FROM (SELECT DISTINCT feature FROM lg) f, (SELECT unnest(range(8)) AS bin) b, (SELECT unnest(range(10)) AS t) t),
c1 AS (SELECT cg.feature, cg.bin, cg.t, CAST(count(lg.event) AS DOUBLE) AS n, CAST(sum(CASE WHEN lg.event = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d1, CAST(sum(CASE WHEN lg.event = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS d2
  FROM cg LEFT JOIN lg ON lg.feature = cg.feature AND lg.bin = cg.bin AND lg.t = cg.t GROUP BY 1, 2, 3),
c2 AS (SELECT *, sum(n) OVER l AS ln, sum(d1) OVER l AS l1, sum(d2) OVER l AS l2, sum(n) OVER a AS an, sum(d1) OVER a AS a1, sum(d2) OVER a AS a2
  FROM c1 WINDOW l AS (PARTITION BY feature, t ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY feature, t)),
c3 AS (SELECT *, sum(an) OVER s AS y, sum(ln) OVER s AS yl, coalesce(sum(a1) OVER p, 0) AS o2, coalesce(sum(l1) OVER p, 0) AS ol2, coalesce(sum(a2) OVER p, 0) AS o1, coalesce(sum(l2) OVER p, 0) AS ol1
  FROM c2 WINDOW s AS (PARTITION BY feature, bin ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p AS (PARTITION BY feature, bin ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _stat(cr: bool, w=(1.0, 1.0), causes=(1, 2)) -> str:
    if cr:
        num = " + ".join(f"(CASE WHEN y >= 1 THEN {w[k - 1]} * (l{k} - a{k} * (yl + ol{k}) / (y + o{k})) ELSE 0 END)" for k in causes)
        var = " + ".join(f"(CASE WHEN y >= 2 THEN {w[k - 1] ** 2} * a{k} * (yl + ol{k}) * (y + o{k} - yl - ol{k}) * (y + o{k} - a{k}) / ((y + o{k}) * (y + o{k}) * (y + o{k} - 1)) ELSE 0 END)" for k in causes)
    else:
        num = "CASE WHEN y >= 2 THEN l1 - a1 * yl / y ELSE 0 END"
        var = "CASE WHEN y >= 2 THEN a1 * yl * (y - yl) * (y - a1) / (y * y * (y - 1)) ELSE 0 END"
    return f"""{_CELLS}, st AS (SELECT feature, bin, sum({num}) AS num, sum({var}) AS var, max(yl) FILTER (WHERE t = 0) AS n_left, max(y) FILTER (WHERE t = 0) AS n FROM c3 GROUP BY feature, bin),
ss AS (SELECT *, num * num / var AS stat FROM st WHERE var >= 1e-12 AND n_left >= 3 AND n - n_left >= 3)"""


def _root(spark, d, rule, weights=None, cause=1):
    rows, _ = _binned(spark, d)
    return splits.split_statistics(rows.withColumn("node", F.lit(1)), 2, 10, 2, rule, cause, 3, weights=weights)


_ROOT = "SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, round(num, 5) AS num, round(var, 4) AS var, round(stat, 6) AS stat FROM ss"
for _name, _rule, _cr, _w in (("logrank_lau_root", "logrankCR", True, None), ("logrank_std_root", "logrank", False, None), ("logrank_weighted_root", "logrankCR", True, (2.0, 0.5))):
    register(_name, f"WITH {sql.SV}, {_stat(_cr, _w or (1.0, 1.0))} {_ROOT}")(
        lambda spark, d, rule=_rule, w=_w: _root(spark, d, rule, w).select("feature", "bin", F.round("num", 5).alias("num"), F.round("var", 4).alias("var"), F.round("stat", 6).alias("stat"))
    )

for _cause in (1, 2):
    register(f"logrank_relabeled_root_{_cause}", f"WITH {sql.SV}, {_stat(True, causes=(_cause,))} {_ROOT}")(
        lambda spark, d, k=_cause: _root(spark, d, "relabeled", cause=k).select("feature", "bin", F.round("num", 5).alias("num"), F.round("var", 4).alias("var"), F.round("stat", 6).alias("stat"))
    )

_BEST = "SELECT CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin, round(stat, 6) AS stat FROM ss ORDER BY ss.stat DESC, feature, bin LIMIT 1"
for _name, _rule, _cr in (("best_split_root_cr", "logrankCR", True), ("best_split_root_lr", "logrank", False)):
    register(_name, f"WITH {sql.SV}, {_stat(_cr)} {_BEST}")(
        lambda spark, d, rule=_rule: splits.best_splits(_root(spark, d, rule)).select("feature", "bin", F.round("stat", 6).alias("stat"))
    )

_LEAVES = f"""{_stat(True)}, tb AS (SELECT feature AS sf, bin AS sb FROM ss ORDER BY stat DESC, feature, bin LIMIT 1),
nd AS (SELECT CAST(CASE WHEN (CASE sf WHEN 0 THEN b0 ELSE b1 END) <= sb THEN '2' ELSE '3' END AS VARCHAR) AS grp, CAST(tf AS DOUBLE) AS time, event FROM bt, tb),
{sql.incidence('grp', 'nd')}"""


def _leaf_rows(spark, d):
    rows, _ = _binned(spark, d)
    grown, _ = splits.grow(rows, 2, 10, max_depth=1)
    return splits.leaf_counts(grown)


@register("tree_leaf_counts", f"WITH {sql.SV}, {_LEAVES} SELECT CAST(grp AS BIGINT) AS node, CAST(time AS INTEGER) AS t, n, d1 AS d_1, d2 AS d_2, y FROM f")
def tree_leaf_counts(spark, d):
    return _leaf_rows(spark, d).select("node", "t", "n", "d_1", "d_2", "y")


@register("tree_leaf_cif", f"WITH {sql.SV}, {_LEAVES} SELECT CAST(grp AS BIGINT) AS node, CAST(time AS INTEGER) AS t, round(f1, 8) AS f_1, round(f2, 8) AS f_2 FROM f")
def tree_leaf_cif(spark, d):
    return incidence.cif(_leaf_rows(spark, d), ["node"], 2, "t").select("node", "t", F.round("f_1", 8).alias("f_1"), F.round("f_2", 8).alias("f_2"))


@register("tree_leaf_chf", f"WITH {sql.SV}, {_LEAVES} SELECT CAST(grp AS BIGINT) AS node, CAST(time AS INTEGER) AS t, round(sum(d1 / y) OVER {sql.sofar('grp')}, 8) AS chf_1 FROM f")
def tree_leaf_chf(spark, d):
    return incidence.nelson_aalen(_leaf_rows(spark, d), ["node"], "d_1", "chf_1", "t").select("node", "t", F.round("chf_1", 8).alias("chf_1"))


_DEPTH2 = forest_sql.grown(False, rows=f"{sql.SV}, {_BINNED}, fr AS (SELECT b0, b1, event, tf, t FROM bt)").split("sp AS (")[0]


@register("tree_depth2", f"""WITH {_DEPTH2.rstrip().rstrip(',')}
SELECT 0 AS depth, CAST(node + 1 AS BIGINT) AS node, feature, CAST(bin AS INTEGER) AS bin, round(stat, 5) AS stat FROM s0 UNION ALL SELECT 1, CAST(node + 1 AS BIGINT), feature, CAST(bin AS INTEGER), round(stat, 5) FROM s1""")
def tree_depth2(spark, d):
    rows, _ = _binned(spark, d)
    _, found = splits.grow(rows, 2, 10, max_depth=2, min_split=6)
    return _rows(spark, [(*r[:4], round(r[4], 5)) for r in found], "depth int, node long, feature int, bin int, stat double")


_TREES = "tr AS (SELECT p_partkey % 10 AS tree_id, p_partkey AS node_id, p_size % 6 AS depth, CAST(p_partkey % 7 % 5 AS INTEGER) AS feature, p_size % 3 = 0 AS is_leaf FROM part)"


def _trees(spark, d):
    """Every part as a node of an invented tree."""
    return tables.table(spark, d, "part").select((F.col("p_partkey") % 10).alias("tree_id"), F.col("p_partkey").alias("node_id"), (F.col("p_size") % 6).alias("depth"), (F.col("p_partkey") % 7 % 5).cast("int").alias("feature"), (F.col("p_size") % 3 == 0).alias("is_leaf"))


@register("min_depth_from_trees", f"""WITH {_TREES}, h AS (SELECT tree_id, max(depth) AS height FROM tr GROUP BY 1), m AS (SELECT tree_id, feature, min(depth) AS depth FROM tr WHERE NOT is_leaf GROUP BY 1, 2),
a AS (SELECT h.tree_id, f.feature, coalesce(m.depth, h.height) AS depth, m.depth IS NOT NULL AS used FROM h CROSS JOIN (SELECT unnest(range(5)) AS feature) f LEFT JOIN m ON m.tree_id = h.tree_id AND m.feature = f.feature)
SELECT 'x' || feature AS feature, round(avg(depth), 8) AS mean_min_depth, quantile_cont(depth, 0.25) AS q25, quantile_cont(depth, 0.75) AS q75, avg(CASE WHEN used THEN 1.0 ELSE 0.0 END) AS frac_used FROM a GROUP BY feature""")
def min_depth_from_trees(spark, d):
    found = minimal_depth.minimal_depth(_trees(spark, d), [f"x{i}" for i in range(5)])
    return found.select("feature", F.round("mean_min_depth", 8).alias("mean_min_depth"), "q25", "q75", "frac_used")


@register("min_depth_threshold", f"""WITH {_TREES}, h AS (SELECT tree_id, max(depth) AS h FROM tr GROUP BY 1), a AS (SELECT count(*) AS n, round_even(avg(h), 0) AS dd FROM h),
i AS (SELECT depth, count(*) AS nodes FROM tr WHERE NOT is_leaf GROUP BY 1), g AS (SELECT x.depth, coalesce(nodes, 0) / (SELECT n FROM a) AS m FROM (SELECT unnest(range(CAST((SELECT dd FROM a) AS BIGINT))) AS depth) x LEFT JOIN i USING (depth))
SELECT round(sum(t), 8) AS threshold FROM (SELECT power(0.8, sum(m) OVER (ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS t FROM g)""")
def min_depth_threshold(spark, d):
    return minimal_depth.threshold(_trees(spark, d), 5).select(F.round("threshold", 8).alias("threshold"))


# ---- scalar kernels, outcomes ---------------------------------------------------------------------------------

_Z = "CAST(l_quantity - 25 AS DOUBLE) / 10"


@register("penalty_kernels", f"""WITH x AS (SELECT DISTINCT {_Z} AS z FROM lineitem), s AS (SELECT z, sign(z) * greatest(abs(z) - 0.5, 0) AS soft FROM x)
SELECT round(z, 6) AS z, round(soft, 8) AS soft, round(soft / 1.2, 8) AS lasso,
  round(CASE WHEN abs(z) <= 2.7 * 0.5 * 1.2 THEN soft / (1.2 - 1 / 2.7) ELSE z / 1.2 END, 8) AS mcp,
  round(CASE WHEN abs(z) <= 0.5 * 2.2 THEN soft / 1.2 WHEN abs(z) <= 3.7 * 0.5 * 1.2 THEN sign(z) * greatest(abs(z) - 3.7 * 0.5 / 2.7, 0) / (1.2 - 1 / 2.7) ELSE z / 1.2 END, 8) AS scad FROM s""")
def penalty_kernels(spark, d):
    x = tables.table(spark, d, "lineitem").select(((F.col("l_quantity") - 25).cast("double") / 10).alias("z")).distinct()
    z, v, l1, l2 = F.col("z"), F.lit(1.0), F.lit(0.5), F.lit(0.2)
    r = lambda c: F.round(c + 0.0, 8)
    return x.select(F.round("z", 6).alias("z"), r(scalars.soft_threshold(z, l1)).alias("soft"), r(scalars.prox_lasso(z, v, l1, l2)).alias("lasso"), r(scalars.prox_mcp(z, v, l1, l2, 2.7)).alias("mcp"), r(scalars.prox_scad(z, v, l1, l2, 3.7)).alias("scad"))


@register("penalty_solver", f"""WITH x AS (SELECT DISTINCT {_Z} AS z FROM lineitem), s AS (SELECT z, sign(z) * greatest(abs(z) - 0.5, 0) AS soft FROM x)
SELECT round(z, 6) AS z, round(soft / 1.2, 8) AS lasso, round(CASE WHEN abs(z) <= 2.7 * 0.5 * 1.2 THEN soft / (1.2 - 1 / 2.7) ELSE z / 1.2 END, 8) AS mcp,
  round(CASE WHEN abs(z) <= 0.5 * 2.2 THEN soft / 1.2 WHEN abs(z) <= 3.7 * 0.5 * 1.2 THEN sign(z) * greatest(abs(z) - 3.7 * 0.5 / 2.7, 0) / (1.2 - 1 / 2.7) ELSE z / 1.2 END, 8) AS scad,
  CAST(CASE WHEN z = 0 THEN 0 ELSE 0.5 END AS DOUBLE) AS slope_lasso, round(CASE WHEN z = 0 THEN 0 ELSE greatest(0.5 - abs(z) / 2.7, 0) END, 8) AS slope_mcp,
  round(CASE WHEN z = 0 THEN 0 WHEN abs(z) <= 0.5 THEN 0.5 ELSE greatest(3.7 * 0.5 - abs(z), 0) / 2.7 END, 8) AS slope_scad FROM s""")
def penalty_solver(spark, d):
    """The solver's own minimisers and penalty slopes, at the distinct values."""
    z = [r[0] for r in tables.table(spark, d, "lineitem").select(((F.col("l_quantity") - 25).cast("double") / 10).alias("z")).distinct().collect()]
    kinds = (("lasso", 1.0), ("mcp", 2.7), ("scad", 3.7))
    slopes = [penalty_slope(k, np.abs(np.array(z)), 0.5, g) for k, g in kinds]
    rows = [(round(x, 6), *[round(proximal(k, x, 1.0, 0.5, 0.2, g) + 0.0, 8) for k, g in kinds], *[round(float(s[i]), 8) for s in slopes]) for i, x in enumerate(z)]
    return _rows(spark, rows, "z double, lasso double, mcp double, scad double, slope_lasso double, slope_mcp double, slope_scad double")


@register("event_recode", f"WITH {sql.SV} SELECT CAST(CASE WHEN event = 0 THEN 0 WHEN event = 2 THEN 1 ELSE 2 END AS INTEGER) AS code, CAST(CASE WHEN event = 2 THEN 1 ELSE 0 END AS INTEGER) AS hit, CAST(CASE WHEN event = 1 THEN 0 WHEN event = 0 THEN -999 ELSE event END AS INTEGER) AS moved, count(*) AS n FROM sv GROUP BY ALL")
def event_recode(spark, d):
    e = F.col("event")
    return _sv(spark, d).select(scalars.recode(e, 2).alias("code"), scalars.cause_indicator(e, 2).alias("hit"), scalars.censor_recode(e, 1).alias("moved")).groupBy("code", "hit", "moved").agg(F.count("*").alias("n"))


@register("surv_unpack", f"WITH {sql.SV} SELECT event, sum(time) AS total, count(*) AS n FROM sv GROUP BY event")
def surv_unpack(spark, d):
    packed = _sv(spark, d).select(outcomes.surv("event", "time").alias("y"))
    return outcomes.unpack_surv(packed).groupBy("event").agg(F.sum("time").alias("total"), F.count("*").alias("n"))


@register("input_summary", f"WITH {sql.SV} SELECT CAST(count(DISTINCT event) FILTER (WHERE event > 0) AS INTEGER) AS n_causes FROM sv")
def input_summary(spark, d):
    return _rows(spark, [(outcomes.check_inputs(_sv(spark, d), _FEATURES),)], "n_causes int")


@register("stratified_split_counts", f"WITH {sql.SIGNUP}, n AS (SELECT event, count(*) AS n FROM sv GROUP BY event) SELECT event, CASE WHEN n >= 2 THEN greatest(1, CAST(round(n * 0.2) AS BIGINT)) ELSE 0 END AS n_test, n FROM n")
def stratified_split_counts(spark, d):
    s = outcomes.stratified_split(tables.signup_outcome(spark, d), "event_id")
    return s.groupBy("event").agg(F.sum(F.col("is_test").cast("long")).alias("n_test"), F.count("*").alias("n"))


@register("standardize_columns", f"WITH {sql.SV} SELECT round(avg(l_quantity), 8) AS centre_q, round(stddev_pop(l_quantity), 8) AS scale_q, round(avg(l_discount), 8) AS centre_d, round(stddev_pop(l_discount), 8) AS scale_d FROM sv")
def standardize_columns(spark, d):
    centre, scale = column_scales(_sv(spark, d), ["l_quantity", "l_discount"])
    return _rows(spark, [tuple(round(float(x), 8) for pair in zip(centre, scale) for x in pair)], "centre_q double, scale_q double, centre_d double, scale_d double")


# ---- regression ------------------------------------------------------------------------------------------------

_X = f"{sql.SV.replace('l_orderkey' + chr(10), 'l_orderkey, l_quantity / 50 AS x' + chr(10))}"


def _newton_sql(steps: int, subdistribution: bool) -> str:
    """CTEs b0 .. b{steps} (the coefficient) and w0 .. (risk sums by time) of a one-covariate model."""
    out = [f"{_X}, {sql.censor(*sql.FG)}, b0 AS (SELECT CAST(0.0 AS DOUBLE) AS b)"]
    comp = "CASE WHEN event = 2 THEN 1 ELSE 0 END" if subdistribution else "0"
    for i in range(steps + 1):
        powers = ", ".join(f"sum(power(x, {m}) * exp(b * x)) AS r{m}, sum(power(x, {m}) * exp(b * x) * ({comp})) AS c{m}" for m in range(3))
        sums = ", ".join(f"sum(r{m}) OVER s + g_left * coalesce(sum(CASE WHEN g_left > 0 THEN c{m} / g_left ELSE 0 END) OVER p, 0) AS s{m}" for m in range(3))
        out.append(f"e{i} AS (SELECT time, {powers}, CAST(sum(CASE WHEN event = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d, sum(CASE WHEN event = 1 THEN x ELSE 0 END) AS dx FROM sv, b{i} GROUP BY time)")
        out.append(f"w{i} AS (SELECT e{i}.*, {sums} FROM e{i} JOIN k USING (time) WINDOW s AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        if i < steps:
            out.append(f"b{i + 1} AS (SELECT b + (SELECT sum(dx - d * s1 / s0) / sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0))) FROM w{i} WHERE d > 0) AS b FROM b{i})")
    return ",\n".join(out)


_FG0, _COX0 = _newton_sql(0, True), _newton_sql(0, False)
_FG, _COX = _newton_sql(6, True), _newton_sql(6, False)


def _xrows(spark, d):
    return _sv(spark, d).select("time", "event", (F.col("l_quantity") / 50).alias("x"))


def _at_zero(spark, d, subdistribution):
    model = risk.SparkRisk(_xrows(spark, d), ["x"], subdistribution=subdistribution)
    found = model.newton(np.zeros(1))
    model.close()
    return found


@register("fg_null_loglik", f"WITH {_FG0} SELECT round(-sum(d * ln(s0)), 4) AS loglik FROM w0 WHERE d > 0")
def fg_null_loglik(spark, d):
    return _rows(spark, [(round(-_at_zero(spark, d, True)[0], 4),)], "loglik double")


@register("fg_score_at_zero", f"WITH {_FG0} SELECT round(sum(dx - d * s1 / s0), 5) AS score FROM w0 WHERE d > 0")
def fg_score_at_zero(spark, d):
    return _rows(spark, [(round(float(_at_zero(spark, d, True)[1][0]), 5),)], "score double")


@register("fg_info_at_zero", f"WITH {_FG0} SELECT round(sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0))), 4) AS info FROM w0 WHERE d > 0")
def fg_info_at_zero(spark, d):
    return _rows(spark, [(round(float(_at_zero(spark, d, True)[2][0, 0]), 4),)], "info double")


@register("cox_null_loglik", f"WITH {_COX0} SELECT round(-sum(d * ln(s0)), 4) AS loglik FROM w0 WHERE d > 0")
def cox_null_loglik(spark, d):
    return _rows(spark, [(round(-_at_zero(spark, d, False)[0], 4),)], "loglik double")


@register("fg_newton_1cov", f"WITH {_FG} SELECT round((SELECT b FROM b6), 7) AS coef, round(1 / sqrt(sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0)))), 7) AS se FROM w6 WHERE d > 0")
def fg_newton_1cov(spark, d):
    m = FineGrayRegression(gtol=1e-12, max_iter=20, task_bytes=0).fit(_xrows(spark, d), ["x"])
    return _rows(spark, [(round(float(m.coef_[0]), 7), round(float(m.se_[0]), 7))], "coef double, se double")


@register("cox_newton_1cov", f"WITH {_COX} SELECT round((SELECT b FROM b6), 7) AS coef, round(1 / sqrt(sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0)))), 7) AS se FROM w6 WHERE d > 0")
def cox_newton_1cov(spark, d):
    m = CauseSpecificCox(gtol=1e-12).fit(_xrows(spark, d), ["x"])
    return _rows(spark, [(round(float(m.coef_[0]), 7), round(float(m.se_[0]), 7))], "coef double, se double")


@register("cox_structured_outcome", f"WITH {_COX} SELECT round((SELECT b FROM b6), 7) AS coef, round(1 / sqrt(sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0)))), 7) AS se FROM w6 WHERE d > 0")
def cox_structured_outcome(spark, d):
    """The same from one structured outcome column."""
    rows = _xrows(spark, d).select("x", outcomes.surv("event", "time").alias("y"))
    m = CauseSpecificCox(gtol=1e-12).fit(rows, ["x"], y="y")
    return _rows(spark, [(round(float(m.coef_[0]), 7), round(float(m.se_[0]), 7))], "coef double, se double")


@register("fg_baseline_hazard", f"WITH {_FG} SELECT time, round(sum(d / s0) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING), 7) AS cum_hazard FROM w6 WHERE d > 0")
def fg_baseline_hazard(spark, d):
    m = FineGrayRegression(gtol=1e-12, max_iter=20).fit(_xrows(spark, d), ["x"])
    return _rows(spark, [(float(t), round(float(h), 7)) for t, h in zip(m.baseline_times_, m.baseline_cum_hazard_)], "time double, cum_hazard double")


@register("fg_cif_1cov", f"WITH {_FG}, h AS (SELECT time, sum(d / s0) OVER (ORDER BY time ROWS UNBOUNDED PRECEDING) AS h FROM w6 WHERE d > 0), q AS (SELECT unnest([500.0, 1000.0, 2000.0])::DOUBLE AS t), x AS (SELECT DISTINCT x FROM sv) SELECT round(x, 4) AS x, t, round(1 - exp(-(SELECT max(h) FROM h WHERE time <= t) * exp((SELECT b FROM b6) * x)), 6) AS cif FROM x, q")
def fg_cif_1cov(spark, d):
    rows = _xrows(spark, d)
    m = FineGrayRegression(gtol=1e-12, max_iter=20).fit(rows, ["x"])
    days = [500.0, 1000.0, 2000.0]
    c = m.predict_cumulative_incidence(rows.select("x").distinct(), days).select("x", F.posexplode("cif").alias("i", "cif"))
    return c.select(F.round("x", 4).alias("x"), F.get(F.array(*[F.lit(t) for t in days]), F.col("i")).alias("t"), F.round("cif", 6).alias("cif"))


@register("lambda_max_lasso", f"WITH {_FG0.replace('l_quantity / 50 AS x', '(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS x')} SELECT round(abs(sum(dx - d * s1 / s0)) / (SELECT count(*) FROM sv), 9) AS lambda_max FROM w0 WHERE d > 0")
def lambda_max_lasso(spark, d):
    m = PenalizedFineGrayRegression(n_lambda=2).fit(_xrows(spark, d), ["x"])
    return _rows(spark, [(round(float(m.lambdas_[0]), 9),)], "lambda_max double")


def _lasso_sql(steps: int = 8) -> str:
    """A path of one standardised covariate: the score meets n * lambda, Newton steps from zero written out for each lambda."""
    out = [f"{_FG0.replace('l_quantity / 50 AS x', '(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) AS x')}"]
    out.append("top AS (SELECT sum(dx - d * s1 / s0) AS u, (SELECT count(*) FROM sv) AS n FROM w0 WHERE d > 0)")
    out.append("q0 AS (SELECT f, f * abs(u) / n AS lam, u, n, CAST(0.0 AS DOUBLE) AS b FROM top, (SELECT unnest([1.0, 0.1, 0.01])::DOUBLE AS f))")
    for i in range(steps + 1):
        powers = ", ".join(f"sum(power(x, {m}) * exp(b * x)) AS r{m}, sum(power(x, {m}) * exp(b * x) * (CASE WHEN event = 2 THEN 1 ELSE 0 END)) AS c{m}" for m in range(3))
        sums = ", ".join(f"sum(r{m}) OVER s + g_left * coalesce(sum(CASE WHEN g_left > 0 THEN c{m} / g_left ELSE 0 END) OVER p, 0) AS s{m}" for m in range(3))
        out.append(f"y{i} AS (SELECT f, time, {powers}, CAST(sum(CASE WHEN event = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d, sum(CASE WHEN event = 1 THEN x ELSE 0 END) AS dx FROM sv, q{i} GROUP BY f, time)")
        out.append(f"z{i} AS (SELECT y{i}.*, {sums} FROM y{i} JOIN k USING (time) WINDOW s AS (PARTITION BY f ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p AS (PARTITION BY f ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        out.append(f"m{i} AS (SELECT f, sum(dx - d * s1 / s0) AS score, sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0))) AS info, sum(dx) AS dx, -sum(d * ln(s0)) AS logs FROM z{i} WHERE d > 0 GROUP BY f)")
        if i < steps:
            out.append(f"q{i + 1} AS (SELECT q{i}.* REPLACE (CASE WHEN f >= 1 THEN 0.0 ELSE b + (score - n * lam * sign(u)) / info END AS b) FROM q{i} JOIN m{i} USING (f))")
    return ",\n".join(out)


@register("pfg_lasso_1cov", f"WITH {_lasso_sql()} SELECT round(lam, 9) AS lam, round(b / (SELECT stddev_pop(l_quantity) FROM lineitem) * 50, 6) AS coef, round(-2 * (b * dx + logs), 3) AS deviance FROM q8 JOIN m8 USING (f)")
def pfg_lasso_1cov(spark, d):
    m = PenalizedFineGrayRegression(n_lambda=3, lambda_min_ratio=0.01, tol=1e-10, max_iter=5000).fit(_xrows(spark, d), ["x"])
    return _rows(spark, [(round(float(a), 9), round(float(b) + 0.0, 6), round(float(c), 3)) for a, b, c in zip(m.lambdas_, m.coef_path_[0], m.deviance_path_)], "lam double, coef double, deviance double")


# ---- regression with two covariates ------------------------------------------------------------------------------

_XX = sql.SV.replace("l_orderkey\n", "l_orderkey, l_quantity / 50 AS x1, l_discount * 10 AS x2\n")


def _newton2_sql(steps: int, subdistribution: bool) -> str:
    """CTEs b0 .. (coefficients b1, b2) and w0 .. (risk sums by time) of a model with two covariates, Newton steps written out."""
    out = [f"{_XX}, {sql.censor(*sql.FG)}, b0 AS (SELECT CAST(0.0 AS DOUBLE) AS b1, CAST(0.0 AS DOUBLE) AS b2)"]
    terms = {"0": "1", "1": "x1", "2": "x2", "11": "x1 * x1", "12": "x1 * x2", "22": "x2 * x2"}
    rival = "CASE WHEN event = 2 THEN 1 ELSE 0 END" if subdistribution else "0"
    for i in range(steps + 1):
        sums = ", ".join(f"sum({x} * exp(b1 * x1 + b2 * x2)) AS r{m}, sum({x} * exp(b1 * x1 + b2 * x2) * ({rival})) AS c{m}" for m, x in terms.items())
        at = ", ".join(f"sum(r{m}) OVER s + g_left * coalesce(sum(CASE WHEN g_left > 0 THEN c{m} / g_left ELSE 0 END) OVER p, 0) AS s{m}" for m in terms)
        out.append(f"e{i} AS (SELECT time, {sums}, CAST(sum(CASE WHEN event = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d, sum(CASE WHEN event = 1 THEN x1 ELSE 0 END) AS d1, sum(CASE WHEN event = 1 THEN x2 ELSE 0 END) AS d2 FROM sv, b{i} GROUP BY time)")
        out.append(f"w{i} AS (SELECT e{i}.*, g_left, {at} FROM e{i} JOIN k USING (time) WINDOW s AS (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p AS (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        out.append(f"i{i} AS (SELECT sum(d1 - d * s1 / s0) AS u1, sum(d2 - d * s2 / s0) AS u2, sum(d * (s11 / s0 - s1 * s1 / (s0 * s0))) AS a11, sum(d * (s12 / s0 - s1 * s2 / (s0 * s0))) AS a12, sum(d * (s22 / s0 - s2 * s2 / (s0 * s0))) AS a22 FROM w{i} WHERE d > 0)")
        if i < steps:
            out.append(f"b{i + 1} AS (SELECT b1 + (a22 * u1 - a12 * u2) / (a11 * a22 - a12 * a12) AS b1, b2 + (a11 * u2 - a12 * u1) / (a11 * a22 - a12 * a12) AS b2 FROM b{i}, i{i})")
    return ",\n".join(out)


_MODEL_BASED = "v AS (SELECT sqrt(a22 / (a11 * a22 - a12 * a12)) AS e1, sqrt(a11 / (a11 * a22 - a12 * a12)) AS e2 FROM i6)"
# the rows' score residuals, each with the sums over event times up to its own and, reweighted, after it
_ROBUST = """j AS (SELECT *, CASE WHEN d > 0 THEN d / s0 ELSE 0 END AS q0, CASE WHEN d > 0 THEN d * s1 / (s0 * s0) ELSE 0 END AS q1, CASE WHEN d > 0 THEN d * s2 / (s0 * s0) ELSE 0 END AS q2 FROM w6),
l AS (SELECT time, g_left, CASE WHEN d > 0 THEN s1 / s0 ELSE 0 END AS m1, CASE WHEN d > 0 THEN s2 / s0 ELSE 0 END AS m2, {both} FROM j
  WINDOW u AS (ORDER BY time ROWS UNBOUNDED PRECEDING), o AS (ORDER BY time ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT x1, x2, exp(b1 * x1 + b2 * x2) AS r, CASE WHEN event = 1 THEN 1 ELSE 0 END AS hit, m1, m2, {sums} FROM sv JOIN l USING (time), b6),
z AS (SELECT hit * (x1 - m1) - r * (x1 * t0 - t1) AS z1, hit * (x2 - m2) - r * (x2 * t0 - t2) AS z2 FROM f),
n AS (SELECT sum(z1 * z1) AS n11, sum(z1 * z2) AS n12, sum(z2 * z2) AS n22 FROM z),
h AS (SELECT a22 / det AS h11, -a12 / det AS h12, a11 / det AS h22 FROM (SELECT *, a11 * a22 - a12 * a12 AS det FROM i6)),
v AS (SELECT sqrt(h11 * h11 * n11 + 2 * h11 * h12 * n12 + h12 * h12 * n22) AS e1, sqrt(h12 * h12 * n11 + 2 * h12 * h22 * n12 + h22 * h22 * n22) AS e2 FROM h, n)""".format(
    both=", ".join(f"sum(q{m}) OVER u AS p{m}, coalesce(sum(g_left * q{m}) OVER o, 0) AS f{m}" for m in range(3)),
    sums=", ".join(f"p{m} + CASE WHEN event = 2 AND g_left > 0 THEN f{m} / g_left ELSE 0 END AS t{m}" for m in range(3)),
)
_TWO = "SELECT 'x1' AS feature, round(b1, 6) AS coef, round(e1, 6) AS se FROM b6, v UNION ALL SELECT 'x2', round(b2, 6), round(e2, 6) FROM b6, v"


def _xxrows(spark, d):
    return _sv(spark, d).select("time", "event", (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"))


def _coefficients(spark, m):
    return m.coefficients(spark).select("feature", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"))


@register("fg_fit_robust", f"WITH {_newton2_sql(6, True)}, {_ROBUST} {_TWO}")
def fg_fit_robust(spark, d):
    return _coefficients(spark, FineGrayRegression(robust_se=True, gtol=1e-12, max_iter=20).fit(_xxrows(spark, d), ["x1", "x2"]))


@register("fg_fit_distributed", f"WITH {_newton2_sql(6, True)}, {_ROBUST} {_TWO}")
def fg_fit_distributed(spark, d):
    """The same by aggregation over the rows."""
    return _coefficients(spark, FineGrayRegression(robust_se=True, gtol=1e-12, max_iter=20, task_bytes=0).fit(_xxrows(spark, d), ["x1", "x2"]))


@register("cox_fit", f"WITH {_newton2_sql(6, False)}, {_MODEL_BASED} {_TWO}")
def cox_fit(spark, d):
    return _coefficients(spark, CauseSpecificCox(gtol=1e-12).fit(_xxrows(spark, d), ["x1", "x2"]))


@register("pfg_path")
def pfg_path(spark, d):
    m = PenalizedFineGrayRegression().fit(_signup(spark, d), _SIGNUP)
    return _rows(spark, [(i, float(lam), f, float(b)) for i, lam in enumerate(m.lambdas_) for f, b in zip(m.features, m.coef_path_[:, i])], "step int, lam double, feature string, coef double")


@register("pfg_cross_validation")
def pfg_cross_validation(spark, d):
    m = PenalizedFineGrayRegression(cv=5, cv_random_state=1).fit(_signup(spark, d), _SIGNUP)
    return _rows(spark, [(i, float(lam), float(x), float(e), i == m.lambda_index_) for i, (lam, x, e) in enumerate(zip(m.lambdas_, m.cv_deviance_, m.cv_deviance_se_))], "step int, lam double, deviance double, se double, chosen boolean")


# ---- one-leaf forests: the integrals of a group's curves -----------------------------------------------------------

# a forest of one leaf knows times by the last event time at or before them, or the first
_LEAF = f"""{sql.SV}, et AS (SELECT DISTINCT grp, time AS g FROM sv WHERE event > 0), ei AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY g) - 1 AS i, count(*) OVER (PARTITION BY grp) AS m, lead(g) OVER (PARTITION BY grp ORDER BY g) - g AS step FROM et),
lt AS (SELECT sv.grp, event, coalesce(ei.i, 0) AS time FROM sv ASOF LEFT JOIN ei ON ei.grp = sv.grp AND ei.g <= sv.time), {sql.incidence('grp', 'lt')}"""


def _one_leaf(spark, d, value):
    rows = _sv(spark, d)
    groups = [(g, rows.where(F.col("grp") == g).select("l_quantity", "time", "event")) for g in ("F", "O")]
    models = [(g, part, CompetingRiskForest(n_estimators=1, max_depth=0, bootstrap=False, time_grid=None).fit(part, ["l_quantity"])) for g, part in groups]
    return _rows(spark, [(g, round(float(value(part, m)), 5)) for g, part, m in models], "grp string, value double")


@register("mortality_left_riemann", f"WITH {_LEAF} SELECT f.grp, round(sum(f1 * step), 5) AS mortality FROM f JOIN ei ON ei.grp = f.grp AND ei.i = f.time GROUP BY f.grp")
def mortality_left_riemann(spark, d):
    return _one_leaf(spark, d, lambda part, m: m.leaf_mortality()[0][0]).withColumnRenamed("value", "mortality")


@register("integrated_chf", f"WITH {_LEAF} SELECT f.grp, round(sum(d1 / y * (m - i)), 5) AS risk FROM f JOIN ei ON ei.grp = f.grp AND ei.i = f.time GROUP BY f.grp")
def integrated_chf(spark, d):
    return _one_leaf(spark, d, lambda part, m: m.predict_risk(part.limit(1)).first()["risk"]).withColumnRenamed("value", "risk")


# ---- forests: small ones that SQL can grow too ---------------------------------------------------------------------

_SIGNUP = ["value", "lagged"]
_GROWN, _SMALL = forest_sql.grown(), dict(n_estimators=forest_sql.TREES, max_depth=forest_sql.DEPTH, max_features=None, nsplit=0, n_bins=8, time_grid=20, random_state=forest_sql.SEED)


def _signup(spark, d):
    return tables.signup_outcome(spark, d).withColumn("lagged", F.pmod("user_id", F.lit(97)).cast("double"))


def _forest(spark, d, **more):
    return CompetingRiskForest(**_SMALL | more).fit(_signup(spark, d), _SIGNUP, key="event_id")


_NODES = f"WITH {_GROWN}, {forest_sql.NODES} SELECT tree AS tree_id, depth, CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS split_bin, feature < 0 AS is_leaf, CAST(cover AS BIGINT) AS cover FROM nt"


def _nodes(m):
    return m.tree_table().select(F.col("tree_id").cast("int").alias("tree_id"), "depth", "feature", "split_bin", "is_leaf", F.col("cover").cast("long").alias("cover"))


@register("forest_trees", _NODES)
def forest_trees(spark, d):
    return _nodes(_forest(spark, d))


@register("forest_trees_distributed", _NODES)
def forest_trees_distributed(spark, d):
    """The same trees, grown by aggregation over the rows."""
    return _nodes(_forest(spark, d, mode="distributed"))


def _thresholds(m):
    """The splits of trees by the values they part, with the in-bag rows of the node and of its left child."""
    t, edges = m.tree_table(), [[float(x) for x in e] or [0.0] for e in m.bin_edges_]
    value = F.get(F.get(F.array(*[F.array(*[F.lit(x) for x in e]) for e in edges]), F.col("feature")), F.col("split_bin"))
    left = t.select("tree_id", F.col("node_id").alias("left"), F.col("cover").alias("n_left"))
    return t.where("feature >= 0").join(left, ["tree_id", "left"]).select(F.col("tree_id").cast("int").alias("tree_id"), "depth", "feature", F.round(value, 6).alias("threshold"), F.col("n_left").cast("long").alias("n_left"), F.col("cover").cast("long").alias("n"))


@register("forest_reference_trees", forest_sql.exact_splits(True, forest_sql.TREES))
def forest_reference_trees(spark, d):
    """Trees that try every midpoint of every node against each of its event times."""
    return _thresholds(_forest(spark, d, mode="reference"))


@register("forest_reference_logrank", forest_sql.exact_splits(False, 1, "logrank"))
def forest_reference_logrank(spark, d):
    """One tree of the whole table by the log-rank statistic of cause 1."""
    return _thresholds(_forest(spark, d, mode="reference", splitrule="logrank", n_estimators=1, bootstrap=False))


_LOGRANK = forest_sql.grown(rule="logrank")


@register("forest_trees_logrank", f"WITH {_LOGRANK}, {forest_sql.NODES} SELECT tree AS tree_id, depth, CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS split_bin, feature < 0 AS is_leaf, CAST(cover AS BIGINT) AS cover FROM nt")
def forest_trees_logrank(spark, d):
    """The forest's other rule: cause 1 alone, other causes censored."""
    return _nodes(_forest(spark, d, splitrule="logrank"))


@register("forest_leaves", f"""WITH {_GROWN}, ln AS (SELECT tree, node, row_number() OVER (PARTITION BY tree ORDER BY node) - 1 AS leaf FROM (SELECT DISTINCT tree, node FROM r2 WHERE w > 0))
SELECT tree AS tree_id, CAST(leaf AS INTEGER) AS leaf_id, CAST(tf AS INTEGER) AS t_idx, event, CAST(sum(w) AS BIGINT) AS n FROM r2 JOIN ln USING (tree, node) WHERE w > 0 GROUP BY ALL""")
def forest_leaves(spark, d):
    return _forest(spark, d).leaf_table().select(F.col("tree_id").cast("int").alias("tree_id"), "leaf_id", "t_idx", "event", "n")


def _values(kind):
    means = ", ".join(f"round(avg(v{k}_{j}), 8) AS v{k}_{j}" for k in (1, 2) for j in range(3))
    return f"WITH {_GROWN}, {forest_sql.by_leaf(*forest_sql.at_times(kind))} SELECT event_id, {means} FROM r2 JOIN lw USING (tree, node) GROUP BY event_id"


def _spread(df, name):
    return df.select("event_id", *[F.round(F.col(name)[k][j], 8).alias(f"v{k + 1}_{j}") for k in range(2) for j in range(3)])


@register("forest_predict_cif", _values("cif"))
def forest_predict_cif(spark, d):
    return _spread(_forest(spark, d).predict_cif(_signup(spark, d), forest_sql.TIMES), "cif")


@register("forest_predict_chf", _values("chf"))
def forest_predict_chf(spark, d):
    return _spread(_forest(spark, d).predict_chf(_signup(spark, d), forest_sql.TIMES), "chf")


_RISKS = forest_sql.by_leaf("sum(h1 * (m - tf)) AS chf", "sum(sl * d1 / y) AS cif")


@register("forest_predict_risk", f"WITH {_GROWN}, {_RISKS} SELECT event_id, round(avg(chf), 7) AS integrated_chf, round(avg(cif), 7) AS cif_last FROM r2 JOIN lw USING (tree, node) GROUP BY event_id")
def forest_predict_risk(spark, d):
    m = _forest(spark, d)
    both = m.predict_risk(m.predict_risk(_signup(spark, d), name="chf"), kind="cif_last", name="cif")
    return both.select("event_id", F.round("chf", 7).alias("integrated_chf"), F.round("cif", 7).alias("cif_last"))


_OOB = f"{_GROWN}, {forest_sql.by_leaf(forest_sql.MORTALITY)}, {forest_sql.oob()}"


@register("forest_oob_risk", f"WITH {_OOB} SELECT event_id, round(risk, 3) AS risk FROM ob")
def forest_oob_risk(spark, d):
    return _forest(spark, d).predict_oob_risk().select(F.col("key").alias("event_id"), F.round("risk", 3).alias("risk"))


@register("forest_oob_score", f"""WITH {_OOB}, rr AS (SELECT time, event, round(risk, 6) AS risk FROM ob)
SELECT round((sum(CASE WHEN j.risk < i.risk THEN 1.0 ELSE 0 END) + 0.5 * sum(CASE WHEN j.risk = i.risk THEN 1.0 ELSE 0 END)) / count(*), 6) AS score FROM rr i JOIN rr j ON j.time > i.time WHERE i.event = 1""")
def forest_oob_score(spark, d):
    return _rows(spark, [(round(_forest(spark, d).oob_score(), 6),)], "score double")


_UNO = """k0 AS (SELECT time, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN event = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d FROM oc GROUP BY time),
k1 AS (SELECT *, sum(n) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM k0),
k2 AS (SELECT *, CASE WHEN y - d > 0 THEN 1 - (n - d) / (y - d) ELSE 1 END AS keep FROM k1),
k AS (SELECT *, coalesce(product(keep) OVER (ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS g_left FROM k2),
ev AS (SELECT g_left AS g, greatest(g_left, 1e-12) AS s, row_number() OVER (ORDER BY g_left) AS i, count(*) OVER () AS n FROM oc JOIN k USING (time) WHERE event <> 0),
ta AS (SELECT g, i, n, sum(1 / s ** 2) OVER w AS w1, sum(1 / s ** 4) OVER w AS w2, least(greatest(20, ceil(0.2 * n)), n) AS target FROM ev WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
gm AS (SELECT CASE WHEN (SELECT min(g) FROM ev) >= 1 - 1e-12 THEN 0 ELSE coalesce(min(g) FILTER (WHERE n - i + 1 >= target AND w1 * w1 / w2 >= target), max(g) FILTER (WHERE n - i + 1 >= target)) END AS gmin FROM ta),
uw AS (SELECT event_id, event, time, CASE WHEN g_left >= gmin - 1e-15 THEN 1 / greatest(g_left, 1e-12) ** 2 ELSE 2.220446049250313e-16 END AS w FROM oc JOIN k USING (time), gm)"""
_CONCORDANT = """a AS (SELECT i.f, sum(2 * i.w) AS den, sum(2 * i.w * (CASE WHEN j.risk < i.risk THEN 1 WHEN j.risk = i.risk THEN 0.5 ELSE 0 END)) AS num FROM u i JOIN u j ON i.f = j.f AND (j.time > i.time OR (j.time = i.time AND j.event = 0)) WHERE i.event = {c} GROUP BY i.f),
b0 AS (SELECT f, time, risk, count(*) AS c, sum(w) AS w FROM u WHERE event = {c} GROUP BY f, time, risk),
b1 AS (SELECT f, time, sum(c) AS c, sum(w) AS w, sum(CASE WHEN c > 1 THEN (c - 1) * w ELSE 0 END) AS tie FROM b0 GROUP BY f, time),
b AS (SELECT f, sum(CASE WHEN c > 1 THEN (c - 1) * w ELSE 0 END) AS den, sum(CASE WHEN c > 1 THEN 0.5 * (c - 1) * w + 0.5 * tie ELSE 0 END) AS num FROM b1 GROUP BY f),
x AS (SELECT i.f, sum(2 * sqrt(i.w * j.w)) AS den, sum(2 * sqrt(i.w * j.w) * (CASE WHEN j.risk < i.risk THEN 1 WHEN j.risk = i.risk THEN 0.5 ELSE 0 END)) AS num FROM u i JOIN u j ON i.f = j.f AND j.time <= i.time WHERE i.event = {c} AND j.event = {o} GROUP BY i.f),
cc AS (SELECT a.f, (a.num + b.num + x.num) / (a.den + b.den + x.den) AS c FROM a JOIN b USING (f) JOIN x USING (f))"""
_DEALT = ", ".join(forest_sql.dealt(f) for f in (0, 1))
_EVERY = " UNION ALL ".join(f"SELECT {f} AS f, event_id, round(avg(value), 6) AS risk FROM {rows} JOIN lw USING (tree, node) WHERE w = 0 GROUP BY event_id" for f, rows in ((-1, "r2"), (0, "p0"), (1, "p1")))


@register("forest_importance", f"""WITH {_GROWN}, {forest_sql.by_leaf(forest_sql.MORTALITY)}, {_DEALT}, oc AS (SELECT event_id, any_value(moment) AS time, any_value(event) AS event FROM r2 GROUP BY event_id),
{_UNO}, u AS (SELECT f, event, time, risk, w FROM ({_EVERY}) JOIN uw USING (event_id)), {_CONCORDANT.format(c=1, o=2)}
SELECT CASE f WHEN 0 THEN 'value' ELSE 'lagged' END AS feature, round((SELECT c FROM cc WHERE f = -1) - c, 6) AS cause_1_vimp FROM cc WHERE f >= 0""")
def forest_importance(spark, d):
    return _forest(spark, d).compute_importance(causes=[1]).select("feature", F.round("cause_1_vimp", 6).alias("cause_1_vimp"))


_DEPTHS = f"""WITH {_GROWN}, {forest_sql.NODES}, h AS (SELECT tree, max(depth) AS height FROM nt GROUP BY 1), q AS (SELECT tree, feature, min(depth) AS depth FROM nt WHERE feature >= 0 GROUP BY 1, 2),
a AS (SELECT h.tree, f.feature, coalesce(q.depth, h.height) AS depth, q.depth IS NOT NULL AS used FROM h CROSS JOIN (SELECT unnest(range(2)) AS feature) f LEFT JOIN q ON q.tree = h.tree AND q.feature = f.feature),
o AS (SELECT count(*) AS n, round_even(avg(height), 0) AS dd FROM h), i AS (SELECT depth, count(*) AS nodes FROM nt WHERE feature >= 0 GROUP BY 1),
g AS (SELECT x.depth, coalesce(nodes, 0) / (SELECT n FROM o) AS m FROM (SELECT unnest(range(CAST((SELECT dd FROM o) AS BIGINT))) AS depth) x LEFT JOIN i USING (depth)),
e AS (SELECT sum(t) AS threshold FROM (SELECT power(0.5, sum(m) OVER (ORDER BY depth ROWS UNBOUNDED PRECEDING)) AS t FROM g))
SELECT CASE feature WHEN 0 THEN 'value' ELSE 'lagged' END AS feature, round(avg(depth), 8) AS mean_min_depth, avg(CASE WHEN used THEN 1.0 ELSE 0.0 END) AS frac_used, round(any_value(threshold), 8) AS threshold, avg(depth) <= any_value(threshold) AS selected FROM a, e GROUP BY feature"""


@register("forest_minimal_depth", _DEPTHS)
def forest_minimal_depth(spark, d):
    return _forest(spark, d).minimal_depth().select("feature", F.round("mean_min_depth", 8).alias("mean_min_depth"), "frac_used", F.round("threshold", 8).alias("threshold"), "selected")


# a leaf's part in the value of a set of known features: inside or not at nodes of known features, the cover's share at others
_REACH = "CASE WHEN sp{i}.feature IS NULL THEN 1.0 WHEN {s} THEN CASE WHEN (CASE sp{i}.feature WHEN 0 THEN b0 ELSE b1 END > sp{i}.bin) = (leaf.side{i} = 1) THEN 1.0 ELSE 0.0 END ELSE leaf.share{i} END"
_KNOWN = {"n": "false", "a": "sp{i}.feature = 0", "b": "sp{i}.feature = 1", "t": "true"}
_PARTS = ", ".join(f"sum(lw.value * {' * '.join(_REACH.format(i=i, s=s.format(i=i)) for i in (0, 1))}) AS v_{n}" for n, s in _KNOWN.items())


@register("forest_attributions", f"""WITH {_GROWN}, {forest_sql.NODES}, {forest_sql.by_leaf(forest_sql.TRAPEZOID)},
leaf AS (SELECT x.tree, x.node, CASE WHEN x.depth = 2 THEN (x.node - 1) // 2 ELSE x.node END AS upper, CASE WHEN x.depth = 2 THEN ((x.node - 1) // 2 + 1) % 2 ELSE (x.node + 1) % 2 END AS side0, (x.node + 1) % 2 AS side1,
  o.cover / root.cover AS share0, x.cover / o.cover AS share1, x.depth FROM nt x JOIN nt o ON o.tree = x.tree AND o.node = CASE WHEN x.depth = 2 THEN (x.node - 1) // 2 ELSE x.node END JOIN nt root ON root.tree = x.tree AND root.node = 0 WHERE x.feature < 0),
pv AS (SELECT event_id, r0.tree, {_PARTS} FROM r0 JOIN leaf ON leaf.tree = r0.tree JOIN lw ON lw.tree = leaf.tree AND lw.node = leaf.node
  LEFT JOIN sp sp0 ON sp0.tree = r0.tree AND sp0.node = 0 LEFT JOIN sp sp1 ON sp1.tree = r0.tree AND sp1.node = leaf.upper AND leaf.depth = 2 GROUP BY event_id, r0.tree)
SELECT event_id, 'value' AS feature, round(avg(((v_a - v_n) + (v_t - v_b)) / 2), 4) AS phi FROM pv GROUP BY event_id
UNION ALL SELECT event_id, 'lagged', round(avg(((v_b - v_n) + (v_t - v_a)) / 2), 4) FROM pv GROUP BY event_id""")
def forest_attributions(spark, d):
    return _forest(spark, d).shap_values(_signup(spark, d), "event_id", aggregate="trapezoid")[0].select("event_id", "feature", F.round(F.col("phi")[0], 4).alias("phi"))


@register("forest_held_out_importance")
def forest_held_out_importance(spark, d):
    """Drops of plain concordance on the training rows, by a forest of default size (SQL does not know the hash that deals values anew)."""
    rows = _signup(spark, d)
    return CompetingRiskForest(random_state=7).fit(rows, _SIGNUP).compute_importance(rows)


def _synthetic_sql(n: int, p: int, seed: int) -> str:
    u = lambda name: f"((CAST(CAST('0x' || substr(md5('{seed}|{name}|' || id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496)"
    x = ", ".join(f"sqrt(-2 * ln({u(f'r{i}')})) * cos(2 * pi() * {u(f'a{i}')}) AS x{i}" for i in range(p))
    return f"""x AS (SELECT id, {x}, {u('1')} AS u1, {u('2')} AS u2, {u('3')} AS u3 FROM (SELECT unnest(range({n})) AS id)),
t AS (SELECT *, power(-ln(1 - u1) / exp(0.5 * x0 - 0.4 * x1 + 0.3 * x2 + 0.2 * x3 - 0.2 * x4 - 3.0), 1 / 1.2) AS t1, power(-ln(1 - u2) / exp(-0.3 * x0 + 0.4 * x1 + 0.2 * x2 - 0.2 * x3 + 0.3 * x4 - 3.5), 1 / 0.9) AS t2, -ln(1 - u3) / 0.06 AS tc FROM x)"""


@register("synthetic_outcomes", f"WITH {_synthetic_sql(2000, 6, 20260417)} SELECT CASE WHEN tc <= least(t1, t2) THEN 0 WHEN t1 <= t2 THEN 1 ELSE 2 END AS event, count(*) AS n, round(avg(least(t1, t2, tc)), 6) AS mean_time, round(avg(x5), 8) AS mean_x5 FROM t GROUP BY 1")
def synthetic_outcomes(spark, d):
    rows = outcomes.synthetic_outcomes(spark, 2000, 6, partitions=4)
    return rows.groupBy("event").agg(F.count("*").alias("n"), F.round(F.avg("time"), 6).alias("mean_time"), F.round(F.avg("x5"), 8).alias("mean_x5"))
