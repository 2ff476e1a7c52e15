"""SQL of small forests over the signup view: grids, bins, bags, level-wise splits, leaves and what is predicted from them.

Trees have two features, eight bins, ten coarse times and two levels, try every split, and draw in-bag copies by the hash that
``operators.draws`` uses. Nodes are numbered as in a heap (children of i are 2i + 1 and 2i + 2).
"""

from __future__ import annotations

import numpy as np

from ..operators.draws import BAG, DEAL, FIRST, POISSON, SECOND, salt
from . import sql

DEPTH, SEED, TREES = 2, 7, 2
#: horizons of the signup view, in seconds
TIMES = [20000.0, 60000.0, 120000.0]
_POINTS = "[{}]".format(", ".join(repr(float(x)) for x in np.linspace(0, 1, 20)))
_EIGHTHS = "[{}]".format(", ".join(repr(i / 8) for i in range(1, 8)))


def uniform(key: str, salts: str) -> str:
    """Columns h1 .. h3 and u of a hash in [0, 1) from a key and a salt (unsigned)."""
    times = lambda x, c: f"CAST((CAST({x} AS UHUGEINT) * {c}) % 18446744073709551616 AS UBIGINT)"
    h0 = f"xor(CAST({key} AS UBIGINT), {salts})"
    h1 = times(f"xor({h0}, {h0} >> 30)", FIRST)
    h2 = times("xor(h1, h1 >> 27)", SECOND)
    return f"{h1} AS h1, {h2} AS h2, xor(h2, h2 >> 31) AS h3, CAST(h3 >> 11 AS DOUBLE) / 9007199254740992 AS u"


ROWS = f"""{sql.SIGNUP},
fv AS (SELECT event_id, time, event, value AS x0, CAST(user_id % 97 AS DOUBLE) AS x1 FROM sv),
fe AS (SELECT DISTINCT time AS v FROM fv WHERE event > 0),
gi AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT unnest(quantile_cont(v, {_POINTS})) AS g FROM fe)),
gl AS (SELECT array_agg(g ORDER BY g) AS g FROM gi),
ed AS (SELECT (SELECT quantile_cont(v, {_EIGHTHS}) FROM (SELECT DISTINCT x0 AS v FROM fv)) AS e0, (SELECT quantile_cont(v, {_EIGHTHS}) FROM (SELECT DISTINCT x1 AS v FROM fv)) AS e1),
fb AS (SELECT event_id, event, len([e FOR e IN e0 IF e <= x0]) AS b0, len([e FOR e IN e1 IF e <= x1]) AS b1, greatest(len([x FOR x IN gl.g IF x <= time]) - 1, 0) AS tf FROM fv, ed, gl),
fr AS (SELECT fb.*, least(fb.tf * 10 // (gi.m - 1), 9) AS t, gi.g AS moment FROM fb JOIN gi ON gi.i = fb.tf)"""


def terms(rule: str) -> tuple[str, str]:
    """(numerator, variance) of one time: pooled over the causes with Lau's risk sets, or of cause 1 alone with the plain one."""
    if rule == "logrank":
        return "CASE WHEN y >= 2 THEN l1 - a1 * yl / y ELSE 0 END", "CASE WHEN y >= 2 THEN a1 * yl * (y - yl) * (y - a1) / (y * y * (y - 1)) ELSE 0 END"
    stat = " + ".join(f"(CASE WHEN y >= 1 THEN l{k} - a{k} * (yl + ol{k}) / (y + o{k}) ELSE 0 END)" for k in (1, 2))
    return stat, " + ".join(f"(CASE WHEN y >= 2 THEN a{k} * (yl + ol{k}) * (y + o{k} - yl - ol{k}) * (y + o{k} - a{k}) / ((y + o{k}) * (y + o{k}) * (y + o{k} - 1)) ELSE 0 END)" for k in (1, 2))


def level(i: int, exact: bool = False, rule: str = "logrankCR") -> str:
    """The splits s{i} of the nodes of a level, and the rows r{i + 1} below them; ``exact`` over the values and times that each node has."""
    stat, var = terms(rule)
    cell = lambda c: f"CAST(sum(CASE WHEN {c} THEN w ELSE 0 END) AS DOUBLE)"
    every = f"(SELECT DISTINCT tree, node, feature FROM la{i}) q CROSS JOIN (SELECT unnest(range(8)) AS bin) b CROSS JOIN (SELECT unnest(range(10)) AS t) s"
    if exact:
        every = f"(SELECT DISTINCT tree, node, feature, bin FROM la{i}) q JOIN (SELECT DISTINCT tree, node, t FROM la{i}) s ON s.tree = q.tree AND s.node = q.node, (SELECT 1 AS one) b"
    bin_ = "q.bin" if exact else "b.bin"
    return f"""la{i} AS (SELECT tree, node, 0 AS feature, b0 AS bin, t, event, w FROM r{i} WHERE node >= {2**i - 1} AND w > 0 UNION ALL SELECT tree, node, 1, b1, t, event, w FROM r{i} WHERE node >= {2**i - 1} AND w > 0),
lb{i} AS (SELECT tree, node, feature, bin, t, {cell('true')} AS n, {cell('event = 1')} AS d1, {cell('event = 2')} AS d2 FROM la{i} GROUP BY ALL),
lc{i} AS (SELECT q.tree, q.node, q.feature, {bin_}, s.t, coalesce(n, 0) AS n, coalesce(d1, 0) AS d1, coalesce(d2, 0) AS d2
  FROM {every}
  LEFT JOIN lb{i} x ON x.tree = q.tree AND x.node = q.node AND x.feature = q.feature AND x.bin = {bin_} AND x.t = s.t),
ld{i} AS (SELECT *, sum(n) OVER l AS ln, sum(d1) OVER l AS l1, sum(d2) OVER l AS l2, sum(n) OVER a AS an, sum(d1) OVER a AS a1, sum(d2) OVER a AS a2 FROM lc{i}
  WINDOW l AS (PARTITION BY tree, node, feature, t ORDER BY bin ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY tree, node, feature, t)),
le{i} AS (SELECT *, sum(an) OVER s AS y, sum(ln) OVER s AS yl, coalesce(sum(a1) OVER p, 0) AS o2, coalesce(sum(l1) OVER p, 0) AS ol2, coalesce(sum(a2) OVER p, 0) AS o1, coalesce(sum(l2) OVER p, 0) AS ol1 FROM ld{i}
  WINDOW s AS (PARTITION BY tree, node, feature, bin ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), p AS (PARTITION BY tree, node, feature, bin ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lf{i} AS (SELECT tree, node, feature, bin, sum({stat}) AS num, sum({var}) AS var, max(yl) AS n_left, max(y) AS n FROM le{i} GROUP BY ALL),
s{i} AS (SELECT *, num * num / var AS stat FROM lf{i} WHERE var >= 1e-12 AND n_left >= 3 AND n - n_left >= 3 AND n >= 6
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY num * num / var DESC, feature, bin) = 1),
r{i + 1} AS (SELECT r.* EXCLUDE (node), CASE WHEN s.feature IS NULL THEN r.node ELSE 2 * r.node + 1 + CASE WHEN CASE s.feature WHEN 0 THEN b0 ELSE b1 END > s.bin THEN 1 ELSE 0 END END AS node
  FROM r{i} r LEFT JOIN s{i} s ON s.tree = r.tree AND s.node = r.node)"""


#: rows whose bins are the ranks of their values and whose times are the ranks of theirs
RANKED = f"""{sql.SIGNUP},
fv AS (SELECT event_id, time, event, value AS x0, CAST(user_id % 97 AS DOUBLE) AS x1 FROM sv),
fr AS (SELECT *, dense_rank() OVER (ORDER BY x0) AS b0, dense_rank() OVER (ORDER BY x1) AS b1, dense_rank() OVER (ORDER BY time) AS t, dense_rank() OVER (ORDER BY time) AS tf FROM fv)"""


def exact_splits(bag: bool, trees: int, rule: str = "logrankCR") -> str:
    """(tree_id, depth, feature, threshold, n_left, n) of the splits of exactly grown trees; a threshold lies midway to the node's next value."""
    one = lambda i: f"""SELECT tree AS tree_id, {i} AS depth, CAST(feature AS INTEGER) AS feature,
  round(((SELECT max(CASE s.feature WHEN 0 THEN x0 ELSE x1 END) FROM r{i} r WHERE r.tree = s.tree AND r.node = s.node AND w > 0 AND CASE s.feature WHEN 0 THEN b0 ELSE b1 END <= s.bin)
  + (SELECT min(CASE s.feature WHEN 0 THEN x0 ELSE x1 END) FROM r{i} r WHERE r.tree = s.tree AND r.node = s.node AND w > 0 AND CASE s.feature WHEN 0 THEN b0 ELSE b1 END > s.bin)) / 2, 6) AS threshold,
  CAST(n_left AS BIGINT) AS n_left, CAST(n AS BIGINT) AS n FROM s{i} s"""  # noqa: E731
    return f"WITH {grown(bag, trees, RANKED, exact=True, rule=rule).split('sp AS (')[0].rstrip().rstrip(',')} {' UNION ALL '.join(one(i) for i in range(DEPTH))}"


def grown(bag: bool = True, trees: int = TREES, rows: str = ROWS, key: str = "event_id", exact: bool = False, rule: str = "logrankCR") -> str:
    """CTEs up to the leaves' curves: r{DEPTH} (rows with node, copies w), sp (splits), lv (increments by leaf and grid index)."""
    if bag:
        salts = ", ".join(f"({i}, CAST({salt(SEED, i, BAG)} AS UBIGINT))" for i in range(trees))
        copies = " + ".join(f"CASE WHEN u >= {float(c)!r} THEN 1 ELSE 0 END" for c in POISSON)
        first = f"ts(tree, salt) AS (VALUES {salts}), tu AS (SELECT fr.*, tree, {uniform(key, 'salt')} FROM fr, ts), r0 AS (SELECT * EXCLUDE (h1, h2, h3, u), {copies} AS w, 0 AS node FROM tu)"
    else:
        first = "r0 AS (SELECT fr.*, 0 AS tree, 1 AS w, 0 AS node FROM fr)"
    levels = ",\n".join(level(i, exact, rule) for i in range(DEPTH))
    splits = " UNION ALL ".join(f"SELECT tree, {i} AS depth, node, feature, bin, stat FROM s{i}" for i in range(DEPTH))
    return f"""{rows}, {first},
{levels},
sp AS ({splits}),
va AS (SELECT tree, node, tf, CAST(sum(w) AS DOUBLE) AS n, CAST(sum(CASE WHEN event = 1 THEN w ELSE 0 END) AS DOUBLE) AS d1, CAST(sum(CASE WHEN event = 2 THEN w ELSE 0 END) AS DOUBLE) AS d2 FROM r{DEPTH} WHERE w > 0 GROUP BY ALL),
vb AS (SELECT *, sum(n) OVER (PARTITION BY tree, node ORDER BY tf ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM va),
lv AS (SELECT *, d1 / y AS h1, d2 / y AS h2, coalesce(product(1 - (d1 + d2) / y) OVER (PARTITION BY tree, node ORDER BY tf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS sl FROM vb)"""


#: the nodes of all trees: heap number, depth, in-bag rows, split
NODES = f"""nd AS (SELECT tree, node, sum(w) AS cover FROM ({' UNION ALL '.join(f'SELECT tree, node, w FROM r{i} WHERE node >= {2**i - 1}' for i in range(DEPTH + 1))}) GROUP BY ALL),
nt AS (SELECT nd.tree, nd.node, CAST(floor(log2(nd.node + 1)) AS INTEGER) AS depth, nd.cover, coalesce(sp.feature, -1) AS feature, coalesce(sp.bin, 0) AS bin FROM nd LEFT JOIN sp ON sp.tree = nd.tree AND sp.node = nd.node WHERE cover > 0)"""


def by_leaf(*values: str) -> str:
    """A value of each leaf from its increments (aggregates over lv joined with the grid)."""
    return f"lw AS (SELECT tree, node, {', '.join(values)} FROM lv JOIN gi ON gi.i = lv.tf GROUP BY tree, node)"


def at_times(kind: str) -> list[str]:
    """The curves' values at ``TIMES``, by cause."""
    step = {"cif": "sl * d{} / y", "chf": "h{}"}[kind]
    return [f"coalesce(sum({step.format(k)}) FILTER (WHERE tf <= (SELECT count(*) - 1 FROM gi WHERE g <= {t})), 0) AS v{k}_{j}" for k in (1, 2) for j, t in enumerate(TIMES)]


#: of the incidence of cause 1: left-Riemann and trapezoid integrals; of its hazard: the sum over the grid
MORTALITY = "sum(sl * d1 / y * ((SELECT max(g) FROM gi) - g)) AS value"
TRAPEZOID = "sum(sl * d1 / y * ((SELECT max(g) FROM gi) - g + coalesce(g - (SELECT max(o.g) FROM gi o WHERE o.i = gi.i - 1), 0) / 2)) AS value"


def oob(name: str = "lw", rows: str = f"r{DEPTH}") -> str:
    """CTE ob: mean value over the trees that leave a row out, 0 where none does."""
    return f"ob AS (SELECT event_id, any_value(moment) AS time, any_value(event) AS event, coalesce(avg(value) FILTER (WHERE w = 0), 0) AS risk FROM {rows} JOIN {name} USING (tree, node) GROUP BY event_id)"


def dealt(feature: int) -> str:
    """CTEs up to p{feature}: the rows a tree leaves out, with a feature's bin drawn from those rows' bins, sent down the tree again."""
    f, salts = feature, ", ".join(f"({i}, CAST({salt(SEED, i, DEAL, feature)} AS UBIGINT))" for i in range(TREES))
    down = "CASE WHEN {s}.feature IS NULL THEN {n} ELSE 2 * {n} + 1 + CASE WHEN CASE {s}.feature WHEN 0 THEN b0 ELSE b1 END > {s}.bin THEN 1 ELSE 0 END END"
    return f"""x{f} AS (SELECT tree, b, sum(n) OVER (PARTITION BY tree ORDER BY b) / sum(n) OVER (PARTITION BY tree) AS share FROM (SELECT tree, b{f} AS b, CAST(count(*) AS DOUBLE) AS n FROM r0 WHERE w = 0 GROUP BY ALL)),
q{f}(tree, salt) AS (VALUES {salts}),
u{f} AS (SELECT r0.*, {uniform('event_id', 'salt')} FROM r0 JOIN q{f} USING (tree) WHERE w = 0),
y{f} AS (SELECT * REPLACE ((SELECT min(b) FROM x{f} WHERE x{f}.tree = u{f}.tree AND share > u) AS b{f}) FROM u{f}),
z{f} AS (SELECT y{f}.* REPLACE ({down.format(s='s0', n='0')} AS node) FROM y{f} LEFT JOIN s0 ON s0.tree = y{f}.tree),
p{f} AS (SELECT z{f}.* REPLACE ({down.format(s='s1', n=f'z{f}.node')} AS node) FROM z{f} LEFT JOIN s1 ON s1.tree = z{f}.tree AND s1.node = z{f}.node)"""
