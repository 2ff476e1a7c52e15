"""SQL fragments of the survival views, for the DuckDB side of each registered query."""

SV = """sv AS (
  SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS time,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS event,
         l_linestatus AS grp, l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax, l_orderkey
  FROM lineitem)"""

SEG = """sv AS (
  SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS time,
         CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS event, c_mktsegment AS grp
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

SIGNUP = """sv AS (
  SELECT event_id, user_id, value,
         (epoch_us(coalesce(least(buy, err), fin)) - epoch_us(ts)) / 1e6 AS time,
         CASE WHEN least(buy, err) IS NULL THEN 0 WHEN buy = least(buy, err) THEN 1 ELSE 2 END AS event
  FROM (
    SELECT *, min(CASE WHEN event_type = 'purchase' THEN ts END) OVER w AS buy,
           min(CASE WHEN event_type = 'error' THEN ts END) OVER w AS err, (SELECT max(ts) FROM events) AS fin
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
  WHERE event_type = 'signup')"""


def counts(by: str = "", source: str = "sv") -> str:
    """CTEs c0, c: n, d, d1, d2, y by distinct time."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""c0 AS (
  SELECT {lead}time, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN event <> 0 THEN 1 ELSE 0 END) AS DOUBLE) AS d,
         CAST(sum(CASE WHEN event = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS d1, CAST(sum(CASE WHEN event = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS d2
  FROM {source} GROUP BY {lead}time),
c AS (SELECT *, sum(n) OVER ({part}ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM c0)"""


def prior(by: str = "") -> str:
    return f"({'PARTITION BY ' + by + ' ' if by else ''}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def sofar(by: str = "") -> str:
    return f"({'PARTITION BY ' + by + ' ' if by else ''}ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def incidence(by: str = "", source: str = "sv") -> str:
    """CTEs up to f: Kaplan-Meier and Aalen-Johansen columns."""
    return f"""{counts(by, source)},
s AS (SELECT *, coalesce(product(1 - d / y) OVER {prior(by)}, 1.0) AS sl, product((y - d) / y) OVER {sofar(by)} AS s FROM c),
f AS (SELECT *, sum(sl * d1 / y) OVER {sofar(by)} AS f1, sum(sl * d2 / y) OVER {sofar(by)} AS f2 FROM s)"""


def variance(by: str = "", source: str = "sv") -> str:
    """CTEs up to v: Aalen-Johansen with variance columns v1, v2."""
    w = sofar(by)
    return f"""{incidence(by, source)},
g AS (
  SELECT *, CASE WHEN s > 0 THEN 1 / s ELSE 0 END AS b,
         sl * sl * (CASE WHEN d1 <= 1 OR y <= 1 THEN 1 ELSE 1 - (d1 - 1) / (y - 1) END) * d1 / (y * y) AS g1,
         sl * sl * (CASE WHEN d2 <= 1 OR y <= 1 THEN 1 ELSE 1 - (d2 - 1) / (y - 1) END) * d2 / (y * y) AS g2
  FROM f),
a AS (
  SELECT *, sum(b * b * (g1 + g2)) OVER {w} AS bb,
         sum((1 + f1 * b) * (1 + f1 * b) * g1 + f1 * b * f1 * b * g2) OVER {w} AS ff1, sum((1 + f1 * b) * b * g1 + f1 * b * b * g2) OVER {w} AS fb1,
         sum((1 + f2 * b) * (1 + f2 * b) * g2 + f2 * b * f2 * b * g1) OVER {w} AS ff2, sum((1 + f2 * b) * b * g2 + f2 * b * b * g1) OVER {w} AS fb2
  FROM g),
v AS (SELECT *, ff1 + f1 * f1 * bb - 2 * f1 * fb1 AS v1, ff2 + f2 * f2 * bb - 2 * f2 * fb2 AS v2 FROM a)"""


def censor(deaths: str, base: str, source: str = "sv", by: str = "") -> str:
    """CTEs up to k: a Kaplan-Meier of censoring, g at and g_left before each time."""
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""k0 AS (SELECT {lead}time, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN {deaths} THEN 1 ELSE 0 END) AS DOUBLE) AS d FROM {source} GROUP BY {lead}time),
k1 AS (SELECT *, sum(n) OVER ({part}ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM k0),
k2 AS (SELECT *, CASE WHEN {base} > 0 THEN 1 - (n - d) / ({base}) ELSE 1 END AS keep FROM k1),
k AS (SELECT *, product(keep) OVER {sofar(by)} AS g, coalesce(product(keep) OVER {prior(by)}, 1.0) AS g_left FROM k2)"""


UNO, SCORE, FG = ("event = 1", "y - d"), ("event <> 0", "y - d"), ("event <> 0", "y")


def gray(rho: int) -> str:
    """Two groups F and O of sv, cause 1: CTEs up to r, one row of score and variance of the first group (the second is the pivot)."""
    p, u = "(ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "(ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    both = lambda text: ", ".join(text.replace("#", g) for g in "01")
    g = {"0": "'F'", "1": "'O'"}
    n = ", ".join(f"CAST(sum(CASE WHEN grp = {g[k]} THEN 1 ELSE 0 END) AS DOUBLE) AS n{k}, CAST(sum(CASE WHEN grp = {g[k]} AND event = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS p{k}, CAST(sum(CASE WHEN grp = {g[k]} AND event = 2 THEN 1 ELSE 0 END) AS DOUBLE) AS q{k}" for k in "01")
    w = {0: "1.0", 1: "(1 - fbl)"}[rho]
    a = lambda i, k: f"-{w} * u{i} * u{k} / tr" if i != k else f"{w} * u{i} * (1 - u{i} / tr)"
    s1 = "CASE WHEN dd > 0 AND y# > 0 THEN (CASE WHEN dd <= 1 OR tr * sl# - 1 <= 0 THEN 1 ELSE 1 - (dd - 1) / (tr * sl# - 1) END) * sl# * dd / (tr * y#) ELSE 0 END AS h#"
    s2 = "CASE WHEN q# > 0 AND s# > 0 THEN (CASE WHEN q# <= 1 OR y# <= 1 THEN 1 ELSE 1 - (q# - 1) / (y# - 1) END) * sl# * sl# * q# / (y# * y#) ELSE 0 END AS j#"
    z = "CASE WHEN s# > 0 THEN 1 - (1 - fb) / s# ELSE 1 END AS z#, CASE WHEN s# > 0 THEN (1 - fb) / s# ELSE 0 END AS x#"
    pieces = " + ".join(f"(a0{k} - z{k} * c0{k}) * (a0{k} - z{k} * c0{k}) * h{k} + x{k} * c0{k} * x{k} * c0{k} * j{k}" for k in "01")
    return f"""t0 AS (SELECT time, {n} FROM sv GROUP BY time),
t1 AS (SELECT *, {both("sum(n#) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y#")} FROM t0),
t2 AS (SELECT *, {both("CASE WHEN y# > 0 THEN 1 - (p# + q#) / y# ELSE 1 END AS k#")} FROM t1 WHERE p0 + q0 + p1 + q1 > 0),
t3 AS (SELECT *, {both(f"coalesce(product(k#) OVER {p}, 1.0) AS sl#, product(k#) OVER {u} AS s#")} FROM t2),
t4 AS (SELECT *, {both(f"coalesce(sum(CASE WHEN y# > 0 THEN sl# * p# / y# ELSE 0 END) OVER {p}, 0.0) AS fl#, CASE WHEN y# > 0 AND sl# > 0 THEN y# / sl# ELSE 0 END AS u#")}, p0 + p1 AS dd FROM t3),
t5 AS (SELECT *, u0 + u1 AS tr, u0 * (1 - fl0) + u1 * (1 - fl1) AS tq FROM t4),
t6 AS (SELECT *, coalesce(sum(CASE WHEN tr > 0 THEN dd / tr ELSE 0 END) OVER {p}, 0.0) AS fbl, sum(CASE WHEN tr > 0 THEN dd / tr ELSE 0 END) OVER {u} AS fb FROM t5),
t7 AS (SELECT *, {a("0", "0")} AS a00, {a("0", "1")} AS a01, CASE WHEN dd > 0 THEN dd / (tr * (1 - fbl)) ELSE 0 END AS rate FROM t6),
t8 AS (SELECT *, sum(a00 * rate) OVER {u} AS c00, sum(a01 * rate) OVER {u} AS c01, {both(s1)}, {both(s2)}, {both(z)} FROM t7),
t9 AS (SELECT sum(CASE WHEN dd > 0 THEN {w} * (p0 - dd * u0 * (1 - fl0) / tq) ELSE 0 END) AS score, sum({pieces}) AS direct,
  {both("sum(z# * z# * h# + x# * x# * j#) AS v3#, sum((a0# - z# * c0#) * z# * h# - x# * c0# * x# * j#) AS v2#, max_by(c0#, time) AS e#")} FROM t8),
r AS (SELECT score, direct + e0 * e0 * v30 + 2 * e0 * v20 + e1 * e1 * v31 + 2 * e1 * v21 AS v FROM t9)"""


def gray_many(groups: list[str]) -> str:
    """Groups of sv, cause 1, rho 0: CTEs up to r, one row with Gray's statistic (the last group is the pivot), by elimination."""
    ks, free = range(len(groups)), range(len(groups) - 1)
    p, u = "(ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "(ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    each = lambda text: ", ".join(text.replace("#", str(k)) for k in ks)
    n = ", ".join(f"CAST(sum(CASE WHEN grp = '{g}' AND {c} THEN 1 ELSE 0 END) AS DOUBLE) AS {x}{k}" for k, g in enumerate(groups) for x, c in (("n", "true"), ("p", "event = 1"), ("q", "event = 2")))
    a = lambda i, k: f"CASE WHEN tr > 0 THEN {f'-u{i} * u{k} / tr' if i != k else f'u{i} * (1 - u{i} / tr)'} ELSE 0 END"
    s1 = "CASE WHEN dd > 0 AND y# > 0 THEN (CASE WHEN dd <= 1 OR tr * sl# - 1 <= 0 THEN 1 ELSE 1 - (dd - 1) / (tr * sl# - 1) END) * sl# * dd / (tr * y#) ELSE 0 END AS h#"
    s2 = "CASE WHEN q# > 0 AND s# > 0 THEN (CASE WHEN q# <= 1 OR y# <= 1 THEN 1 ELSE 1 - (q# - 1) / (y# - 1) END) * sl# * sl# * q# / (y# * y#) ELSE 0 END AS j#"
    z = "CASE WHEN s# > 0 THEN 1 - (1 - fb) / s# ELSE 1 END AS z#, CASE WHEN s# > 0 THEN (1 - fb) / s# ELSE 0 END AS x#"
    move, drift = (lambda i, k: f"(a{i}_{k} - z{k} * c{i}_{k})"), (lambda i, k: f"x{k} * c{i}_{k}")
    sums = [f"sum(CASE WHEN dd > 0 THEN p{i} - dd * u{i} * (1 - fl{i}) / tq ELSE 0 END) AS t{i}" for i in free]
    sums += [f"sum(z{k} * z{k} * h{k} + x{k} * x{k} * j{k}) AS v3_{k}" for k in ks] + [f"sum({move(i, k)} * z{k} * h{k} - {drift(i, k)} * x{k} * j{k}) AS v2_{i}_{k}, max_by(c{i}_{k}, time) AS e{i}_{k}" for i in free for k in ks]
    sums += ["sum(" + " + ".join(f"{move(i, k)} * {move(j, k)} * h{k} + {drift(i, k)} * {drift(j, k)} * j{k}" for k in ks) + f") AS d{i}_{j}" for i in free for j in free]
    cov = [f"d{i}_{j} + " + " + ".join(f"e{i}_{k} * e{j}_{k} * v3_{k} + e{i}_{k} * v2_{j}_{k} + e{j}_{k} * v2_{i}_{k}" for k in ks) + f" AS m{i}_{j}" for i in free for j in free]
    steps = [f"g0 AS (SELECT {', '.join(f't{i}' for i in free)}, {', '.join(cov)}, 0.0 AS stat FROM t9)"]
    for r in free:  # each step takes a row out and adds its part of the quadratic form
        rest = [i for i in free if i > r]
        kept = [f"t{i} - m{i}_{r} / m{r}_{r} * t{r} AS t{i}" for i in rest] + [f"m{i}_{j} - m{i}_{r} / m{r}_{r} * m{r}_{j} AS m{i}_{j}" for i in rest for j in rest]
        steps.append(f"g{r + 1} AS (SELECT {', '.join([*kept, f'stat + t{r} * t{r} / m{r}_{r} AS stat'])} FROM g{r})")
    return f"""t0 AS (SELECT time, {n} FROM sv GROUP BY time),
t1 AS (SELECT *, {each("sum(n#) OVER (ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y#")} FROM t0),
t2 AS (SELECT *, {each("CASE WHEN y# > 0 THEN 1 - (p# + q#) / y# ELSE 1 END AS k#")} FROM t1 WHERE {" + ".join(f"p{k} + q{k}" for k in ks)} > 0),
t3 AS (SELECT *, {each(f"coalesce(product(k#) OVER {p}, 1.0) AS sl#, product(k#) OVER {u} AS s#")} FROM t2),
t4 AS (SELECT *, {each(f"coalesce(sum(CASE WHEN y# > 0 THEN sl# * p# / y# ELSE 0 END) OVER {p}, 0.0) AS fl#, CASE WHEN y# > 0 AND sl# > 0 THEN y# / sl# ELSE 0 END AS u#")}, {" + ".join(f"p{k}" for k in ks)} AS dd FROM t3),
t5 AS (SELECT *, {" + ".join(f"u{k}" for k in ks)} AS tr, {" + ".join(f"u{k} * (1 - fl{k})" for k in ks)} AS tq FROM t4),
t6 AS (SELECT *, coalesce(sum(CASE WHEN tr > 0 THEN dd / tr ELSE 0 END) OVER {p}, 0.0) AS fbl, sum(CASE WHEN tr > 0 THEN dd / tr ELSE 0 END) OVER {u} AS fb FROM t5),
t7 AS (SELECT *, {", ".join(f"{a(i, k)} AS a{i}_{k}" for i in free for k in ks)}, CASE WHEN dd > 0 AND fbl < 1 THEN dd / (tr * (1 - fbl)) ELSE 0 END AS rate FROM t6),
t8 AS (SELECT *, {", ".join(f"sum(a{i}_{k} * rate) OVER {u} AS c{i}_{k}" for i in free for k in ks)}, {each(s1)}, {each(s2)}, {each(z)} FROM t7),
t9 AS (SELECT {", ".join(sums)} FROM t8),
{", ".join(steps)},
r AS (SELECT stat FROM g{len(groups) - 1})"""
