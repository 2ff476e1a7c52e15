"""Prefix scans and step-function lookups.

A scan over an order is one window by group, hence one task for each group, while its table is known to be small
(``ONE_TASK`` rows in all). Beyond that the table carries a block column: blocks are ranges of the order, scans run by
(group, block), and the blocks' totals, a table of bounded size, are scanned and joined back. Ranges are cut at quantiles of a sample of
the order, so they are even however narrow or skewed its values are. A table that is scanned by blocks is written to the shared folder first (:mod:`stored`): it
is read for the sample, the scan and the totals, and scans of scans do not make what came before anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

FIRST = Window.unboundedPreceding
#: rows of a table that one task may scan
ONE_TASK = 1_000_000
#: rows that a block should have, the most blocks there are, and values drawn for each to find its bounds
BLOCK_ROWS, MOST_BLOCKS, DRAWN = 250_000, 4096, 32
#: the block column
BLOCK = "__block"


def splitters(df: DataFrame, order: str, rows: int) -> list[float]:
    """Rising bounds that part ``df`` into even ranges of a number: quantiles of a sample of bounded size, which comes to the driver.

    Null and NaN need no bound: they sort before and after all others.
    """
    pieces = min(MOST_BLOCKS, max(2, -(-rows // BLOCK_ROWS)))
    x = F.col(order).cast("double")
    drawn = df.select(x.alias("x")).where(x.isNotNull() & ~F.isnan(x)).sample(min(1.0, 2.0 * pieces * DRAWN / max(rows, 1)), seed=11)
    found = sorted(r[0] for r in drawn.collect())
    return sorted({found[len(found) * i // pieces] for i in range(1, pieces)}) if found else []


def block_of(value: Column, bounds: Sequence[float]) -> Column:
    """How many of the rising bounds are at or below a number, by binary search; null counts as below all, NaN as above all."""
    if not bounds:
        return F.lit(0)
    array, steps = F.array(*[F.lit(float(b)) for b in bounds]), [1 << b for b in reversed(range(len(bounds).bit_length()))]
    x = value.cast("double")
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= x, at + step).otherwise(at))


def is_wide(df: DataFrame, *columns: str) -> bool:
    """Whether the distinct values of the columns (about) are more than one task may scan."""
    return (df.agg(F.approx_count_distinct(F.struct(*columns))).first()[0] or 0) > ONE_TASK


def with_blocks(df: DataFrame, order: str, wide: bool | None = None, bounds: Sequence[float] | None = None) -> DataFrame:
    """``df`` with the block column where it is ``wide``: scans over it then run by blocks. By default its rows are counted.

    ``bounds`` are of :func:`splitters`, for tables that share an order; by default they are drawn from ``df``.
    """
    if wide is False:
        return df
    df = df if getattr(df, "_stored", False) else stored(df)
    if wide is None or bounds is None:
        rows = df.count()
        if wide is None and rows <= ONE_TASK:
            return df
        bounds = splitters(df, order, rows) if bounds is None else bounds
    out = df.withColumn(BLOCK, block_of(F.col(order), bounds))
    out._stored = True
    return out


def running(df: DataFrame, by: Sequence[str], order: str | Sequence[str], outputs: dict[str, tuple[str, Column, str]]) -> DataFrame:
    """``df`` with scans by group: name -> (op, value, span).

    op is ``sum``, ``product``, ``last`` (the last value that is not null, looking back) or ``next`` (the first, looking on); span is ``upto`` a row, strictly ``before``
    it, ``onward`` from it or strictly ``after`` it. Empty spans are 0, 1 and null. With a block column (:func:`with_blocks`, of the first order column) the scans run by block.
    """
    by, keys = list(by), [order] if isinstance(order, str) else list(order)
    spans = {"upto": (True, 0), "before": (True, -1), "onward": (False, 0), "after": (False, -1)}

    def scan(op: str, x: Column, span: str, by: Sequence[str], keys: Sequence[str]) -> Column:
        """What comes later is scanned from the far end: a frame that grows takes one step a row, one that shrinks is summed anew for each."""
        forward, to = spans[span]
        window = Window.partitionBy(*by).orderBy(*keys if forward else [F.col(k).desc() for k in keys]).rowsBetween(FIRST, to)
        if op in ("last", "next"):
            if (op == "last") != forward:
                raise ValueError(f"{op} does not go with {span}")
            return F.last(x, ignorenulls=True).over(window)
        return F.coalesce(F.sum(x).over(window) if op == "sum" else F.product(x).over(window), F.lit(0.0 if op == "sum" else 1.0))

    if BLOCK not in df.columns:
        return df.withColumns({n: scan(op, x, span, by, keys) for n, (op, x, span) in outputs.items()})
    df = df if getattr(df, "_stored", False) else stored(df)
    made = df.withColumns({n: scan(op, x, span, [*by, BLOCK], keys) for n, (op, x, span) in outputs.items()})
    at = lambda x: F.when(x.isNotNull(), F.struct(*keys))
    whole = {"sum": F.sum, "product": F.product, "last": lambda x: F.max_by(x, at(x)), "next": lambda x: F.min_by(x, at(x))}
    totals = df.groupBy(*by, BLOCK).agg(*[whole[op](x).alias(f"__t_{n}") for n, (op, x, _) in outputs.items()])
    strict = {"upto": "before", "before": "before", "onward": "after", "after": "after"}
    offsets = totals.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate([*by, BLOCK])], *[scan(op, F.col(f"__t_{n}"), strict[span], by, [BLOCK]).alias(f"__o_{n}") for n, (op, _, span) in outputs.items()])
    match = F.lit(True)
    for i, b in enumerate([*by, BLOCK]):
        match &= F.col(b).eqNullSafe(F.col(f"__k{i}"))
    joint = {"sum": lambda a, b: a + b, "product": lambda a, b: a * b, "last": F.coalesce, "next": F.coalesce}
    joined = made.join(offsets, match).withColumns({n: joint[op](F.col(n), F.col(f"__o_{n}")) for n, (op, _, _) in outputs.items()})
    return joined.drop(*[f"__k{i}" for i in range(len(by) + 1)], *[f"__o_{n}" for n in outputs])


def quantiles(values: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], weight: str | None = None, wide: bool | None = None) -> DataFrame:
    """(by.., quantiles): exact quantiles by linear interpolation of a column (null and NaN left out), each row ``weight`` times.

    Equal values are added up first; ranks then come from a running sum, so no group needs to fit a task.
    """
    by = list(by)
    if wide is None:
        wide = is_wide(values, *by, value)
    counted = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("__v")).agg((F.sum(weight) if weight else F.count("*")).cast("long").alias("__n"))
    if not wide:
        return counted.groupBy(*by).agg(F.percentile("__v", F.array(*[F.lit(float(q)) for q in qs]), F.col("__n")).alias("quantiles"))
    ranked = running(with_blocks(counted, "__v"), by, "__v", {"__upto": ("sum", F.col("__n").cast("double"), "upto")})
    total = counted.groupBy(*by).agg(F.sum("__n").alias("__all")).select(*[F.col(b).alias(f"__g{i}") for i, b in enumerate(by)], "__all")
    match = F.lit(True)
    for i, b in enumerate(by):
        match &= F.col(b).eqNullSafe(F.col(f"__g{i}"))
    ranked = ranked.join(total, match)
    at = [(F.col("__all") - 1) * F.lit(float(q)) for q in qs]
    first = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("__v")))  # noqa: E731  the value of a rank, counted from 0
    found = ranked.groupBy(*by).agg(*[first(F.floor(x)).alias(f"__l{i}") for i, x in enumerate(at)], *[first(F.ceil(x)).alias(f"__h{i}") for i, x in enumerate(at)], F.max("__all").alias("__all"))
    part = lambda i: at[i] - F.floor(at[i])
    # between equal values the quantile is that value: the weighted sum can miss it by the last bit, and its rows then change sides
    exact = lambda i: (part(i) == 0) | (F.col(f"__l{i}") == F.col(f"__h{i}"))
    return found.select(*by, F.array(*[F.when(exact(i), F.col(f"__l{i}")).otherwise((1 - part(i)) * F.col(f"__l{i}") + part(i) * F.col(f"__h{i}")) for i in range(len(qs))]).alias("quantiles"))


def step_lookup(curves: DataFrame, by: Sequence[str], values: Sequence[str], times: Sequence[float], time: str = "time", default: float = 0.0, strict: bool = False, name: str = "t") -> DataFrame:
    """Right-continuous (or, ``strict``, left-limit) values of step curves at a few times: one aggregation with partial results."""
    hit = lambda t: F.col(time) < t if strict else F.col(time) <= t
    picked = [F.max_by(F.struct(*values), F.when(hit(t), F.col(time))).alias(f"__{i}") for i, t in enumerate(times)]
    last = [F.max(F.when(hit(t), F.lit(True))).alias(f"__h{i}") for i, t in enumerate(times)]
    found = curves.groupBy(*by).agg(*picked, *last)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("at"), F.when(F.col(f"__h{i}"), F.col(f"__{i}")).alias("v")) for i, t in enumerate(times)]))
    return found.select(*by, rows.alias("__r")).select(*by, F.col("__r.at").alias(name), *[F.coalesce(f"__r.v.{v}", F.lit(default)).alias(v) for v in values])


def asof_join(queries: DataFrame, knots: DataFrame, on: str, value: str, by: Sequence[str] = (), default: float = 0.0, strict: bool = False) -> DataFrame:
    """As-of join of two large frames: each query row gets the last knot's value at or (strict) before it; by blocks of ``on``, whatever the groups."""
    columns = queries.columns
    asked = queries.select(*[F.struct(*columns).alias("__row")], *by, F.col(on).alias("__on"), F.lit(None).cast(knots.schema[value].dataType).alias("__v"), F.lit(0 if strict else 1).alias("__q"))
    steps = knots.select(F.lit(None).cast(asked.schema["__row"].dataType).alias("__row"), *by, F.col(on).alias("__on"), F.col(value).alias("__v"), F.lit(1 if strict else 0).alias("__q"))
    found = running(with_blocks(asked.unionByName(steps), "__on"), by, ["__on", "__q"], {"__found": ("last", F.col("__v"), "upto")})
    return found.where("__row is not null").select("__row.*", F.coalesce("__found", F.lit(default)).alias(value))
