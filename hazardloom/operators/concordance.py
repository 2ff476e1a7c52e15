"""Concordance by dominance counting.

"How many rows have a later time and a lower risk" is counted exactly without a pair join: times become
dense ranks; two ranks differ first at one bit, so every ordered pair meets in exactly one (bit, prefix)
cell, where the row with bit 0 needs the running weight of rows with bit 1 in risk order. Rows of equal
(time, risk) are added up first and stored with their ranks, which everything else is counted from. n rows make
n log(times) cell rows instead of n^2 pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .censoring import km_censor_uno
from .scans import ONE_TASK, is_wide, running, with_blocks
from .stored import stored


def dominance(df: DataFrame, rank: str, risk: str, left: str, right: str, bits: int, by: Sequence[str] = (), wide: bool = True) -> DataFrame:
    """(by.., less, equal): sums over pairs with rank_i < rank_j of left_i * right_j where risk_j < risk_i, or equals it.

    The cells of the highest bits hold all rows: where those are many (``wide``) their scans run by blocks of the risk.
    """
    cells = df.select(*by, F.col(risk).alias("p"), F.col(left).alias("a"), F.col(right).alias("b"), F.col(rank).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    cells = cells.select(*by, "bit", F.expr("shiftright(r, bit + 1)").alias("prefix"), (F.expr("shiftright(r, bit)") % 2).alias("high"), "p", "a", "b")
    cell = [*by, "bit", "prefix"]
    merged = cells.groupBy(*cell, "p").agg(F.sum(F.when(F.col("high") == 0, F.col("a")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("high") == 1, F.col("b")).otherwise(0.0)).alias("b"))
    merged = running(with_blocks(merged, "p", wide), cell, "p", {"lower": ("sum", F.col("b"), "before")})
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.col("a") * F.col("lower")), F.lit(0.0)).alias("less"), F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0.0)).alias("equal"))


def _ranked(counts: DataFrame, time: str) -> tuple[DataFrame, int, bool]:
    """(counts with __rank, the dense rank of their time, stored; the bits that ranks need; whether they are more rows than one task may scan)."""
    counts = stored(counts)
    times = counts.select(time).distinct()
    n, rows = times.count(), counts.count()
    ranks = running(with_blocks(times, time, n > ONE_TASK), [], time, {"__r": ("sum", F.lit(1.0), "upto")})
    return stored(counts.join(ranks.select(time, F.col("__r").cast("long").alias("__rank")), time)), max(1, int(n).bit_length()), rows > ONE_TASK


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant group where none is asked for."""
    return (df, list(by)) if by else (df.withColumn("__all", F.lit(0)), ["__all"])


def concordance_pairs(df: DataFrame, cause: int = 1, event: str = "event", time: str = "time", risk: str = "risk", by: Sequence[str] = ()) -> DataFrame:
    """(by.., comparable, concordant, tied): pairs of a case of ``cause`` and any row of a later time of its group."""
    df, by = _grouped(df, by)
    counts = df.groupBy(*by, F.col(time).alias("time"), F.col(risk).alias("risk")).agg(F.sum(F.when(F.col(event) == cause, 1.0).otherwise(0.0)).alias("a"), F.count("*").cast("double").alias("b"))
    ranked, bits, wide = _ranked(counts, "time")
    pairs = dominance(ranked, "__rank", "risk", "a", "b", bits, by, wide)
    by_time = ranked.groupBy(*by, "time").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    by_time = running(with_blocks(by_time, "time", wide), by, "time", {"later": ("sum", F.col("b"), "after")})
    comparable = by_time.groupBy(*by).agg(F.sum(F.col("a") * F.col("later")).alias("comparable"))
    return comparable.join(pairs, by).select(*[b for b in by if b != "__all"], "comparable", F.col("less").alias("concordant"), F.col("equal").alias("tied"))


def concordance_index_cr(df: DataFrame, cause: int = 1, event: str = "event", time: str = "time", risk: str = "risk") -> float:
    """Cause-specific C: 0.5 without rows, cases or comparable pairs; ValueError for a cause beyond the largest code."""
    top = df.agg(F.max(event)).first()[0]
    if top is None:
        return 0.5
    if cause > top:
        raise ValueError(f"cause {cause} is larger than the largest code {top}")
    row = concordance_pairs(df, cause, event, time, risk).first()
    if row is None or not row["comparable"]:
        return 0.5
    return (row["concordant"] + 0.5 * row["tied"]) / row["comparable"]


def gmin_auto(g: DataFrame, ess_frac: float = 0.2, ess_min: int = 20, eps: float = 1e-12) -> float:
    """The smallest sorted event value of G whose upper tail reaches the target effective sample size.

    ``g``: (g, n) with the number of event rows at each distinct value; tails run over that table.
    """
    d, low = g.agg(F.sum("n"), F.min("g")).first()
    if d is None or d <= 1 or low >= 1 - 1e-12:
        return 0.0
    target = min(max(ess_min, math.ceil(ess_frac * d)), int(d))
    weight = 1.0 / F.pow(F.greatest("g", F.lit(eps)), F.lit(2.0))
    tail = running(with_blocks(g, "g", is_wide(g, "g")), [], "g", {"m": ("sum", F.col("n"), "onward"), "w1": ("sum", F.col("n") * weight, "onward"), "w2": ("sum", F.col("n") * weight * weight, "onward")})
    # within one value's rows the tail can begin at any of them: the first that qualifies has the most rows of it
    fits = tail.where((F.col("m") >= target) & (F.col("w1") * F.col("w1") / F.col("w2") >= target))
    found = fits.agg(F.min("g")).first()[0]
    # a tail that begins inside a run of equal values has the same least value
    edge = tail.where(F.col("m") >= target).agg(F.max("g")).first()[0]
    return float(found if found is not None else edge)


def compute_uno_weights(df: DataFrame, time: str = "time", event: str = "event", gmin: float | str = "auto", ess_frac: float = 0.2, ess_min: int = 20, eps: float = 1e-12, eps_keep: float = 2.220446049250313e-16) -> DataFrame:
    """``df`` with g_left and w = 1 / max(G(t-), eps)^2; rows under gmin get ``eps_keep``, NaN or null rows 0."""
    missing = F.col(time).isNull() | F.isnan(F.col(time).cast("double")) | F.col(event).isNull()
    curve = km_censor_uno(df.where(~missing), time, event).select(F.col("time").alias("__t"), "g_left")
    joined = df.join(curve, F.col(time) == F.col("__t"), "left").drop("__t")
    if gmin == "auto":
        events = joined.where((F.col(event) != 0) & ~missing).groupBy(F.col("g_left").alias("g")).agg(F.count("*").cast("double").alias("n"))
        least = gmin_auto(events, ess_frac, ess_min, eps)
    else:
        least = 0.0 if gmin == "none" or not math.isfinite(gmin) or gmin < 0 else float(gmin)
    safe = F.greatest("g_left", F.lit(eps))
    return joined.withColumn("w", F.when(F.col("g_left").isNull(), 0.0).when(F.col("g_left") >= least, 1 / (safe * safe)).otherwise(eps_keep))


def uno_terms(df: DataFrame, cause: int = 1, event: str = "event", time: str = "time", risk: str = "risk", weight: str = "w", by: Sequence[str] = ()) -> DataFrame:
    """(by.., numer, denom): later or tied-censored rows (A), tied cases (B) and earlier competing rows (C)."""
    df, by = _grouped(df, by)
    e, w = F.col(event), F.col(weight)
    rows = df.where((w > 0) & F.col(time).isNotNull() & F.col(risk).isNotNull() & ~F.isnan(F.col(risk).cast("double"))).select(
        *by, F.col(time).alias("time"), F.col(risk).alias("risk"),
        F.when(e == cause, w).otherwise(0.0).alias("wa"), F.when(e == cause, F.sqrt(w)).otherwise(0.0).alias("ra"),
        F.when((e > 0) & (e != cause), F.sqrt(w)).otherwise(0.0).alias("rc"), F.when(e == 0, 1.0).otherwise(0.0).alias("cens"), F.when(e == cause, 1.0).otherwise(0.0).alias("case"),
    )
    counts = rows.groupBy(*by, "time", "risk").agg(*[F.sum(c).alias(c) for c in ("wa", "ra", "rc", "cens", "case")], F.count("*").cast("double").alias("one"))
    counts, bits, wide = _ranked(counts, "time")
    ranked = counts.withColumn("__down", F.lit(1 << bits) - F.col("__rank"))
    a = dominance(ranked, "__rank", "risk", "wa", "one", bits, by, wide)
    c = dominance(ranked, "__down", "risk", "ra", "rc", bits + 1, by, wide)
    low = running(with_blocks(counts.drop("__rank"), "risk", wide), [*by, "time"], "risk", {"cens_low": ("sum", F.col("cens"), "before"), "rc_low": ("sum", F.col("rc"), "before")})
    same = low.groupBy(*by, "time").agg(
        *[F.sum(c).alias(c) for c in ("wa", "ra", "rc", "cens", "case", "one")],
        F.sum(2 * F.col("wa") * F.col("cens_low") + F.col("wa") * F.col("cens")).alias("na"),
        F.sum(2 * F.col("ra") * F.col("rc_low") + F.col("ra") * F.col("rc")).alias("nc"),
        F.sum(F.when(F.col("case") > 1, (F.col("case") - 1) * F.col("wa")).otherwise(0.0)).alias("ties"),
    )
    same = running(with_blocks(same, "time", wide), by, "time", {"later": ("sum", F.col("one"), "after"), "comp": ("sum", F.col("rc"), "upto")})
    tie = F.when(F.col("case") > 1, (F.col("case") - 1) * F.col("wa")).otherwise(0.0)
    sums = same.groupBy(*by).agg(
        F.sum(2 * F.col("wa") * (F.col("later") + F.col("cens")) + tie + 2 * F.col("ra") * F.col("comp")).alias("denom"),
        F.sum(F.col("na") + F.col("nc") + 0.5 * tie + 0.5 * F.col("ties")).alias("same"),
    )
    one = lambda x, n: x.select(*by, (2 * F.col("less") + F.col("equal")).alias(n))
    joined = sums.join(one(a, "x"), by).join(one(c, "z"), by)
    return joined.select(*[b for b in by if b != "__all"], (F.col("same") + F.col("x") + F.col("z")).alias("numer"), "denom")


def concordance_index_uno_cr(df: DataFrame, cause: int = 1, event: str = "event", time: str = "time", risk: str = "risk", weight: str = "w") -> float:
    """Weighted C; NaN where it is undefined."""
    row = uno_terms(df, cause, event, time, risk, weight).first()
    return row["numer"] / row["denom"] if row is not None and row["denom"] else math.nan
