"""Non-parametric estimators: counts by distinct time, then prefix windows.

The shuffle carries one row for each (group, distinct time) thanks to partial aggregation; every scan
that follows runs on that table, by blocks of time where it is too large for one task a group (:mod:`scans`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hazard
from .scans import is_wide, running, step_lookup, with_blocks


def time_counts(df: DataFrame, by: Sequence[str] = (), causes: int = 2, time: str = "time", event: str = "event", wide: bool | None = None) -> DataFrame:
    """by.., time, n, d (all causes), d_1 .. d_K, y (at risk just before the time).

    ``wide`` says whether there are more distinct (group, time) pairs than one task may scan; by default they are counted, about.
    """
    wide = is_wide(df, *by, time) if wide is None else wide
    counts = df.groupBy(*by, time).agg(F.count("*").cast("double").alias("n"), F.sum(F.when(F.col(event) != 0, 1.0).otherwise(0.0)).alias("d"), *[F.sum(F.when(F.col(event) == k, 1.0).otherwise(0.0)).alias(f"d_{k}") for k in range(1, causes + 1)])
    return running(with_blocks(counts, time, wide), by, time, {"y": ("sum", F.col("n"), "onward")})


def kaplan_meier(counts: DataFrame, by: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Adds s_left (just before the time) and s (at it)."""
    alive = F.when(F.col("y") > 0, (F.col("y") - F.col("d")) / F.col("y")).otherwise(1.0)
    return running(counts, by, time, {"s_left": ("product", alive, "before"), "s": ("product", alive, "upto")})


def nelson_aalen(counts: DataFrame, by: Sequence[str] = (), d: str = "d", name: str = "chf", time: str = "time") -> DataFrame:
    return running(counts, by, time, {name: ("sum", hazard(F.col(d), F.col("y")), "upto")})


def cif(counts: DataFrame, by: Sequence[str] = (), causes: int = 2, time: str = "time") -> DataFrame:
    """Adds the Aalen-Johansen f_1 .. f_K to Kaplan-Meier columns."""
    km = kaplan_meier(counts, by, time)
    return running(km, by, time, {f"f_{k}": ("sum", F.col("s_left") * hazard(F.col(f"d_{k}"), F.col("y")), "upto") for k in range(1, causes + 1)})


def cif_variance(counts: DataFrame, by: Sequence[str] = (), causes: int = 2, time: str = "time") -> DataFrame:
    """Adds v_1 .. v_K, the delta-method variance of the incidences with tied-event correction."""
    f = cif(counts, by, causes, time)
    y, s = F.col("y"), F.col("s")
    sigma = {}
    for k in range(1, causes + 1):
        d = F.col(f"d_{k}")
        tied = F.when((d <= 1) | (y <= 1), 1.0).otherwise(1.0 - (d - 1) / F.when(y > 1, y - 1).otherwise(1.0))
        sigma[f"g_{k}"] = F.col("s_left") * F.col("s_left") * tied * d / (y * y)
    f = f.withColumns(sigma).withColumn("b", F.when(s > 0, 1 / F.when(s > 0, s).otherwise(1.0)).otherwise(0.0))
    b, total = F.col("b"), sum((F.col(f"g_{k}") for k in range(2, causes + 1)), F.col("g_1"))
    sums = {"bb": ("sum", b * b * total, "upto")}
    for k in range(1, causes + 1):
        own, rest, fb = F.col(f"g_{k}"), total - F.col(f"g_{k}"), F.col(f"f_{k}") * b
        sums[f"ff_{k}"] = ("sum", (1 + fb) * (1 + fb) * own + fb * fb * rest, "upto")
        sums[f"fb_{k}"] = ("sum", (1 + fb) * b * own + fb * b * rest, "upto")
    f = running(f, by, time, sums)
    var = {f"v_{k}": F.col(f"ff_{k}") + F.col(f"f_{k}") * F.col(f"f_{k}") * F.col("bb") - 2 * F.col(f"f_{k}") * F.col(f"fb_{k}") for k in range(1, causes + 1)}
    return f.withColumns(var).drop(*sigma, *sums, "b")


class CumulativeIncidence:
    """Incidence curves by group: ``fit(df)``, then ``curves`` (long rows) and ``timepoints``.

    ``cause_codes`` filters the output only; the recursion always runs over every observed cause, and a
    requested cause without events is an empty curve that evaluates to 0.
    """

    def __init__(self, cause_codes: Sequence[int] | None = None):
        self.cause_codes = cause_codes

    def fit(self, df: DataFrame, time: str = "time", event: str = "event", group: str | None = None) -> CumulativeIncidence:
        self.by = [group] if group else []
        seen = sorted(r[0] for r in df.where(F.col(event) > 0).select(event).distinct().collect())
        if not seen:
            raise ValueError("no events")
        codes = list(self.cause_codes) if self.cause_codes is not None else seen
        # causes are numbered as they are observed, so gaps in the codes cost nothing
        coded = df.select(*self.by, F.col(time).cast("double").alias("time"), F.coalesce(*[F.when(F.col(event) == c, i + 1) for i, c in enumerate(seen)], F.lit(0)).alias("event"))
        fitted = cif_variance(time_counts(coded, self.by, len(seen)), self.by, len(seen))
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"d_{i + 1}").alias("d"), F.col(f"f_{i + 1}").alias("cif"), F.col(f"v_{i + 1}").alias("var")) for i, c in enumerate(seen)]))
        self.curves = fitted.select(*self.by, "time", long.alias("r")).where("r.d > 0").select(*self.by, F.col("r.cause").alias("cause"), "time", F.col("r.cif").alias("cif"), F.col("r.var").alias("var")).where(F.col("cause").isin(codes))
        pairs = (coded.select(*self.by).distinct() if self.by else df.sparkSession.range(1).select()).withColumn("cause", F.explode(F.array(*[F.lit(c) for c in codes])))
        self.pairs = pairs
        return self

    def timepoints(self, times: Sequence[float]) -> DataFrame:
        """by, cause, t, cif, var in the order of (group as string, cause, t)."""
        found = step_lookup(self.curves, [*self.by, "cause"], ["cif", "var"], times)
        grid = self.pairs.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in times])))
        out = grid.join(found, [*self.by, "cause", "t"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("cif", "var")})
        return out.orderBy(*[F.col(b).cast("string") for b in self.by], "cause", "t")
