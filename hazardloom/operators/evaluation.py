"""Censoring-weighted evaluation: time-dependent AUC and Brier, their integrals, calibration, bootstrap."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import md5_uniform, wilson
from .censoring import km_censor_score
from .incidence import cif, time_counts
from .scans import is_wide, quantiles, running, step_lookup, with_blocks
from .stored import stored


#: draws of a bootstrap that one task makes, and rows drawn that a task of its joins takes, whatever the session's shuffle partitions
DRAWS, TASK_ROWS = 1_000_000, 250_000


@dataclass
class ScoreResult:
    auc: DataFrame | None = None
    brier: DataFrame | None = None
    iauc: DataFrame | None = None
    ibs: DataFrame | None = None
    calibration: DataFrame | None = None


def long_predictions(df: DataFrame, models: dict[str, Sequence[str]], times: Sequence[float], keep: Sequence[str] = ("time", "event")) -> DataFrame:
    """(model, t, p, kept columns) from one prediction column for each model and time."""
    rows = [F.struct(F.lit(m).alias("model"), F.lit(float(t)).alias("t"), F.col(c).cast("double").alias("p")) for m, cols in models.items() for t, c in zip(times, cols)]
    return df.select(*keep, F.explode(F.array(*rows)).alias("r")).select("r.model", "r.t", "r.p", *keep)


def brier_auc(pred: DataFrame, outcomes: DataFrame, times: Sequence[float], cause: int = 1, by: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """(by.., model, t, brier, auc) from long predictions (by.., model, t, p, time, event[, m]).

    ``outcomes`` (by.., time, event[, m]) fit the censoring curve; ``m`` counts a row's copies (bootstrap). With ``key``
    the outcomes hold each row's key and ``m``, and predictions are (key, model, t, p): copies meet the curve first, then their predictions.
    The scan over distinct predictions of one (model, t) runs by blocks where they are many.
    """
    counted = "m" in outcomes.columns
    m = F.col("m").cast("double") if counted else F.lit(1.0)
    curve = (km_censor_score(outcomes.where("m > 0"), by, weight="m") if counted else km_censor_score(outcomes, by)).select(*by, "time", "g", "g_left")
    if counted:
        curve = stored(curve)  # read for the values at the times and for the join
    at = step_lookup(curve, by, ["g"], times, default=1.0)
    left = curve.select(*by, "time", "g_left")
    if key:
        parts = max(1, -(-outcomes.count() // TASK_ROWS))
        met = outcomes.repartition(parts, *by, "time").join(left.repartition(parts, *by, "time").hint("merge"), [*by, "time"])
        rows = met.repartition(parts, key).join(pred.repartition(parts, key).hint("merge"), key)
    else:
        rows = pred.join(left, [*by, "time"])
    rows = rows.join(F.broadcast(at), [*by, "t"])
    inv, past = F.when(F.col("g_left") > 0, 1 / F.when(F.col("g_left") > 0, F.col("g_left")).otherwise(1.0)).otherwise(0.0), F.when(F.col("g") > 0, 1 / F.when(F.col("g") > 0, F.col("g")).otherwise(1.0)).otherwise(0.0)
    e, seen, p = F.col("event"), F.col("time") <= F.col("t"), F.col("p")
    case, rival, free = (e == cause) & seen, (e != 0) & (e != cause) & seen, ~seen
    zero = lambda c, x: F.when(c, x * m).otherwise(0.0)
    rows = rows.select(*by, "model", "t", "p", "g", m.alias("m"), zero(case, inv).alias("wc"), (zero(rival, inv) + zero(free, past)).alias("wn"), (zero(case, inv * (1 - p) * (1 - p)) + zero(rival, inv * p * p) + zero(free, past * p * p)).alias("sq"), zero(case, F.lit(1.0)).alias("cases"), (zero(rival, F.lit(1.0)) + zero(free, F.lit(1.0))).alias("controls"))
    by_p = rows.groupBy(*by, "model", "t", "p").agg(*[F.sum(c).alias(c) for c in ("wc", "wn", "sq", "m", "cases", "controls")], F.min("g").alias("g"))
    # counted rows are stored and counted, not joined once more for their number
    ranked = running(with_blocks(by_p, "p", None if counted else is_wide(pred, *by, "model", "t", "p")), [*by, "model", "t"], "p", {"low": ("sum", F.col("wn"), "before")})
    out = ranked.groupBy(*by, "model", "t").agg(F.sum("sq").alias("sq"), F.sum("m").alias("n"), F.sum(F.col("wc") * (F.col("low") + 0.5 * F.col("wn"))).alias("num"), F.sum("wc").alias("wc"), F.sum("wn").alias("wn"), F.sum("cases").alias("cases"), F.sum("controls").alias("controls"), F.min("g").alias("g"))
    ok = F.col("g") > 0
    pairs = F.col("wc") * F.col("wn")
    return out.select(*by, "model", "t", F.when(ok, F.col("sq") / F.col("n")).otherwise(math.nan).alias("brier"), F.when(ok & (F.col("cases") > 0) & (F.col("controls") > 0) & (pairs > 0), F.col("num") / F.when(pairs > 0, pairs).otherwise(1.0)).otherwise(math.nan).alias("auc"))


def time_average(metric: DataFrame, value: str, by: Sequence[str] = ("model",), t: str = "t") -> DataFrame:
    """Trapezoid mean over time of the defined points; NaN under two of them or over no span."""
    w = Window.partitionBy(*by).orderBy(t)
    steps = metric.where(~F.isnan(value)).withColumns({"__dt": F.col(t) - F.lag(t).over(w), "__dv": (F.col(value) + F.lag(value).over(w)) / 2})
    out = steps.groupBy(*by).agg(F.sum(F.col("__dt") * F.col("__dv")).alias("__a"), (F.max(t) - F.min(t)).alias("__s"))
    mean = F.when(F.col("__s") > 0, F.col("__a") / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)).otherwise(math.nan)
    return metric.select(*by).distinct().join(out, list(by), "left").select(*by, F.coalesce(mean, F.lit(math.nan)).alias(value))


def calibration_cr(pred: DataFrame, cause: int = 1, n_bins: int = 10, level: float = 0.95, causes: int = 2) -> DataFrame:
    """(model, times, predicted_decile, observed_freq, lower_ci, upper_ci, bin_n) by quantile bin of p.

    Bins are the number of inner breaks strictly below p; equal breaks merge bins and empty bins drop. Means are of
    sums to twelve decimals, which do not depend on the rows' order.
    """
    breaks = quantiles(pred, ["model", "t"], "p", [i / n_bins for i in range(1, n_bins)]).withColumnRenamed("quantiles", "breaks")
    binned = pred.join(F.broadcast(breaks), ["model", "t"]).withColumn("bin", F.size(F.filter("breaks", lambda b: b < F.col("p")))).drop("breaks")
    by = ["model", "t", "bin"]
    # what comes after the horizon counts as at risk alone
    late = F.col("time") > F.col("t")
    seen = binned.select(*by, F.when(late, math.inf).otherwise(F.col("time")).alias("time"), F.when(late, 0).otherwise(F.col("event")).alias("event"))
    curves = cif(time_counts(seen, by, causes, wide=is_wide(pred, "t", "time")), by, causes)
    observed = curves.where(F.col("time") <= F.col("t")).groupBy(*by).agg(F.max_by(f"f_{cause}", "time").alias("obs"))
    mean = F.sum(F.col("p").cast("decimal(38,12)")).cast("double") / F.count("*")
    stats = binned.groupBy(*by).agg(mean.alias("predicted_decile"), F.count("*").alias("bin_n")).join(observed, by, "left").withColumn("obs", F.coalesce("obs", F.lit(0.0)))
    low, high = wilson(F.col("obs"), F.col("bin_n").cast("double"), level)
    return stats.select("model", F.col("t").alias("times"), "bin", "predicted_decile", F.col("obs").alias("observed_freq"), low.alias("lower_ci"), high.alias("upper_ci"), "bin_n")


def bootstrap_copies(df: DataFrame, key: str, n_bootstrap: int, seed: int = 0) -> DataFrame:
    """(rep, columns of df, m): as many draws with replacement as there are rows, in each replicate; rows drawn ``m`` times, at least once.

    Rows are numbered in the order of ``key`` (of its hash, if it is no number), and draw j of a replicate takes the row that
    MD5 of "seed|rep|j" points at, so replicates do not depend on how rows are partitioned.
    """
    order = F.col(key) if isinstance(df.schema[key].dataType, T.NumericType) else F.xxhash64(key)
    rows = running(with_blocks(df.withColumn("__o", order), "__o"), [], ["__o", key], {"__i": ("sum", F.lit(1.0), "before")}).select(*df.columns, F.col("__i").cast("long").alias("__i"))
    n = df.count()
    # a task's draws are of few replicates, so it adds up most of their copies before the shuffle
    spark, every = df.sparkSession, n * n_bootstrap
    draws = spark.range(0, every, 1, max(spark.sparkContext.defaultParallelism, -(-every // DRAWS))).selectExpr(f"id % {max(n, 1)} AS j", f"CAST(id DIV {max(n, 1)} + 1 AS INT) AS rep")
    drawn = draws.groupBy("rep", F.floor(md5_uniform(seed, F.col("rep"), F.col("j")) * n).alias("__i")).agg(F.count("*").cast("int").alias("m"))
    # neither side goes whole through the driver for a broadcast, whatever Spark's estimate of it
    return drawn.hint("merge").join(rows, "__i").drop("__i")


def score_cr(pred: DataFrame, times: Sequence[float], cause: int = 1, metrics: Sequence[str] = ("auc", "brier", "iauc", "ibs"), n_bootstrap: int = 0, level: float = 0.95, key: str = "row_id", seed: int = 0, calibration_at: Sequence[float] = (), calibration_n_bins: int = 10) -> ScoreResult:
    """AUC, Brier and their time averages of long predictions (row key, model, t, p, time, event), with percentile intervals of replicates of as many rows drawn with replacement."""
    if not times or any(b <= a for a, b in zip(times, times[1:])):
        raise ValueError("evaluation times must increase")
    if n_bootstrap:
        pred = stored(pred)  # read for the outcomes, the point and the replicates
    # every row has one outcome: take it from one model and time
    first = pred.where(F.col("t") == float(times[0])).dropDuplicates([key]).select(key, "time", "event")
    point = brier_auc(pred.drop(key), first.drop(key), times, cause)
    averages = {"iauc": time_average(point, "auc"), "ibs": time_average(point, "brier")}
    low, high = None, {}
    if n_bootstrap:
        copies = stored(bootstrap_copies(first, key, n_bootstrap, seed))  # drawn once: curves, predictions and their counts read them
        reps = brier_auc(pred.select(key, "model", "t", "p"), copies, times, cause, ["rep"], key)
        low = lambda c: [F.percentile(F.when(~F.isnan(c), F.col(c)), q).alias(n) for n, q in (("lower", (1 - level) / 2), ("upper", (1 + level) / 2))]
        high = {c: reps.groupBy("model", "t").agg(*low(c)) for c in ("auc", "brier")}
        high |= {n: time_average(reps, c, ("rep", "model")).groupBy("model").agg(*low(c)) for n, c in (("iauc", "auc"), ("ibs", "brier"))}
    none = [F.lit(None).cast("double").alias(c) for c in ("lower", "upper")]

    def frame(value: str, label: str, source: DataFrame, on: list[str], limits: DataFrame | None) -> DataFrame:
        found = source.join(limits, on, "left") if limits is not None else source.select("*", *none)
        return found.select(F.col("model"), *([F.col("t").alias("times")] if "t" in on else []), F.col(value).alias(label), "lower", "upper")

    out = ScoreResult()
    if "auc" in metrics:
        out.auc = frame("auc", "AUC", point.drop("brier"), ["model", "t"], high.get("auc"))
    if "brier" in metrics:
        out.brier = frame("brier", "Brier", point.drop("auc"), ["model", "t"], high.get("brier"))
    if "iauc" in metrics:
        out.iauc = frame("auc", "iAUC", averages["iauc"], ["model"], high.get("iauc"))
    if "ibs" in metrics:
        out.ibs = frame("brier", "IBS", averages["ibs"], ["model"], high.get("ibs"))
    if calibration_at:
        out.calibration = calibration_cr(pred.where(F.col("t").isin([float(t) for t in calibration_at])).drop(key), cause, calibration_n_bins, level)
    return out
