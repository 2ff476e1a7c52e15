"""Risk-set quantities of proportional (subdistribution) hazards models, in one task or distributed.

Both forms give the same numbers from the same algebra: with r = exp(eta - shift), S0 at an event time is the sum of r
over rows still at risk plus, for the subdistribution, reweighted competing rows; a row's accumulated hazard
``a`` then follows from sums over event times before and after its own time, so nothing of size rows x events is made.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import recode
from .censoring import km_censor_fg
from .scans import running, splitters, with_blocks
from .stored import mark, release, stored


class TaskRisk:
    """Rows of one task as arrays. ``status``: 0 censored, 1 the cause, 2 competing (ignored when ``subdistribution`` is off)."""

    def __init__(self, x: np.ndarray, time: np.ndarray, status: np.ndarray, stratum: np.ndarray | None = None, subdistribution: bool = True):
        self.x, self.time = np.ascontiguousarray(x, float), np.asarray(time, float)
        self.case = np.asarray(status) == 1
        self.rival = (np.asarray(status) == 2) & subdistribution
        self.n, self.p = self.x.shape
        self.events, self.deaths = np.unique(self.time[self.case], return_counts=True)
        if not len(self.events):
            raise ValueError("no event of the cause")
        self.deaths = self.deaths.astype(float)
        self.up = np.searchsorted(self.events, self.time, side="right")
        codes, self.k = np.unique(np.zeros(self.n) if stratum is None else stratum, return_inverse=True)
        self.g, self.g_row = np.ones((len(codes), len(self.events))), np.ones(self.n)
        if subdistribution:
            for k in range(len(codes)):
                mine = self.k == k
                t, inverse = np.unique(self.time[mine], return_inverse=True)
                lost = np.bincount(inverse, weights=(np.asarray(status)[mine] == 0))
                risk = np.bincount(inverse)[::-1].cumsum()[::-1]
                left = np.concatenate([[1.0], np.cumprod(1 - lost / risk)])
                self.g[k] = left[np.searchsorted(t, self.events, side="left")]
                self.g_row[mine] = left[np.searchsorted(t, self.time[mine], side="left")]
        self.inv_g = np.where(self.rival & (self.g_row > 0), 1 / np.where(self.g_row > 0, self.g_row, 1), 0.0)

    def _at_risk(self, value: np.ndarray) -> np.ndarray:
        """Sum over rows at risk (reweighted ones included) of ``value`` at each event time."""
        m = len(self.events)
        out = np.bincount(self.up, weights=value, minlength=m + 1)[::-1].cumsum()[::-1][1 : m + 1]
        for k in range(len(self.g)):
            mine = self.rival & (self.k == k)
            if mine.any():
                out = out + self.g[k] * np.bincount(self.up[mine], weights=(value * self.inv_g)[mine], minlength=m + 1).cumsum()[:m]
        return out

    def _gather(self, value: np.ndarray, power: int = 1) -> np.ndarray:
        """For each row, the sum of ``value`` over event times it is at risk at, with its weights to ``power``."""
        before = np.concatenate([[0.0], np.cumsum(value)])
        out = before[self.up]
        for k in range(len(self.g)):
            mine = self.rival & (self.k == k)
            if mine.any():
                after = np.concatenate([np.cumsum((self.g[k] ** power * value)[::-1])[::-1], [0.0]])
                out[mine] += after[self.up[mine]] * self.inv_g[mine] ** power
        return out

    def _core(self, eta: np.ndarray):
        shift = eta.max()
        r = np.exp(eta - shift)
        s0 = self._at_risk(r)
        return shift, r, s0, float(np.sum(eta[self.case] - shift) - np.sum(self.deaths * np.log(s0)))

    def newton(self, beta: np.ndarray):
        """(nll, score, information)."""
        shift, r, s0, ll = self._core(self.x @ beta)
        mean = np.stack([self._at_risk(r * c) for c in self.x.T], axis=1) / s0[:, None]
        a = self._gather(self.deaths / s0)
        score = self.x[self.case].sum(axis=0) - self.deaths @ mean
        info = (self.x * (r * a)[:, None]).T @ self.x - (mean * self.deaths[:, None]).T @ mean
        return -ll, score, info

    def working(self, eta: np.ndarray):
        """(z'st, diag curvature w, log likelihood, log S0): the quadratic model at eta."""
        shift, r, s0, ll = self._core(eta)
        a, a2 = self._gather(self.deaths / s0), self._gather(self.deaths / s0**2, 2)
        return self.case - r * a, np.maximum(r * a - r * r * a2, 0.0), ll, np.log(s0) + shift

    def meat(self, beta: np.ndarray):
        """Sum of the outer products of the rows' score residuals, or None where S0 vanishes."""
        shift, r, s0, _ = self._core(self.x @ beta)
        if (s0 <= 0).any():
            return None
        mean = np.stack([self._at_risk(r * c) for c in self.x.T], axis=1) / s0[:, None]
        rate = self.deaths / s0
        drag = np.stack([self._gather(rate * c) for c in mean.T], axis=1)
        u = -r[:, None] * (self.x * self._gather(rate)[:, None] - drag)
        at = np.searchsorted(self.events, self.time[self.case])
        u[self.case] += self.x[self.case] - mean[at]
        return u.T @ u

    def baseline(self, beta: np.ndarray):
        shift, _, s0, _ = self._core(self.x @ beta)
        return self.events, np.cumsum(self.deaths / (s0 * np.exp(shift)))


#: distinct (stratum, time) pairs whose sums the driver takes; beyond, they stay distributed (:class:`FarRisk`)
MOST_TIMES = 2_000_000
#: rows up to which a per-time table is broadcast (a few columns of doubles)
BROADCAST_TIMES = 500_000


class SparkRisk:
    """The same over a DataFrame of any size: per step, one aggregation by distinct time (whose table comes to the
    driver: one row for each distinct time and stratum) and one O(p^2) aggregation of the rows joined with it."""

    def __init__(self, df: DataFrame, features: Sequence[str], cause: int = 1, time: str = "time", event: str = "event", stratum: str | None = None, subdistribution: bool = True):
        self.features, self.p, self.subdistribution = list(features), len(features), subdistribution
        rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(time).cast("double").alias("time"), recode(F.col(event), cause).alias("event"), (F.col(stratum) if stratum else F.lit(0)).alias("k"))
        g = km_censor_fg(rows, ["k"]).select("k", "time", "g_left")
        self.times = g.count()
        self.hint = F.broadcast if self.times <= BROADCAST_TIMES else (lambda df: df)
        self.rows = rows.join(self.hint(g), ["k", "time"]).withColumn("inv_g", F.when((F.col("event") == 2) & (F.col("g_left") > 0), 1 / F.col("g_left")).otherwise(0.0) if subdistribution else F.lit(0.0)).persist()
        head = self.rows.agg(F.count("*").alias("n"), *[F.max(F.abs(f"x{i}")) for i in range(self.p)]).first()
        self.n, self.largest = head[0], np.array(head[1:], float)

    def close(self) -> None:
        self.rows.unpersist()

    def _eta(self, beta):
        return sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))

    def _tables(self, beta: np.ndarray):
        """Per-time sums on the driver and what follows from them."""
        shift = float(np.abs(beta) @ self.largest)  # at least the largest eta
        r = F.exp(self._eta(beta) - shift)
        xs = [F.lit(1.0), *[F.col(f"x{i}") for i in range(self.p)]]
        is_case = F.col("event") == 1
        sums = [F.sum(r * x).alias(f"r{i}") for i, x in enumerate(xs)] + [F.sum(r * x * F.col("inv_g")).alias(f"c{i}") for i, x in enumerate(xs)] + [F.sum(F.when(is_case, x).otherwise(0.0)).alias(f"d{i}") for i, x in enumerate(xs)]
        t = self.rows.groupBy("k", "time").agg(F.first("g_left").alias("g"), *sums).toPandas().sort_values("time", kind="stable")
        times, at = np.unique(t["time"].to_numpy(), return_inverse=True)
        q = self.p + 1
        take = lambda name: np.stack([np.bincount(at, weights=t[f"{name}{i}"], minlength=len(times)) for i in range(q)], axis=1)
        s = take("r")[::-1].cumsum(axis=0)[::-1].copy()
        cases = take("d")
        strata = np.unique(t["k"].to_numpy())
        g = np.ones((len(strata), len(times)))
        for j, k in enumerate(strata):
            mine = (t["k"] == k).to_numpy()
            own = t["time"].to_numpy()[mine]
            # left limit at every time: the value before the stratum's own next time
            nxt = np.searchsorted(own, times, side="left")
            left = np.append(t["g"].to_numpy()[mine], np.nan)
            g[j] = left[np.minimum(nxt, len(own))]
            if np.isnan(g[j]).any():
                g[j] = np.where(np.isnan(g[j]), 0.0 if len(own) else 1.0, g[j])
            if self.subdistribution:
                c = np.stack([np.bincount(at[mine], weights=t[f"c{i}"].to_numpy()[mine], minlength=len(times)) for i in range(q)], axis=1)
                s += g[j][:, None] * (c.cumsum(axis=0) - c)
        live = cases[:, 0] > 0
        d = np.where(live, cases[:, 0], 0.0)
        s0 = np.where(live, s[:, 0], 1.0)
        mean = np.where(live[:, None], s[:, 1:] / s0[:, None], 0.0)
        ll = float(cases[:, 1:].sum(axis=0) @ beta - shift * d.sum() - np.sum(d[live] * np.log(s0[live])))
        return times, strata, g, d, s0, mean, cases[:, 1:].sum(axis=0), ll, shift

    def _accumulated(self, tables, value: np.ndarray, power: int = 1):
        """(time, k, inclusive sum, reweighted later sum) of ``value`` over event times."""
        times, strata, g = tables[:3]
        before = np.cumsum(value)
        later = [np.cumsum((g[j] ** power * value)[::-1])[::-1] - g[j] ** power * value for j in range(len(strata))]
        return before, later

    def _joined(self, tables, columns: dict[str, tuple]):
        """Rows with per-(k, time) columns: a join with one row for each distinct time and stratum."""
        import pandas as pd

        times, strata = tables[:2]
        frames = [pd.DataFrame({"k": k, "time": times, **{f"{n}_b": b for n, (b, _) in columns.items()}, **{f"{n}_l": late[j] for n, (_, late) in columns.items()}}) for j, k in enumerate(strata)]
        small = self.rows.sparkSession.createDataFrame(pd.concat(frames)).withColumn("k", F.col("k").cast(self.rows.schema["k"].dataType))
        return self.rows.join(self.hint(small), ["k", "time"])

    def _moments(self, rows: DataFrame, weight, linear):
        """(sum of x * linear, sum of x x' * weight)."""
        p = self.p
        sums = [F.sum(F.col(f"x{i}") * linear) for i in range(p)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}") * weight) for i in range(p) for j in range(i, p)]
        row = list(rows.agg(*sums).first())
        a = np.zeros((p, p))
        a[np.triu_indices(p)] = row[p:]
        return np.array(row[:p]), a + np.triu(a, 1).T

    def newton(self, beta: np.ndarray):
        tables = self._tables(beta)
        _, _, _, d, s0, mean, cases, ll, shift = tables
        rows = self._joined(tables, {"a": self._accumulated(tables, d / s0)})
        r = F.exp(self._eta(beta) - shift)
        a = F.col("a_b") + F.col("inv_g") * F.col("a_l")
        _, gram = self._moments(rows, r * a, F.lit(0.0))
        return -ll, cases - d @ mean, gram - (mean * d[:, None]).T @ mean

    def gram(self, beta: np.ndarray):
        """(z'st, z'Wz, log likelihood) of the quadratic model, for the penalised solver."""
        tables = self._tables(beta)
        _, _, _, d, s0, _, _, ll, shift = tables
        rows = self._joined(tables, {"a": self._accumulated(tables, d / s0), "b": self._accumulated(tables, d / s0**2, 2)})
        r = F.exp(self._eta(beta) - shift)
        a = F.col("a_b") + F.col("inv_g") * F.col("a_l")
        a2 = F.col("b_b") + F.col("inv_g") * F.col("inv_g") * F.col("b_l")
        st = F.when(F.col("event") == 1, 1.0).otherwise(0.0) - r * a
        q, m = self._moments(rows, F.greatest(r * a - r * r * a2, F.lit(0.0)), st)
        return q, m, ll

    def meat(self, beta: np.ndarray):
        tables = self._tables(beta)
        _, _, _, d, s0, mean, _, _, shift = tables
        rate = d / s0
        rows = self._joined(tables, {"a": self._accumulated(tables, rate)} | {f"m{i}": self._accumulated(tables, rate * mean[:, i]) for i in range(self.p)} | {f"e{i}": (mean[:, i], [mean[:, i]] * len(tables[1])) for i in range(self.p)})
        r = F.exp(self._eta(beta) - shift)
        a = F.col("a_b") + F.col("inv_g") * F.col("a_l")
        u = [F.when(F.col("event") == 1, F.col(f"x{i}") - F.col(f"e{i}_b")).otherwise(0.0) - r * (F.col(f"x{i}") * a - F.col(f"m{i}_b") - F.col("inv_g") * F.col(f"m{i}_l")) for i in range(self.p)]
        rows = rows.select(*[x.alias(f"u{i}") for i, x in enumerate(u)])
        row = list(rows.agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i in range(self.p) for j in range(i, self.p)]).first())
        m = np.zeros((self.p, self.p))
        m[np.triu_indices(self.p)] = row
        return m + np.triu(m, 1).T

    def baseline(self, beta: np.ndarray):
        times, _, _, d, s0, _, _, _, shift = self._tables(beta)
        return times[d > 0], np.cumsum(d[d > 0] / (s0[d > 0] * np.exp(shift)))

    def losses(self, held: DataFrame, betas: Sequence[np.ndarray]) -> list[float]:
        """Deviance of the cases in ``held`` (x0 .., time) at each coefficient vector, against the risk sets of all rows."""
        sums = held.groupBy("time").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(self.p)]).toPandas()
        x, out = sums[[f"x{i}" for i in range(self.p)]].sum().to_numpy(float), []
        for beta in betas:
            times, _, _, _, s0, _, _, _, shift = self._tables(beta)
            out.append(-2 * float(x @ beta - sums["n"].to_numpy() @ (np.log(s0[np.searchsorted(times, sums["time"].to_numpy())]) + shift)))
        return out


class FarRisk(SparkRisk):
    """The same with per-time tables that stay distributed: scanned by blocks of time and joined with the rows."""

    @classmethod
    def of(cls, near: SparkRisk) -> FarRisk:
        out = cls.__new__(cls)
        out.__dict__ |= near.__dict__
        out.strata = sorted((r[0] for r in near.rows.select("k").distinct().collect()), key=str)
        # every table by time has the same times, so their ranges are found once
        out.bounds = splitters(near.rows, "time", near.rows.count())
        return out

    def _by_time(self, beta: np.ndarray) -> tuple[float, DataFrame]:
        """(shift, one row for each distinct time: d, dx.., s0, the means m.. and the censoring curves g..)."""
        shift = float(np.abs(beta) @ self.largest)
        r, ks = F.exp(self._eta(beta) - shift), range(len(self.strata))
        xs = [F.lit(1.0), *[F.col(f"x{i}") for i in range(self.p)]]
        mine = [F.col("k").eqNullSafe(F.lit(k)) for k in self.strata]
        sums = [F.sum(r * x).alias(f"r{i}") for i, x in enumerate(xs)] + [F.sum(F.when(F.col("event") == 1, x).otherwise(0.0)).alias(f"d{i}") for i, x in enumerate(xs)]
        sums += [F.sum(F.when(mine[j], r * x * F.col("inv_g")).otherwise(0.0)).alias(f"c{j}_{i}") for j in ks for i, x in enumerate(xs)]
        t = with_blocks(self.rows.groupBy("time").agg(*sums, *[F.max(F.when(mine[j], F.col("g_left"))).alias(f"own{j}") for j in ks]), "time", True, self.bounds)
        scans = {f"r{i}": ("sum", F.col(f"r{i}"), "onward") for i in range(len(xs))} | {f"c{j}_{i}": ("sum", F.col(f"c{j}_{i}"), "before") for j in ks for i in range(len(xs))}
        # the left limit of a stratum's curve is that before its own next time
        t = t.withColumnsRenamed({n: f"__{n}" for n in scans})
        t._stored = True
        t = running(t, [], "time", {n: (op, F.col(f"__{n}"), span) for n, (op, _, span) in scans.items()} | {f"g{j}": ("next", F.col(f"own{j}"), "onward") for j in ks})
        t = t.withColumns({f"g{j}": F.coalesce(f"g{j}", F.lit(0.0)) for j in ks})
        s = [F.col(f"r{i}") + (sum((F.col(f"g{j}") * F.col(f"c{j}_{i}") for j in ks), F.lit(0.0)) if self.subdistribution else 0.0) for i in range(len(xs))]
        live = F.col("d0") > 0
        t = t.withColumns({f"s{i}": F.when(live, x).otherwise(1.0 if i == 0 else 0.0) for i, x in enumerate(s)})
        kept = [F.col("d0").alias("d"), "s0", *[F.col(f"d{i + 1}").alias(f"dx{i}") for i in range(self.p)], *[(F.col(f"s{i + 1}") / F.col("s0")).alias(f"m{i}") for i in range(self.p)], *[f"g{j}" for j in ks]]
        return shift, stored(t.select("time", t["__block"], *kept))

    def _facts(self, t: DataFrame, beta: np.ndarray, shift: float):
        """(log likelihood, sum of the cases' x, of the means, and of their products)."""
        p, d = self.p, F.col("d")
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        row = list(t.agg(F.sum("d"), F.sum(d * F.log("s0")), *[F.sum(f"dx{i}") for i in range(p)], *[F.sum(d * F.col(f"m{i}")) for i in range(p)], *[F.sum(d * F.col(f"m{i}") * F.col(f"m{j}")) for i, j in pairs]).first())
        cases, means, upper = np.array(row[2 : 2 + p]), np.array(row[2 + p : 2 + 2 * p]), np.zeros((p, p))
        upper[np.triu_indices(p)] = row[2 + 2 * p :]
        return float(cases @ beta - shift * row[0] - row[1]), cases, means, upper + np.triu(upper, 1).T

    def _with(self, t: DataFrame, columns: dict[str, tuple]) -> DataFrame:
        """Rows with name_b, the sum of a value up to their time, and name_l, that of later ones weighted by their stratum's curve to a power."""
        ks = range(len(self.strata))
        scans = {f"{n}_b": ("sum", x, "upto") for n, (x, _) in columns.items()} | {f"{n}_l{j}": ("sum", F.pow(F.col(f"g{j}"), F.lit(float(power))) * x, "after") for n, (x, power) in columns.items() for j in ks}
        small = running(t, [], "time", scans).select("time", *scans, *[f"m{i}" for i in range(self.p)])
        pick = lambda n: F.coalesce(*[F.when(F.col("k").eqNullSafe(F.lit(k)), F.col(f"{n}_l{j}")) for j, k in enumerate(self.strata)])
        return self.rows.join(small, "time").withColumns({f"{n}_l": pick(n) for n in columns})

    def newton(self, beta: np.ndarray):
        since = mark()
        shift, t = self._by_time(beta)
        ll, cases, means, products = self._facts(t, beta, shift)
        rows = self._with(t, {"a": (F.col("d") / F.col("s0"), 1)})
        _, gram = self._moments(rows, F.exp(self._eta(beta) - shift) * (F.col("a_b") + F.col("inv_g") * F.col("a_l")), F.lit(0.0))
        release(self.rows.sparkSession, since)
        return -ll, cases - means, gram - products

    def gram(self, beta: np.ndarray):
        since = mark()
        shift, t = self._by_time(beta)
        ll = self._facts(t, beta, shift)[0]
        rows = self._with(t, {"a": (F.col("d") / F.col("s0"), 1), "b": (F.col("d") / (F.col("s0") * F.col("s0")), 2)})
        r, inv = F.exp(self._eta(beta) - shift), F.col("inv_g")
        a, a2 = F.col("a_b") + inv * F.col("a_l"), F.col("b_b") + inv * inv * F.col("b_l")
        q, m = self._moments(rows, F.greatest(r * a - r * r * a2, F.lit(0.0)), F.when(F.col("event") == 1, 1.0).otherwise(0.0) - r * a)
        release(self.rows.sparkSession, since)
        return q, m, ll

    def meat(self, beta: np.ndarray):
        since = mark()
        shift, t = self._by_time(beta)
        rate, p = F.col("d") / F.col("s0"), self.p
        rows = self._with(t, {"a": (rate, 1)} | {f"w{i}": (rate * F.col(f"m{i}"), 1) for i in range(p)})
        r, inv = F.exp(self._eta(beta) - shift), F.col("inv_g")
        a = F.col("a_b") + inv * F.col("a_l")
        u = [F.when(F.col("event") == 1, F.col(f"x{i}") - F.col(f"m{i}")).otherwise(0.0) - r * (F.col(f"x{i}") * a - F.col(f"w{i}_b") - inv * F.col(f"w{i}_l")) for i in range(p)]
        row = list(rows.select(*[x.alias(f"u{i}") for i, x in enumerate(u)]).agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")) for i in range(p) for j in range(i, p)]).first())
        release(self.rows.sparkSession, since)
        m = np.zeros((p, p))
        m[np.triu_indices(p)] = row
        return m + np.triu(m, 1).T

    def baseline(self, beta: np.ndarray) -> DataFrame:
        """(time, cum_hazard), a frame: one row for each distinct event time."""
        shift, t = self._by_time(beta)
        steps = t.where("d > 0").withColumn("step", F.col("d") / (F.col("s0") * float(np.exp(shift))))
        return running(steps, [], "time", {"cum_hazard": ("sum", F.col("step"), "upto")}).select("time", "cum_hazard")

    def losses(self, held: DataFrame, betas: Sequence[np.ndarray]) -> list[float]:
        out = []
        for beta in betas:
            since = mark()
            shift, t = self._by_time(beta)
            eta = sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
            out.append(-2 * float(held.join(t.select("time", "s0"), "time").agg(F.sum(eta - F.log("s0") - shift)).first()[0] or 0.0))
            release(self.rows.sparkSession, since)
        return out


def distributed_risk(*args, **kwargs) -> SparkRisk:
    """The form that the number of distinct times asks for."""
    near = SparkRisk(*args, **kwargs)
    return near if near.times <= MOST_TIMES else FarRisk.of(near)
