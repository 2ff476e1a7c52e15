"""Scalar kernels as Column functions, and the few numeric ones needed on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def recode(event: Column, cause: int) -> Column:
    """0 censored, 1 the cause, 2 any other cause."""
    return F.when(event == 0, 0).when(event == cause, 1).otherwise(2)


def cause_indicator(event: Column, cause: int) -> Column:
    return F.when(event == cause, 1).otherwise(0)


def censor_recode(event: Column, cencode: int) -> Column:
    """Censoring under another code: code 0 then stands for a competing event (-999)."""
    if cencode == 0:
        return event
    return F.when(event == cencode, 0).when(event == 0, -999).otherwise(event)


def hazard(d: Column, y: Column) -> Column:
    return F.when(y > 0, d / y).otherwise(0.0)


def soft_threshold(z: Column, t: Column) -> Column:
    return F.signum(z) * F.greatest(F.abs(z) - t, F.lit(0.0))


def prox_lasso(z: Column, v: Column, l1: Column, l2: Column) -> Column:
    return soft_threshold(z, l1) / (v + l2)


def prox_mcp(z: Column, v: Column, l1: Column, l2: Column, gamma: float) -> Column:
    """Firm threshold: relaxed below ``gamma * l1 * (v + l2)``, plain beyond."""
    w = v + l2
    return F.when(F.abs(z) <= gamma * l1 * w, soft_threshold(z, l1) / (w - 1.0 / gamma)).otherwise(z / w)


def prox_scad(z: Column, v: Column, l1: Column, l2: Column, gamma: float) -> Column:
    w = v + l2
    near, mid = soft_threshold(z, l1) / w, soft_threshold(z, gamma * l1 / (gamma - 1)) / (w - 1.0 / (gamma - 1))
    return F.when(F.abs(z) <= l1 * (w + 1.0), near).when(F.abs(z) <= gamma * l1 * w, mid).otherwise(z / w)


def wilson(p: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson score interval, clipped to [0, 1]; NaN without trials."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    centre, width = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    side = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(math.nan)
    return side(centre - width), side(centre + width)


def linear_predictor(features: list[str], coef) -> Column:
    return sum((F.col(c) * float(b) for c, b in zip(features, coef)), F.lit(0.0))


def md5_uniform(*parts) -> Column:
    """A number in (0, 1) from the MD5 of the parts joined by "|": 52 bits, the same wherever it is computed."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square: the regularised upper incomplete gamma function Q(df / 2, x / 2)."""
    if not x > 0 or df < 1:
        return 1.0
    a, z = df / 2, x / 2
    if z < a + 1:  # series for P
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1.0 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b, c = z + 1 - a, 1e300  # continued fraction for Q
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b or 1e-300)
        c = b + n / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))
