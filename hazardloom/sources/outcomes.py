"""Survival outcomes: the structured column, input checks, generators and splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import md5_uniform
from ..operators.scans import running, with_blocks


def surv(event: str | Column, time: str | Column, name_event: str = "event", name_time: str = "time") -> Column:
    """The structured outcome STRUCT<event INT, time DOUBLE>."""
    event, time = (F.col(x) if isinstance(x, str) else x for x in (event, time))
    return F.struct(event.cast("int").alias(name_event), time.cast("double").alias(name_time))


def is_surv(df: DataFrame, col: str) -> bool:
    """Whether a column is a two-field outcome: one integer or boolean field, one floating field (in either order)."""
    kind = df.schema[col].dataType
    if not isinstance(kind, T.StructType) or len(kind) != 2:
        return False
    kinds = [f.dataType for f in kind]
    whole = [isinstance(k, (T.IntegralType, T.BooleanType)) for k in kinds]
    real = [isinstance(k, T.FractionalType) for k in kinds]
    return sum(whole) == 1 and sum(real) == 1


def unpack_surv(df: DataFrame, col: str = "y") -> DataFrame:
    """``df`` with time and event taken out of the structured outcome."""
    if not is_surv(df, col):
        raise TypeError(f"{col} is not a structured survival outcome")
    event, time = sorted(df.schema[col].dataType.fields, key=lambda f: isinstance(f.dataType, T.FractionalType))
    return df.withColumns({"event": F.col(f"{col}.{event.name}").cast("int"), "time": F.col(f"{col}.{time.name}").cast("double")})


def check_inputs(df: DataFrame, features: list[str], time: str = "time", event: str = "event") -> int:
    """Validate in one aggregation; the number of causes, or ValueError."""
    bad = lambda c: F.sum(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == math.inf), 1).otherwise(0))
    row = df.agg(
        F.count("*").alias("n"),
        *[bad(c).alias(f"bad_{i}") for i, c in enumerate([*features, time, event])],
        F.min(time).alias("least"),
        F.sum(F.when(F.col(event) != F.floor(event), 1).otherwise(0)).alias("split"),
        F.min(event).alias("low"),
        F.max(event).alias("high"),
        F.count_distinct(F.when(F.col(event) > 0, F.col(event))).alias("causes"),
    ).first()
    if not row["n"]:
        raise ValueError("the input has no rows")
    for i, c in enumerate([*features, time, event]):
        if row[f"bad_{i}"]:
            raise ValueError(f"{c} holds null, NaN or infinite values")
    if row["least"] < 0:
        raise ValueError("time must not be negative")
    if row["split"] or row["low"] < 0:
        raise ValueError("event must hold whole codes from 0")
    if not row["causes"]:
        raise ValueError("no events: every row is censored")
    if row["causes"] != row["high"]:
        raise ValueError("cause codes must run from 1 without gaps")
    return int(row["high"])


def synthetic_outcomes(spark: SparkSession, n: int, p: int = 10, seed: int = 20260417, partitions: int | None = None) -> DataFrame:
    """Two-cause Weibull outcomes with normal features x0 .. x{p-1}: made in place, a row at a time, from hashes of the row's number."""
    # fixed values: shapes 1.2 and 0.9, intercepts -3 and -3.5, censoring rate 0.06
    one = [0.5, -0.4, 0.3, 0.2, -0.2]
    two = [-0.3, 0.4, 0.2, -0.2, 0.3]
    u = lambda name: md5_uniform(seed, name, F.col("id"))
    normal = lambda i: F.sqrt(-2 * F.log(u(f"r{i}"))) * F.cos(2 * math.pi * u(f"a{i}"))
    rows = spark.range(0, n, 1, partitions).select("id", *[normal(i).alias(f"x{i}") for i in range(p)], u("1").alias("u1"), u("2").alias("u2"), u("3").alias("u3"))
    dot = lambda w: sum((F.col(f"x{i}") * b for i, b in enumerate(w[:p])), F.lit(0.0))
    wait = lambda u, shape, eta: F.pow(-F.log(F.lit(1.0) - F.col(u)) / F.exp(eta), 1 / shape)
    rows = rows.withColumns({"t1": wait("u1", 1.2, dot(one) - 3.0), "t2": wait("u2", 0.9, dot(two) - 3.5), "tc": -F.log(F.lit(1.0) - F.col("u3")) / 0.06})
    first = F.least("t1", "t2", "tc")
    return rows.select("id", *[f"x{i}" for i in range(p)], first.alias("time"), F.when(F.col("tc") == first, 0).when(F.col("t1") == first, 1).otherwise(2).alias("event"))


def stratified_split(df: DataFrame, key: str, event: str = "event", seed: int = 0, test_frac: float = 0.2) -> DataFrame:
    """``df`` with is_test: in each event stratum exactly ``greatest(1, round(n * frac))`` rows by a hash of ``key``, ranked by blocks of the hash."""
    ranked = running(with_blocks(df.withColumn("__h", F.xxhash64(F.lit(seed), key)), "__h"), [event], ["__h", key], {"__r": ("sum", F.lit(1.0), "upto")})
    sizes = df.groupBy(F.col(event).alias("__e")).agg(F.count("*").alias("__n"))
    take = F.greatest(F.lit(1), F.round(F.col("__n") * test_frac).cast("long"))
    return ranked.join(sizes, F.col(event).eqNullSafe(F.col("__e"))).select(*df.columns, ((F.col("__r") <= take) & (F.col("__n") >= 2)).alias("is_test"))


class Surv:
    """Structured outcomes, from columns of a frame or from local sequences."""

    @staticmethod
    def from_columns(event: str | Column, time: str | Column, *, name_event: str = "event", name_time: str = "time") -> Column:
        return surv(event, time, name_event, name_time)

    @staticmethod
    def from_arrays(spark: SparkSession, event, time, *, name_event: str = "event", name_time: str = "time") -> DataFrame:
        """One column y of equally long, one-dimensional event codes (whole or boolean) and times."""
        event, time = list(event), list(time)
        if len(event) != len(time):
            raise ValueError("event and time differ in length")
        if any(isinstance(e, float) and e != int(e) for e in event):
            raise ValueError("event must hold whole codes or booleans")
        rows = spark.createDataFrame([(int(e), float(t)) for e, t in zip(event, time)], "e int, t double")
        return rows.select(surv("e", "t", name_event, name_time).alias("y"))
