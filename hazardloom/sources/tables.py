"""Readers, writers and the survival views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORIGIN = "1995-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_survival(spark: SparkSession, path: str, fmt: str = "parquet", time_col: str = "time", event_col: str = "event", **options) -> DataFrame:
    """Any file source as a frame with time DOUBLE and event INT."""
    df = spark.read.format(fmt).options(**({"header": "true", "inferSchema": "true"} if fmt == "csv" else {}), **options).load(path)
    return df.withColumnsRenamed({time_col: "time", event_col: "event"}).withColumns({"time": F.col("time").cast("double"), "event": F.col("event").cast("int")})


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    """Write a result (Parquet, CSV, JSON, ORC), by partition columns where given."""
    writer = df.write.format(fmt).mode(mode)
    (writer.option("header", "true") if fmt == "csv" else writer).partitionBy(*partition_by).save(path)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SV1: days to shipment with cause by return flag, group by line status; columns pruned to the scan."""
    return table(spark, sf_dir, "lineitem").select(
        F.datediff("l_shipdate", F.lit(ORIGIN)).cast("double").alias("time"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0).alias("event"),
        F.col("l_linestatus").alias("grp"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey",
    )


def shipments_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SV1 with the customer's market segment as the group (five groups)."""
    lines = shipments(spark, sf_dir).select("time", "event", "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("grp"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).select("time", "event", "grp")


def signup_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SV2: seconds from each signup to the user's next purchase (1) or error (2), else censored at the last event."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    later = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)  # from the far end: one step a row
    after = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("ts"))).over(later)
    end = events.agg(F.max("ts").alias("end"))
    seen = events.withColumn("buy", after("purchase")).withColumn("err", after("error")).where("event_type = 'signup'")
    first = F.least("buy", "err")
    return seen.join(F.broadcast(end)).select(
        "event_id", "user_id",
        (F.coalesce(first, "end") - F.col("ts")).cast("interval second").cast("decimal(20,6)").cast("double").alias("time"),
        F.when(first.isNull(), 0).when(F.col("buy") == first, 1).otherwise(2).alias("event"),
        "value",
    )
