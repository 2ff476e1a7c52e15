"""Sharding by sampled splitters (DataFrame functions only).

Size-weighted key samples give quantile boundaries; records are range-partitioned by
(text hash, document id); ranges that turn out overfull get boundaries of their own.
Exact byte offsets within and before each range then place every record, so shards are
equal in bytes up to one record however well the sample drew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, range_index, sampled_splitters, shuffle_width

KEY = ("h", "d")
KEY_TYPES = ("bigint", "bigint")


def _subdivided(spark, rows: DataFrame, splitters: list[tuple], pieces: int, rounds: int) -> list[tuple]:
    """Add splitters inside each range of over twice its fair share of bytes."""
    for _ in range(rounds):
        filled = rows.withColumn("r", range_index(spark, splitters, KEY, KEY_TYPES))
        totals = {x["r"]: x["b"] for x in filled.groupBy("r").agg(F.sum("size").alias("b")).collect()}
        fair = sum(totals.values()) / pieces if totals else 0
        over = [r for r, b in totals.items() if b > 2 * fair]
        if not over:
            break
        inside = filled.where(F.col("r").isin(over))
        more = sampled_splitters(inside, KEY, "size", max(2, round(sum(totals[r] for r in over) / fair)), 32)
        grown = sorted({*splitters, *more})
        if len(grown) == len(splitters):  # one key alone fills what is left
            break
        splitters = grown
    return splitters


def shard_documents(
    docs: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_task: int = 4,
    rounds: int = 3,
) -> DataFrame:
    """Place every row of ``docs`` into shards of near equal bytes (law ``bytes``).

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless from 0 in each
    shard), grown_shard (null under this law), byte_offset (the row's place in the whole order).
    Equal texts are neighbours in key order, so a group of copies meets few shards; a group larger
    than a shard is split by document id. A null text counts as empty (size 1, CRC 0); a null id is
    placed as the smallest id; repeated rows each get a slot; an empty table gives no rows; columns
    other than id and text are not read.

    The driver gets the key sample (``16 * ranges`` rows) and one row for each (range, shard).
    """
    spark = docs.sparkSession
    pieces = max(4 * n_shards, ranges_per_task * shuffle_width(spark))
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
        ).withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63))))
    )
    splitters = _subdivided(spark, rows, sampled_splitters(rows, KEY, "size", pieces), pieces, rounds)
    ranged = rows.withColumn("r", range_index(spark, splitters, KEY, KEY_TYPES))
    totals = {x["r"]: x["b"] for x in ranged.groupBy("r").agg(F.sum("size").alias("b")).collect()}
    total, before, at = sum(totals.values()), {}, 0
    for r in sorted(totals):
        before[r], at = at, at + totals[r]
    starts = _small(spark, [(r, b) for r, b in before.items()], "r int, before long")
    order = Window.partitionBy("r").orderBy("h", "d", "size", "text_crc32")
    placed = (
        ranged.join(F.broadcast(starts), "r")
        .withColumn("offset", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("n", F.row_number().over(order))
        # shard s starts at byte ceil(s * total / n_shards)
        .withColumn("shard", F.least(F.expr(f"cast(offset * cast({n_shards} as decimal(20,0)) / {max(total, 1)} as int)"), F.lit(n_shards - 1)))
    )
    counts = sorted((x["shard"], x["r"], x["first"], x["n"]) for x in placed.groupBy("r", "shard").agg(F.count("*").alias("n"), F.min("n").alias("first")).collect())
    shifts, seen = [], {}
    for s, r, first, n in counts:
        shifts.append((r, s, seen.get(s, 0) - first))
        seen[s] = seen.get(s, 0) + n
    shift = _small(spark, shifts, "r int, shard int, shift long")
    return placed.join(F.broadcast(shift), ["r", "shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("n") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("offset").alias("byte_offset"),
    )


def _small(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A table of one row for each range (and shard): bounded by the number of ranges."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
