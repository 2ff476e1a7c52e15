"""Exact dedup by content sort (DataFrame functions only).

Sampled splitters range-partition the normalised bytes, Spark's external sort puts equal
texts side by side, and each row is compared in full with its neighbour. Ties are broken by
document id inside the sort key, so one very large group of copies spans several ranges and
its pieces are joined again through the first and last run of each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, numbered, range_index, sampled_splitters, shuffle_width

KEY = ("head", "sha", "d")
KEY_TYPES = ("string", "string", "bigint")
#: characters of normalised text that lead the sort key (the digest follows)
HEAD = 24


def _normal(col) -> F.Column:
    return F.translate(F.coalesce(col, F.lit("")), " \t\n\x0b\x0c\r", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges_per_task: int = 3) -> DataFrame:
    """One row for each row of ``docs``: rid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; a null text counts as empty.
    Of equal texts the row with the most code points, then the smallest id, then the first row stays
    (a null id counts as the largest id), so of repeated rows exactly one is kept. An empty table gives
    no rows; columns other than id and text are not read. ``rid`` numbers the rows of a file-backed
    frame (:func:`common.numbered`).
    """
    spark = docs.sparkSession
    base = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).withColumn(
        "d", F.coalesce("doc_id", F.lit((1 << 63) - 1))
    )
    keyed = base.withColumn("norm", _normal(F.col("text"))).select(
        "rid", "doc_id", "d", "norm",
        F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("points"),
        F.substring("norm", 1, HEAD).alias("head"),
        F.sha2("norm", 256).alias("sha"),
    )
    # the draw looks at raw texts, so only drawn rows are normalised and digested
    norm = _normal(F.col("text"))
    sized = base.select(
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"), "d", "text",
        F.substring(norm, 1, HEAD).alias("head"), F.sha2(norm, 256).alias("sha"),
    )
    pieces = max(8, ranges_per_task * shuffle_width(spark))
    splitters = sampled_splitters(sized, KEY, "size", pieces, draw=("d", "text"))
    ranged = keyed.withColumn("r", range_index(spark, splitters, KEY, KEY_TYPES))
    order = Window.partitionBy("r").orderBy("head", "sha", "d", "rid")
    runs = (
        ranged.withColumn("new", F.when(F.col("norm") == F.lag("norm").over(order), 0).otherwise(1))
        .withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("norm", "head", "new")
    )
    in_run = Window.partitionBy("r", "run")
    best = F.struct((-F.col("points")).alias("p"), F.col("d"), F.col("rid"), F.col("doc_id"))
    local = cut(
        runs.withColumn("size", F.count("*").over(in_run))
        .withColumn("best", F.min(best).over(in_run))
        .select("rid", "doc_id", "sha", "r", "run", "size", "best")
    )
    # a group over several ranges is the last run of one and the first of the next: two rows a range at most
    ends = local.groupBy("r").agg(F.min("run").alias("lo"), F.max("run").alias("hi"))
    edges = (
        local.join(F.broadcast(ends), "r")
        .where((F.col("run") == F.col("lo")) | (F.col("run") == F.col("hi")))
        .groupBy("r", "run", "sha", "size", "best").agg(F.lit(1).alias("one"))
    )
    spanning = edges.groupBy("sha").agg(F.count("*").alias("pieces"), F.sum("size").alias("all_size"), F.min("best").alias("all_best")).where("pieces > 1")
    return (
        local.join(F.broadcast(spanning.drop("pieces")), "sha", "left")
        .withColumn("best", F.coalesce("all_best", "best"))
        .select(
            "rid",
            "doc_id",
            F.col("best.doc_id").alias("keep_id"),
            F.coalesce("all_size", "size").cast("long").alias("group_size"),
            (F.col("best.rid") == F.col("rid")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that :func:`exact_groups` keeps."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("rid").alias("__rid"))
    return numbered(docs, "__rid").join(kept, "__rid", "left_semi").drop("__rid")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rid")


OP2_SQL = """
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM g
"""
