"""Corpus pipeline over ``documents``: language ID, exact dedup, near-duplicate join, substring dedup, packing.

Every stage works on all rows its predecessor kept and passes the columns of ``documents`` on; the last one
returns the pieces to train on, with their ids. Stages are (name, function of (spark, docs, sf_dir)).

Every stage takes nulls in any column, empty and very long texts, repeated rows and an empty table (which stays empty);
columns beside doc_id, text, lang and n_chars are carried along whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardloom.llm.common import settle, written
from hazardloom.llm.exact_dedup import exact_dedup
from hazardloom.llm.language_id import UNKNOWN, fit_filters, learnable, predict_language
from hazardloom.llm.ngram_jaccard import near_dedup
from hazardloom.llm.packing import pack_documents, tokenizer_path
from hazardloom.llm.substring_dedup import substring_dedup

#: a text whose best language covers less of its n-grams than this is rejected
LEAST_COVER = 0.2


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Null, empty and letterless texts go, as do those whose best language covers under ``LEAST_COVER`` of their n-grams; where no
    row has a language to learn from, all go. Ties between languages go to the first by name; repeated rows share one fate.
    """
    filters = fit_filters(docs.where(learnable()), "text", "lang")
    found = predict_language(docs, filters)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_COVER)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside).

    The one with the most code points stays, then the smallest id (a null id last), then the first of repeated rows; null counts as empty.
    """
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8).

    The smallest id stays (a null id last), then the first of repeated rows; texts without words link with nothing and stay.
    """
    return near_dedup(docs, width=5, percent=80)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages (35 words or more that start anywhere else too).

    A text that loses nothing stays as it is, null and white space included; of any other the words that stay are joined by
    one blank, and n_chars, if there, follows; one that has no word left goes. Passages of repeated rows repeat.
    """
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*rest).alias("rest"))  # one column, so names cannot clash
    found = substring_dedup(rows, carry=("rest",), keep_untouched=True).where("n_words = 0 or n_removed < n_words")
    new = {"text": F.col("kept_text")}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest.n_chars"))
    return found.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of what is left: doc_id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset, bucket.

    A null or empty text is one piece of the end id; repeated rows give pieces of their own; a null id stays null.
    """
    return pack_documents(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard", near_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can't run the tokenizer or the language filters; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written and read again for the next."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settle(docs, since)
    return docs
