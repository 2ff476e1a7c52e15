"""Substring dedup: Rabin-Karp hashes of every word window, counted in Spark.

Map tasks hash all windows of whole texts; the counts meet by hash range (see :mod:`blobs`); which
windows are repeated goes back to the documents, where overlapping windows merge into maximal
removal intervals. A window is known by 96 bits of two rolling hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import batched, bucket_count, bucket_edges, from_planes, one_array, pack_sorted, planes, small_batches, unpack_sorted, whole_batches
from .common import numbered
from .text_arrays import mix, spaces, text_bytes, window_hashes, window_rows, word_hashes, word_spans

SENT = "bucket int, batch long, keys binary, checks binary, many binary"
_SECOND = np.uint64(0xE7037ED1A0B428DB)


def _sorted_windows(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and check, where a new window begins in that order)."""
    order = np.argsort(key)
    k, c = key[order], check[order]
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():  # two windows of one key: rare enough to sort anew
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    first = np.ones(len(key), bool)
    first[1:] = ~same
    return order, first


class _Windows:
    """The distinct windows of a batch's texts, sorted, and the places of each."""

    def __init__(self, texts: pa.Array, width: int):
        self.flat, offsets = text_bytes(texts)
        self.starts, self.ends, self.bounds = word_spans(~spaces(self.flat), offsets)
        words = word_hashes(self.flat, self.starts, self.ends)
        self.at = np.flatnonzero(window_rows(self.bounds, width, len(words)))
        key = window_hashes(words, width)[self.at]
        check = (window_hashes(mix(words ^ _SECOND), width)[self.at] >> np.uint64(32)).astype(np.uint32)
        self.order, first = _sorted_windows(key, check)
        begin = np.flatnonzero(first)
        self.key, self.check = key[self.order][begin], check[self.order][begin]
        self.count = np.diff(np.append(begin, len(key)))

    def places(self, repeated: np.ndarray) -> np.ndarray:
        """First words of all windows that are ``repeated`` (one entry for each distinct window)."""
        return self.at[self.order[np.repeat(repeated, self.count)]]


def _hash_windows(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in whole_batches(batches, 0, 1):
            w = _Windows(one_array(table, "text"), width)
            edges, rows = bucket_edges(w.key, buckets), [[], [], [], [], []]
            for b in np.flatnonzero(np.diff(edges)):
                x = slice(edges[b], edges[b + 1])
                for column, value in zip(rows, (int(b), number, pack_sorted(w.key[x]), planes(w.check[x]), np.packbits(w.count[x] > 1).tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), *[pa.binary()] * 3))], names=["bucket", "batch", "keys", "checks", "many"])

    return run


def _count_windows(table: pa.Table) -> pa.Table:
    """Answer to each batch: which of its windows another batch has too (batches know their own repeats)."""
    batches, keys, checks, many = (table.column(c).to_pylist() for c in ("batch", "keys", "checks", "many"))
    parts = [unpack_sorted(k) for k in keys]
    sizes = np.array([len(p) for p in parts])
    key = np.concatenate(parts)
    check = np.concatenate([from_planes(c, np.uint32) for c in checks])
    del parts, keys, checks
    order, first = _sorted_windows(key, check)
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(key)))
    again = np.empty(len(key), bool)
    again[order] = np.repeat(count > 1, count)
    ends, bucket = np.cumsum(sizes), table.column("bucket")[0].as_py()
    out = [(batch, np.packbits(again[z - n : z]).tobytes()) for batch, n, z in zip(batches, sizes, ends) if again[z - n : z].any()]
    return pa.table([pa.array([b for b, _ in out], pa.int64()), pa.array([bucket] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["batch", "bucket", "again"])


def _cut_out(width: int, buckets: int, untouched: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks().sort_by("rid") if left.num_rows > 1 else left
        texts = one_array(left, "text")
        w = _Windows(texts, width)
        repeated, edges = w.count > 1, bucket_edges(w.key, buckets)
        for b, bits in zip(right.column("bucket").to_pylist(), right.column("again").to_pylist()):
            n = edges[b + 1] - edges[b]
            repeated[edges[b] : edges[b + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n)).astype(bool)
        flat, starts, ends, bounds = w.flat, w.starts, w.ends, w.bounds
        n = len(starts)
        at, step = w.places(repeated), np.zeros(n + 1, np.int64)
        del w
        np.add.at(step, at, 1)
        np.add.at(step, at + width, -1)
        gone = np.cumsum(step)[:-1] > 0
        total = np.zeros(n + 1, np.int64)
        np.cumsum(gone, out=total[1:])
        stays = ~gone
        # kept words of a text, one blank between: a blank follows every kept word but a text's last
        length = (ends - starts)[stays]
        row = np.repeat(np.arange(len(texts)), np.diff(bounds))[stays]
        last = np.ones(len(row), bool)
        last[:-1] = row[1:] != row[:-1]
        span = length + ~last
        out = np.full(int(span.sum()), 32, np.uint8)
        body = np.ones(len(out), bool)
        body[(np.cumsum(span) - 1)[~last]] = False
        keep_byte = np.zeros(len(flat) + 1, np.int8)
        keep_byte[starts[stays]] += 1
        np.add.at(keep_byte, ends[stays], -1)
        out[body] = flat[np.cumsum(keep_byte[:-1]) > 0] if len(flat) else flat
        edges = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(row, weights=span, minlength=len(texts)).astype(np.int64), out=edges[1:])
        kept = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(edges), pa.py_buffer(out)).cast(pa.string())
        removed = total[bounds[1:]] - total[bounds[:-1]]
        if untouched:
            kept = pc.if_else(pa.array(removed == 0), texts, kept)
        return pa.table({"carried": left.column("carried"), "n_words": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": kept})

    return run


def substring_dedup(docs: DataFrame, width: int = 35, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), keep_untouched: bool = False) -> DataFrame:
    """For each row: the ``carry`` columns, n_words, n_removed and kept_text (kept words joined by one blank).

    With ``keep_untouched`` a text that loses nothing stays as it is (a null one null), white space included.

    Words are runs of ``[^\\x20\\x09-\\x0D]``. A word goes when a window of ``width`` words covers it whose words
    also start anywhere else in the table, the same text included; windows are judged on the input. Texts of fewer
    than ``width`` words keep all; a null text has no words and an empty kept_text; repeated rows are copies of each
    other; an empty table gives no rows; columns that are neither text nor carried are not read.
    """
    small_batches(docs.sparkSession)
    base = numbered(docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*carry).alias("carried"))).select("rid", "text", "carried")
    buckets = bucket_count(base, "text")
    sent = base.select("rid", "text").mapInArrow(_hash_windows(width, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_count_windows, "batch long, bucket int, again binary")
    schema = T.StructType(
        [T.StructField("carried", base.schema["carried"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    )
    cut_out = batched(base).groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_cut_out(width, buckets, keep_untouched), schema)
    return cut_out.select("carried.*", "n_words", "n_removed", "kept_text")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i : i + 34], ' ') AS k
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1
), words AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
), marked AS (
  SELECT words.rid, j, word,
         coalesce(last_value(i IGNORE NULLS) OVER (PARTITION BY words.rid ORDER BY j ROWS UNBOUNDED PRECEDING) >= j - 34, false) AS gone
  FROM words LEFT JOIN again ON again.rid = words.rid AND again.i = words.j
), kept AS (
  SELECT rid, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS t
  FROM marked GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
