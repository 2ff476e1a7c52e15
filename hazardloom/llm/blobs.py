"""Shuffling hashes as compact blobs.

A map task sorts the distinct 64-bit hashes of a batch of rows and sends one blob for each hash
range ("bucket"); a reduce task sees all blobs of a bucket and answers to the sending batch.
That is a partial aggregation followed by a shuffle on the hash, at 6 to 9 bytes a hash and no JVM
row for each. A hash that fills a third of the corpus costs one entry a batch. Bucket count follows
the input size, so a bucket stays within ``BUCKET_BYTES`` of text. A batch is consecutive rows of a partition of at most
``BATCH_BYTES`` of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width
from .text_arrays import text_lengths, text_slices

#: text bytes whose hashes one reduce call holds (about eight times as much memory)
BUCKET_BYTES = 8 << 20
#: text bytes and rows of a batch
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1 << 10
#: log2 of the rows in a batch of fixed length (:func:`segments`), which is ``rid >> BATCH_BITS``
BATCH_BITS = 8
SLICE_BYTES = 4 << 20


def small_batches(spark, rows: int = 1000, size: int = 16 << 20) -> None:
    """Keep Arrow batches small enough for long texts."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def bucket_count(docs: DataFrame, text_col: str) -> int:
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(shuffle_width(docs.sparkSession), -(-total // BUCKET_BYTES))


def segments(batches: Iterator[pa.RecordBatch], rid: int, text: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(row batch, its rows) in order; a row batch comes in several pieces where it is large."""
    for batch in batches:
        if not batch.num_rows:
            continue
        of = batch.column(rid).to_numpy() >> BATCH_BITS
        edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            part = batch.slice(a, z - a)
            for x, y in text_slices(part.column(text), SLICE_BYTES):
                yield int(of[a]), part.slice(x, y - x)


class _Cutter:
    """Cuts a stream of rows into batches; where they begin does not depend on how the stream is cut into pieces."""

    def __init__(self):
        self.rows = self.bytes = 0

    def runs(self, texts: pa.Array) -> Iterator[tuple[int, int, bool]]:
        """(start, stop, whether a batch begins at start) of the rows of the next piece."""
        ends = np.cumsum(text_lengths(texts))
        at, n = 0, len(ends)
        while at < n:
            done = int(ends[at - 1]) if at else 0
            stop = min(int(np.searchsorted(ends, done + BATCH_BYTES - self.bytes, side="right")), at + BATCH_ROWS - self.rows)
            if stop <= at:
                if self.rows:
                    self.rows = self.bytes = 0
                    continue
                stop = at + 1  # one text of its own
            yield at, stop, not self.rows
            self.rows, self.bytes = self.rows + stop - at, self.bytes + int(ends[stop - 1]) - done
            at = stop


def whole_batches(batches: Iterator[pa.RecordBatch], rid: int, text: int) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of the batches of a partition; a batch's number is the rid of its first row."""
    cutter, held, number = _Cutter(), [], 0
    for piece in batches:
        for a, z, begins in cutter.runs(piece.column(text)):
            if begins:
                if held:
                    yield number, pa.Table.from_batches(held).combine_chunks()
                held, number = [], piece.column(rid)[a].as_py()
            held.append(piece.slice(a, z - a))
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


def batched(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (rid, .., text) with the number of their batch, as :func:`whole_batches` gives it."""
    rid, at = rows.columns.index("rid"), rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, number = _Cutter(), 0
        for piece in batches:
            numbers = np.zeros(piece.num_rows, np.int64)
            for a, z, begins in cutter.runs(piece.column(at)):
                number = piece.column(rid)[a].as_py() if begins else number
                numbers[a:z] = number
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(numbers)], names=[*piece.schema.names, "batch"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())]))


def one_array(table: pa.Table, name: str) -> pa.Array:
    """A column of a batch as one array (a batch's text is small, or one value)."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        if column.num_chunks > 1:
            raise ValueError(f"{name} does not fit one array")
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    return column


def planes(x: np.ndarray) -> bytes:
    """Byte planes of an unsigned array, the low byte first: planes of zeros compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if len(data) % width:
        raise ValueError("the planes hold another type")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    step = keys.copy()
    step[1:] -= keys[:-1]
    return planes(step)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the sorted keys begins (and the end)."""
    limits = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def first_of_runs(sorted_keys: np.ndarray) -> np.ndarray:
    first = np.ones(len(sorted_keys), bool)
    first[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return first
