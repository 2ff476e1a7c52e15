"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the binary digits of its token count
(whole pieces of the longest length first). Pieces of equal length form buckets; a sequence is
one piece, so it never crosses documents and needs no padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text_arrays import ascii_lower, spaces, text_bytes, text_slices, word_spans

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
    ]
)


class WordEncoder:
    """Ids of words by the tokenizer, each distinct word encoded once while it stays in the table.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    words in order. The table is emptied beyond ``limit`` words, which bounds memory.
    """

    def __init__(self, path: str, limit: int = 1_200_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.marks = self._end_marks()
        self._clear()

    def _end_marks(self) -> np.ndarray | None:
        """Which ids end a word; None where the model has no such mark."""
        import json

        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        marks = np.zeros(max(vocabulary.values()) + 1, bool)
        marks[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
        return marks

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.first = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        # a word of letters alone is one unit of the tokenizer's pattern, and its last piece is marked as an end:
        # such words are coded by the thousand in one text and parted at the marks
        plain = [w for w in words if w.isalpha() and w.isascii()]
        if self.marks is not None:
            for at in range(0, len(plain), 2048):
                part = plain[at : at + 2048]
                flat = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
                ends = np.flatnonzero(self.marks[flat]) + 1
                if len(ends) != len(part) or ends[-1] != len(flat):
                    raise ValueError("the tokenizer parts words of letters")
                self._keep(part, flat, np.diff(ends, prepend=0))
            words = [w for w in words if w not in self.index]
        for at in range(0, len(words), 8192):
            part = words[at : at + 8192]
            ids = [code.ids for code in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            self._keep(part, np.fromiter(chain.from_iterable(ids), np.uint32, int(count.sum())), count)

    def _keep(self, part: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        n, used = len(self.index), self.used + len(flat)
        self.ids = _room(self.ids, used)
        self.first, self.count = _room(self.first, n + len(part)), _room(self.count, n + len(part))
        self.ids[self.used : used] = flat
        self.first[n : n + len(part)] = self.used + np.cumsum(count) - count
        self.count[n : n + len(part)] = count
        self.used = used
        self.index.update(zip(part, range(n, n + len(part))))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by ``end_id``; offsets of the texts in them)."""
        flat, offsets = text_bytes(texts)
        if b"<|" not in flat.tobytes():  # no special token's string, so the tokenizer's lower case may come first
            flat = ascii_lower(flat)
        keep = ~spaces(flat)
        starts, ends, bounds = word_spans(keep, offsets, _stops(flat))
        n = len(starts)
        places = np.zeros(n + 1, np.int64)
        np.cumsum(ends - starts, out=places[1:])
        words = pa.LargeStringArray.from_buffers(n, pa.py_buffer(places), pa.py_buffer(flat[keep])).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.index) + len(distinct) > self.limit:
            self._clear()
        self._learn([w for w in distinct if w not in self.index])
        rank = np.array([self.index[w] for w in distinct], np.int64)[words.indices.to_numpy()] if n else np.zeros(0, np.int64)
        count = self.count[rank]
        before = np.zeros(n + 1, np.int64)
        np.cumsum(count, out=before[1:])
        doc_ends = before[bounds[1:]] + np.arange(1, len(texts) + 1)
        doc_offsets = np.concatenate([[0], doc_ends])
        out = np.empty(int(doc_offsets[-1]), np.uint32)
        body = np.ones(len(out), bool)
        body[doc_ends - 1] = False
        out[~body] = end_id
        out[body] = self.ids[np.repeat(self.first[rank] - before[:-1], count) + np.arange(before[-1])]
        return out, doc_offsets


def _stops(flat: np.ndarray) -> np.ndarray:
    """Where a full stop or the like follows a Latin letter: the tokenizer's pattern always parts there."""
    at = np.flatnonzero(_STOP[flat])
    at = at[at > 1]
    before = flat[at - 1]
    return at[_LETTER[before] | (_ACCENTED[before] & (flat[at - 2] == 0xC3))]


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_STOP, _LETTER = _table(b".,;:!?"), _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: second bytes of the Latin-1 letters (after 0xC3)
_ACCENTED = _table(bytes(set(range(0x80, 0xC0)) - {0x97, 0xB7}))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x``, grown to hold ``n`` entries at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


_ENCODERS: dict[str, WordEncoder] = {}


def piece_lengths(n: int, longest: int) -> list[int]:
    """Whole pieces of the longest length, then the binary digits of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 4096, end_id: int = 2, slice_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of all rows: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    ``longest`` is a power of two. A null or empty text is one piece that holds ``end_id`` alone; a null id
    stays null; repeated rows give pieces of their own; an empty table gives no rows; columns other than id and
    text are not read. Texts are tokenized whole; work memory follows the longest text. No shuffle is needed:
    every task cuts its own documents, and ``bucket`` (log2 of the length) is what batches are drawn by.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, WordEncoder(tokenizer))
        for batch in batches:
            texts = batch.column(1)
            for a, z in text_slices(texts, slice_bytes):
                ids, at = encoder.encode(texts.slice(a, z - a), end_id)
                flat = ids.astype("<u4", copy=False).tobytes()
                rows: list[list] = [[], [], [], [], []]
                for i, doc in enumerate(batch.column(0).slice(a, z - a).to_pylist()):
                    start, n = 0, int(at[i + 1] - at[i])
                    for length in piece_lengths(n, longest):
                        first = 4 * (int(at[i]) + start)
                        for column, value in zip(rows, (doc, start, length, flat[first : first + 4 * length], n)):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=PIECES.names)

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut_up, PIECES)
    return pieces.withColumns(
        {
            "bucket": F.round(F.log2("length")).cast("int"),
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return piece_digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path()))
