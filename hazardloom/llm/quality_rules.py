"""Quality rules by tokeniser fertility.

A public vocabulary codes the words of its languages in few, varied tokens. Characters per token, the share of tokens that are
bare bytes, and the entropy of a text's tokens are measured for each text and vocabulary; a text is rejected where one of them lies
outside the band of its language (or script, where no language is known) and length. Entropy is judged by how far it falls short of the
most that so many tokens can have, which does not drift with the length of a short text. Bands are fences about the quartiles of all
texts that pass the base rules, counted once however often a text is copied.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import SLICE_BYTES, small_batches
from .common import cut, numbered
from .text_arrays import mix, spaces, text_bytes, text_slices, window_hashes, window_rows, word_spans

#: words of a repeated window
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

# fixed values: code-point ranges of scripts (first, last), as the Unicode blocks have them
SCRIPTS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
)
NAMES = (*dict.fromkeys(n for n, _, _ in SCRIPTS), "other")
_FIRST = np.array([a for _, a, _ in SCRIPTS])
_LAST = np.array([z for _, _, z in SCRIPTS])
_NUMBER = np.array([NAMES.index(n) for n, _, _ in SCRIPTS])


@lru_cache(maxsize=4096)
def _letter_script(c: str) -> int:
    at = int(np.searchsorted(_FIRST, ord(c), side="right")) - 1
    return int(_NUMBER[at]) if at >= 0 and ord(c) <= _LAST[at] else len(NAMES) - 1


def word_script(word: str) -> int:
    """The number in ``NAMES`` of the script of a word's first letter that has one."""
    none = len(NAMES) - 1
    for c in word:
        script = _letter_script(c)
        if script != none:
            return script
    return none


@dataclass(frozen=True)
class Vocabulary:
    """A public vocabulary: a name for its columns and the file (``.model`` for sentencepiece, ``.json`` for tokenizers)."""

    name: str
    path: str


def public_vocabularies() -> tuple[Vocabulary, ...]:
    """One of pieces with byte fallback, one of byte pairs."""
    import public_tokenizers

    return Vocabulary("piece", public_tokenizers.path("piece_bpe_32k.model")), Vocabulary("pair", public_tokenizers.path("byte_bpe_50k.json"))


class _Coder:
    """Ids of words by one vocabulary, and which ids are bare bytes (or parts of a character)."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.bare = np.array([model.is_byte(i) for i in range(model.vocab_size())])
            self.code = lambda words: model.encode(words, num_threads=1)
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
            model = Tokenizer.from_file(path)
            model.encode_special_tokens = True
            size = model.get_vocab_size()
            self.bare = np.array(["�" in s for s in model.decode_batch([[i] for i in range(size)], skip_special_tokens=False)])
            self.begins = np.zeros(size, bool)  # pieces that begin with a blank, as byte-level models write it
            self.begins[[i for piece, i in model.get_vocab().items() if piece.startswith("Ġ")]] = True
            self.model, self.code = model, self._by_thousands

    def _by_thousands(self, words: list[str]) -> list:
        """Ids of each word after a blank: words that hold no white space of any kind are coded in one text, which pieces never span a blank of."""
        out: list = [None] * len(words)
        joint = [i for i, w in enumerate(words) if w.isascii() or w.isalpha()]
        for at in range(0, len(joint), 2048):
            part = joint[at : at + 2048]
            ids = np.array(self.model.encode_batch_fast([" " + " ".join([words[i] for i in part])], add_special_tokens=False)[0].ids, np.int32)
            first = np.flatnonzero(self.begins[ids])
            if len(first) == len(part) and first[0] == 0:
                for i, a, z in zip(part, first.tolist(), [*first[1:].tolist(), len(ids)]):
                    out[i] = ids[a:z]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, c in zip(rest, self.model.encode_batch_fast([" " + words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(c.ids, np.int32)
        return out


class WordTable:
    """Ids and script of words, each coded once while it stays in the table, which is emptied beyond ``limit`` words."""

    def __init__(self, paths: Sequence[str], limit: int = 300_000):
        self.coders, self.limit = [_Coder(p) for p in paths], limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.script = np.zeros(0, np.int8)
        self.first = [np.zeros(1, np.int64) for _ in self.coders]
        self.ids = [np.zeros(0, np.int32) for _ in self.coders]

    def rows(self, words: list[str]) -> np.ndarray:
        """The place of each word (all distinct) in the table."""
        if len(self.index) + len(words) > self.limit:
            self._clear()
        new = [w for w in words if w not in self.index]
        self.script = np.concatenate([self.script, np.array([word_script(w) for w in new], np.int8)])
        for i, coder in enumerate(self.coders):
            ids = coder.code(new) if new else []
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if new and isinstance(ids[0], np.ndarray) else np.fromiter(chain.from_iterable(ids), np.int32, int(count.sum()))
            self.first[i] = np.concatenate([self.first[i], self.first[i][-1] + np.cumsum(count)])
            self.ids[i] = np.concatenate([self.ids[i], flat])
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        return np.fromiter((self.index[w] for w in words), np.int64, len(words))


_TABLES: dict[tuple[str, ...], WordTable] = {}


def _encoded(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The spans of ``flat`` as a dictionary array: equal spans, equal indices."""
    step = np.zeros(len(flat) + 1, np.int8)
    step[starts] += 1
    np.add.at(step, ends, -1)
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    inside = np.cumsum(step[:-1]) > 0
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(flat[inside]))).dictionary_encode()


def _row_sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(word: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each row that stand in a window of ``width`` words found twice or more in it; ``word`` numbers the words.

    Windows meet by hash; those of one hash are compared word by word, and sorted by their words if two differ.
    """
    at = np.flatnonzero(window_rows(bounds, width, len(word)))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    step = np.zeros(len(word) + 1, np.int64)
    if len(at):
        key = mix(window_hashes(mix(word.astype(np.uint64) + np.uint64(1)), width)[at] ^ mix(row[at].astype(np.uint64)))
        order = np.argsort(key)

        def alike(order):
            a, b = at[order[1:]], at[order[:-1]]
            same = row[a] == row[b]
            for j in range(width):
                same &= word[a + j] == word[b + j]
            return same

        same = alike(order)
        if ((key[order[1:]] == key[order[:-1]]) & ~same).any():
            order = np.lexsort((*(word[at + j] for j in range(width)), row[at]))
            same = alike(order)
        again = np.zeros(len(at), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        where = at[again]
        np.add.at(step, where, 1)
        np.add.at(step, where + width, -1)
    return _row_sums(np.cumsum(step)[:-1] > 0, bounds)


def repeated_lines(flat: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines of each row (parted at ``\\n``) that hold a word and equal an earlier line of it; ``starts`` are where words begin."""
    n, rows = len(flat), len(offsets) - 1
    breaks = np.flatnonzero(flat == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    held = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[held], end[held]
    if not len(begin):
        return np.zeros(rows, np.int64)
    row = np.searchsorted(offsets, begin, side="right") - 1
    line = _encoded(flat, begin, end).indices.to_numpy()
    distinct = np.unique(row * (len(line) + 1) + line) // (len(line) + 1)
    return np.bincount(row, minlength=rows) - np.bincount(distinct, minlength=rows)


def _entropies(row: np.ndarray, token: np.ndarray, weight: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, bits a token) of each row."""
    span = int(token.max()) + 1 if len(token) else 1
    key, place = np.unique(row * span + token, return_inverse=True)
    count = np.bincount(place, weights=weight, minlength=len(key))
    total = np.bincount(key // span, weights=count, minlength=rows)
    bits = np.bincount(key // span, weights=count * np.log2(np.maximum(count, 1)), minlength=rows)
    return total, np.where(total > 0, np.log2(np.maximum(total, 1)) - bits / np.maximum(total, 1), np.nan)


def measures(texts: pa.Array, table: WordTable) -> list[np.ndarray]:
    """The base counts of each text, its script, and (tokens, characters a token, bare share, entropy) for each vocabulary."""
    flat, offsets = text_bytes(texts)
    blank, rows = spaces(flat), len(texts)
    starts, ends, bounds = word_spans(~blank, offsets)
    words = _encoded(flat, starts, ends)
    index = words.indices.to_numpy().astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(rows), np.diff(bounds))
    chars = _row_sums(~blank & ((flat & 0xC0) != 0x80), offsets)
    out = [np.diff(bounds), chars, _row_sums(_IS_SYMBOL[flat], offsets), repeated_lines(flat, offsets, starts), repeated_words(index, bounds)]
    # from here on once for each distinct word of a text
    distinct = max(len(words.dictionary), 1)
    key, count = np.unique(row * distinct + index, return_counts=True)
    of, at = key // distinct, table.rows(words.dictionary.to_pylist())[key % distinct] if len(key) else key
    seen = np.bincount(of * len(NAMES) + table.script[at], weights=count, minlength=rows * len(NAMES)).reshape(rows, -1)
    seen[:, -1] = np.where(seen[:, :-1].any(axis=1), 0, seen[:, -1])  # words without a letter do not decide
    out.append(seen.argmax(axis=1))
    for coder, first, ids in zip(table.coders, table.first, table.ids):
        length = first[at + 1] - first[at]
        before = np.cumsum(length) - length
        token = ids[np.repeat(first[at] - before, length) + np.arange(int(length.sum()))].astype(np.int64)
        weight, owner = np.repeat(count, length), np.repeat(of, length)
        total, entropy = _entropies(owner, token, weight, rows)
        bare = np.bincount(owner, weights=weight * coder.bare[token], minlength=rows)
        some = np.maximum(total, 1)
        out += [total.astype(np.int64), np.where(total > 0, chars / some, np.nan), np.where(total > 0, bare / some, np.nan), entropy]
    return out


#: bands up to which they are broadcast, so that a common language is judged where its texts are
BROADCAST_BANDS = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: what a band is about, and the least spread between quartiles that its fences reckon with
SPREADS = {"chars_per_token": 0.05, "bare_share": 0.02, "entropy_gap": 0.2}


def measure_texts(docs: DataFrame, vocabularies: Sequence[Vocabulary], id_col: str = "doc_id", text_col: str = "text", language_col: str | None = "lang") -> DataFrame:
    """rid, doc_id, the base counts, kin (the language, or the script where it is null or no column), script, and n_tokens, chars_per_token, bare_share, entropy and entropy_gap for each vocabulary.

    Words are coded one by one, so a text's tokens do not depend on where lines break. A text without tokens has null measures.
    """
    small_batches(docs.sparkSession)
    paths = tuple(v.path for v in vocabularies)
    counted = [f"{v.name}_{m}" for v in vocabularies for m in ("n_tokens", "chars_per_token", "bare_share", "entropy")]
    known = language_col is not None and language_col in docs.columns
    base = numbered(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col(language_col).cast("string") if known else F.lit(None).cast("string")).alias("language"))
    ).select("rid", "doc_id", "language", "text")
    fields = [T.StructField("rid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("language", T.StringType())]
    fields += [T.StructField(c, T.LongType()) for c in (*BASE, "script_number")]
    fields += [T.StructField(c, T.LongType() if c.endswith("n_tokens") else T.DoubleType()) for c in counted]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _TABLES.get(paths) or _TABLES.setdefault(paths, WordTable(paths))
        for batch in batches:
            for a, z in text_slices(batch.column(3), SLICE_BYTES):
                part = batch.slice(a, z - a)
                found = measures(part.column(3), table)
                arrays = [pa.array(x, mask=np.isnan(x)) if x.dtype.kind == "f" else pa.array(x, pa.int64()) for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *arrays], names=schema.names)

    measured = base.mapInArrow(run, schema)
    script = F.get(F.array(*[F.lit(n) for n in NAMES]), F.col("script_number").cast("int"))
    gaps = [(F.log2(F.col(f"{v.name}_n_tokens").cast("double")) - F.col(f"{v.name}_entropy")).alias(f"{v.name}_entropy_gap") for v in vocabularies]
    return measured.select("rid", "doc_id", *BASE, F.coalesce("language", script).alias("kin"), script.alias("script"), *counted, *gaps)


def base_failed(least_words: int = 10, most_repeats: int = 20) -> Column:
    """Fewer than ``least_words`` words, or more than ``most_repeats`` per cent of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def _octave(tokens: Column) -> Column:
    return F.floor(F.log2(F.greatest(tokens, F.lit(1)))).cast("int")


def fit_bands(measured: DataFrame, vocabularies: Sequence[Vocabulary], least_texts: int = 50, reach: float = 3.0) -> DataFrame:
    """(kin, octave, and low and high of every measure): fences ``reach`` spreads beyond the quartiles.

    Over all texts that pass the base rules, by kin and by the power of two of their token count; the row of a kin with a null octave is over all
    lengths, for cells of fewer than ``least_texts`` texts. A kin with fewer texts than that has no band and rejects nothing. A spread is the distance of the
    quartiles, or the least one of ``SPREADS``. Texts that agree in all measures count once, so groups of copies do not make the bands. Quartiles are
    exact over measures rounded to 1/256, so what a task holds is bounded by the distinct values.
    """
    names = [f"{v.name}_{m}" for v in vocabularies for m in SPREADS]
    tokens = f"{vocabularies[0].name}_n_tokens"
    rounded = [(F.round(F.col(c) * 256) / 256).alias(c) for c in names]
    once = measured.where(~base_failed()).select("kin", "word_chars", "n_words", F.col(tokens).alias("tokens"), *names).distinct().select("kin", _octave(F.col("tokens")).alias("octave"), *rounded)
    quartiles = [F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias(c) for c in names]
    by = [once.groupBy("kin", "octave").agg(F.count("*").alias("texts"), *quartiles), once.groupBy("kin").agg(F.count("*").alias("texts"), *quartiles).withColumn("octave", F.lit(None).cast("int"))]
    fences = []
    for v in vocabularies:
        for m, least in SPREADS.items():
            q1, q3 = F.get(f"{v.name}_{m}", F.lit(0)), F.get(f"{v.name}_{m}", F.lit(1))
            spread = F.greatest(q3 - q1, F.lit(least))
            fences += [(q1 - reach * spread).alias(f"{v.name}_{m}_low"), (q3 + reach * spread).alias(f"{v.name}_{m}_high")]
    return by[0].unionByName(by[1]).where(F.col("texts") >= least_texts).select("kin", "octave", *fences)


def quality_rules(
    docs: DataFrame, vocabularies: Sequence[Vocabulary] | None = None, id_col: str = "doc_id", text_col: str = "text", language_col: str | None = "lang", bands: DataFrame | None = None,
    least_texts: int = 50, reach: float = 3.0,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the base counts, base_failed, kept, kin, script, failed (the measures out of band) and the measures.

    ``bands`` are as :func:`fit_bands` returns them, fitted on ``docs`` where none are given. A null or empty text has no words and fails the base rules; a null
    id stays null; a null language is replaced by the script; repeated rows are judged alike; an empty table gives no rows; columns other than id, text
    and language are not read. Texts are measured whole, in one pass; what is shuffled is a few numbers a text.
    """
    vocabularies = tuple(vocabularies or public_vocabularies())
    measured = cut(measure_texts(docs, vocabularies, id_col, text_col, language_col))
    bands = cut(fit_bands(measured, vocabularies, least_texts, reach)) if bands is None else bands
    few = bands.count() <= BROADCAST_BANDS
    near = lambda df: F.broadcast(df) if few else df
    limits = [c for c in bands.columns if c.endswith(("_low", "_high"))]
    cells = bands.where("octave is not null").select("kin", "octave", F.struct(*limits).alias("cell"))
    pooled = bands.where("octave is null").select("kin", F.struct(*limits).alias("pooled"))
    keyed = measured.withColumn("octave", _octave(F.col(f"{vocabularies[0].name}_n_tokens")))
    judged = keyed.join(near(cells), ["kin", "octave"], "left").join(near(pooled), "kin", "left").withColumn("band", F.coalesce("cell", "pooled"))
    names = [f"{v.name}_{m}" for v in vocabularies for m in SPREADS]
    out = F.array_compact(F.array(*[F.when((F.col(c) < F.col(f"band.{c}_low")) | (F.col(c) > F.col(f"band.{c}_high")), F.lit(c)) for c in names]))
    measured_columns = [c for c in measured.columns if c.startswith(tuple(f"{v.name}_" for v in vocabularies))]
    return (
        judged.withColumns({"base_failed": base_failed(), "failed": out})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
        .select("doc_id", *BASE, "base_failed", "kept", "kin", "script", "failed", *measured_columns)
    )


def op11_quality_rules(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes]
    return found.select(*rounded).withColumn("failed", F.array_join("failed", ","))
