"""Language ID by language-bitmask n-gram filters.

One Bloom filter a language, all of the same size and hashes, stored bit-sliced: slot s holds a
bitmask of the languages whose filter has bit s set. The AND of an n-gram's slots is the set of
all languages that contain it; counting each bit over a text gives hits by language, which are
corrected for each filter's false positives before the best covered language is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_unit
from .text_arrays import text_bytes, text_slices

WIDTH = 4  # bytes of an n-gram
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
UNKNOWN = "und"


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(4-byte n-grams of the lower-cased, space-padded texts as uint32; offsets of the texts in them)."""
    padded = pc.binary_join_element_wise(" ", pc.utf8_lower(texts.fill_null("")), " ", "")
    # white space of all kinds counts as one blank; every text gets WIDTH - 1 n-grams at least
    flat, offsets = text_bytes(pc.binary_join_element_wise(padded, "  ", ""))
    flat = np.where(flat < 32, np.uint8(32), flat)
    if len(flat) < WIDTH:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    code = flat[: len(flat) - WIDTH + 1].astype(np.uint32)
    for i in range(1, WIDTH):
        code |= flat[i : len(flat) - WIDTH + 1 + i].astype(np.uint32) << np.uint32(8 * i)
    inside = np.ones(len(flat), bool)
    for i in range(1, WIDTH):
        inside[offsets[1:] - i] = False
    at = offsets - (WIDTH - 1) * np.arange(len(offsets))
    return code[inside[: len(code)]], at


@dataclass
class LanguageFilters:
    """Bit-sliced filters: ``slots`` (size, bytes) of language bitmasks; ``rate`` false-positive rates."""

    languages: list[str]
    slots: np.ndarray
    rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], grams_of: dict[str, np.ndarray], bits_each: int = 24) -> LanguageFilters:
        largest = max((len(g) for g in grams_of.values()), default=1)
        size = 1 << max(12, int(np.ceil(np.log2(max(1, largest) * bits_each))))
        slots = np.zeros((size, max(1, -(-len(languages) // 8))), np.uint8)
        for i, lang in enumerate(languages):
            for h in _places(grams_of[lang], size):
                slots[np.unique(h), i // 8] |= np.uint8(1 << i % 8)
        fill = np.array([np.mean((slots[:, i // 8] >> np.uint8(i % 8)) & np.uint8(1)) for i in range(len(languages))])
        return cls(languages, slots, fill ** len(_MULTIPLIERS))

    def containing(self, code: np.ndarray) -> np.ndarray:
        """Bitmasks of the languages that contain each n-gram."""
        out = None
        for h in _places(code, len(self.slots)):
            out = self.slots[h] if out is None else out & self.slots[h]
        return out

    def decide(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, share of the text's n-grams that it covers) for each text."""
        n = np.maximum(np.diff(at), 1)
        masks = self.containing(code)
        share = np.zeros((len(at) - 1, len(self.languages)))
        for i in range(len(self.languages)):
            hit = np.zeros(len(code) + 1, np.int32)
            np.cumsum((masks[:, i // 8] >> np.uint8(i % 8)) & np.uint8(1), out=hit[1:])
            seen = (hit[at[1:]] - hit[at[:-1]]) / n
            share[:, i] = np.clip((seen - self.rate[i]) / (1 - self.rate[i]), 0, 1)
        best = np.argmax(share, axis=1)
        return best, share[np.arange(len(share)), best]


def _places(code: np.ndarray, size: int) -> list[np.ndarray]:
    shift = np.uint32(32 - size.bit_length() + 1)
    mixed = code ^ (code >> np.uint32(15))
    return [(mixed * np.uint32(m) ^ (mixed >> np.uint32(11)) * np.uint32(m ^ 0x5BD1E995)) >> shift for m in _MULTIPLIERS]


def fit_filters(training: DataFrame, text_col: str, lang_col: str, texts_each: int = 5_000, least_share: float = 0.002) -> LanguageFilters:
    """Learn the filters from at most about ``texts_each`` distinct labelled texts of each language.

    The texts are drawn by a hash of their content, which no text's number of copies changes, so every language has its
    share however rare. A language keeps every n-gram that occurs in ``least_share`` of its sampled texts or more; both
    bounds are parameters of the classifier. Languages are in order of their names. The driver gets the counts of
    languages and the n-grams kept, of which the two bounds allow ``n-grams of a text / least_share`` a language.
    """
    rows = training.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    size = {r["lang"]: r["count"] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}
    if not size:
        return LanguageFilters([], np.zeros((4096, 1), np.uint8), np.zeros(0))
    rates = F.create_map(*[F.lit(x) for lang, n in sorted(size.items()) for x in (lang, min(1.0, texts_each / n))])
    drawn = rows.where(hash_unit(F.lit(5), F.col("h")) < rates[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            for a, z in text_slices(batch.column(0), 1 << 20):
                code, at = grams(batch.column(0).slice(a, z - a))
                where = langs.indices.to_numpy()[a:z].astype(np.uint64)
                row = np.repeat(np.arange(z - a, dtype=np.uint64), np.diff(at))
                once = np.unique((row << np.uint64(32)) | code)
                key, n = np.unique((where[(once >> np.uint64(32)).astype(np.int64)] << np.uint64(32)) | (once & np.uint64(0xFFFFFFFF)), return_counts=True)
                lang = langs.dictionary.take(pa.array((key >> np.uint64(32)).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([lang, pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = drawn.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map(*[F.lit(x) for lang, n in sorted(size.items()) for x in (lang, least_share * min(n, texts_each))])
    kept = counts.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram").toArrow()
    codes, langs = kept.column("gram").to_numpy().astype(np.uint32), kept.column("lang").to_numpy()
    of = {lang: np.sort(codes[langs == lang]) for lang in sorted(size)}
    return LanguageFilters.build(list(of), of)


def predict_language(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the share of its n-grams that the language covers, 0 to 1).

    A null text or one without a letter is ``und`` with score 0, as is every text when no language was
    learned; ties go to the language first by name. All columns stay; columns of these two names are replaced.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        labels = np.array([*known.languages, UNKNOWN], dtype=object)
        for batch in batches:
            texts = batch.column(names.index(text_col))
            lang, score = [], []
            for a, z in text_slices(texts, 1 << 20):
                part = texts.slice(a, z - a)
                lettered = pc.match_substring_regex(part, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
                if known.languages:
                    best, share = known.decide(*grams(part))
                else:
                    best, share = np.zeros(z - a, np.int64), np.zeros(z - a)
                    lettered[:] = False
                lang.append(labels[np.where(lettered, best, -1)])
                score.append(np.where(lettered, share, 0.0))
            more = [pa.array(np.concatenate(lang) if lang else [], pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return docs.select(*names).mapInArrow(predict, schema)


def learnable(id_col: str = "doc_id") -> F.Column:
    """The fold to learn from: crc32 of the id as text, modulo 5, is not 0 (a null id is not learned from)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    filters = fit_filters(docs.where(learnable()), "text", "lang")
    return predict_language(docs.select("doc_id", "text"), filters).select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")
