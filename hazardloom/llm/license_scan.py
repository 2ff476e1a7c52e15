"""Licence scans by diagonal voting.

Every rolling word k-gram of every text is hashed; those that a template may hold are joined by Spark to the
k-gram positions of the templates, words compared; matches vote for (row, template, offset diagonal). Words that a copy
puts in or leaves out move what follows to another diagonal, so diagonals whose matches lie in one window of the text, twice as long as the template,
are merged into a place; and a place is verified by its longest chain of matches that rises in text and template alike, across any gap. A phrase must
stand whole, on one diagonal; a licence's text up to a share of its k-grams.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import SLICE_BYTES, small_batches
from .common import numbered
from .license_texts import PHRASES, TEXTS, WEAK
from .text_arrays import ascii_lower, text_bytes, text_slices, window_hashes, window_rows, word_hashes, word_spans

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def template_words(text: str) -> list[str]:
    """Words of a template's text (A-Z lower-cased)."""
    return re.findall(WORD, re.sub("[A-Z]+", lambda m: m.group().lower(), text))


@dataclass(frozen=True)
class Template:
    """Words that stand for a licence, found by their ``k``-grams: with a ``share`` of 1 a phrase that must stand whole.

    The label of a ``weak`` template counts only where a text has no other.
    """

    label: str
    text: str
    base: bool = False
    share: float = 1.0
    k: int = 2
    weak: bool = False

    def grams(self) -> list[str]:
        words = template_words(self.text)
        if len(words) < self.k:
            raise ValueError(f"a template of {self.label} has fewer than {self.k} words")
        return [" ".join(words[i : i + self.k]) for i in range(len(words) - self.k + 1)]


BASE_TEMPLATES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
TEMPLATES = (*BASE_TEMPLATES, *(Template(label, text, weak=label in WEAK) for label, text in PHRASES), *(Template(label, text, share=0.8, k=4) for label, text in TEXTS))
#: template positions up to which their table is broadcast
BROADCAST_GRAMS = 1_000_000
HITS = "rid long, doc_id long, n_words long, pos long, hash long, gram string"
#: the gram of the row's own mark, which joins with template -1
MARK = ""


def gram_hash(gram: str) -> int:
    """The hash that the scan gives a k-gram (signed)."""
    flat = np.frombuffer(gram.encode(), np.uint8)
    starts, ends, _ = word_spans(_IS_WORD[flat], np.array([0, len(flat)]))
    return int(window_hashes(word_hashes(flat, starts, ends), len(starts)).view(np.int64)[0])


def template_positions(spark, templates: Sequence[Template]) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """((hash, gram, template, position) of all templates and the row's mark; the sorted hashes by k)."""
    rows, hashes = [(0, MARK, -1, 0)], {}
    for number, template in enumerate(templates):
        for i, gram in enumerate(template.grams()):
            rows.append((gram_hash(gram), gram, number, i))
            hashes.setdefault(template.k, set()).add(rows[-1][0])
    table = spark.createDataFrame(rows, "t_hash long, t_gram string, template int, t_pos long").coalesce(1)
    return F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table, {k: np.array(sorted(v), np.int64) for k, v in hashes.items()}


def _rolling(hashes):
    """Each row's mark, and its k-grams of a template's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in text_slices(batch.column(2), SLICE_BYTES):
                part = batch.slice(a, z - a)
                flat, offsets = text_bytes(part.column(2))
                flat = ascii_lower(flat)
                starts, ends, bounds = word_spans(_IS_WORD[flat], offsets)
                words, n = word_hashes(flat, starts, ends), len(starts)
                row_of, raw = np.repeat(np.arange(z - a), np.diff(bounds)), flat.tobytes()
                row, pos, found, grams = [np.arange(z - a)], [np.full(z - a, -1)], [np.zeros(z - a, np.int64)], [MARK] * (z - a)
                for k, known in hashes.value.items():
                    code = window_hashes(words, k).view(np.int64)
                    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                    hit = np.flatnonzero((known[at] == code) & window_rows(bounds, k, n)) if len(code) else np.zeros(0, np.int64)
                    row.append(row_of[hit])
                    pos.append(hit - bounds[row_of[hit]])
                    found.append(code[hit])
                    grams += [b" ".join(raw[starts[i + j] : ends[i + j]] for j in range(k)).decode() for i in hit.tolist()]
                row = np.concatenate(row)
                columns = [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(np.diff(bounds)[row], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(pos), pa.int64()), pa.array(np.concatenate(found)), pa.array(grams, pa.string())], names=[f.split()[0] for f in HITS.split(", ")])

    return run


def rising_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of (pos, t_pos) pairs that rises in both (of equally long ones, one that ends lowest)."""
    pairs = sorted(pairs, key=lambda x: (x[0], -x[1]))
    tails, at, before = [], [], [-1] * len(pairs)
    for i, (_, t) in enumerate(pairs):
        j = bisect_left(tails, t)
        before[i] = at[j - 1] if j else -1
        tails[j:], at[j:] = [t, *tails[j + 1 :]], [i, *at[j + 1 :]]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


PLACES = "rid long, doc_id long, n_words long, template int, place long, held long, first long, last long"


def _verified(spans: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[int]] = [[], [], []]
            for template, votes in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist()):
                chain = rising_chain([(v["diagonal"] + t, t) for v in votes for t in v["held"]])
                for column, value in zip(found, (len(chain), chain[0][0], chain[-1][0] + spans[template] - 1 if template >= 0 else -1)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *[pa.array(c, pa.int64()) for c in found]], names=[f.split()[0] for f in PLACES.split(", ")])

    return run


def find_spans(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified places: rid, doc_id, n_words, template, first, last (word numbers), share; and one row with template -1 for each row of ``docs``.

    ``share`` is the part of the template's k-grams in the longest chain that rises in text and template, within twice the template's
    length; of two places that overlap the better one stays. A null text has no words; a text of fewer than ``k`` words has no places; a null
    id stays null; repeated rows are scanned apart; an empty table gives no rows; columns other than id and text are not read. A row's matches
    meet in one task, as its words did in the input; what is verified at once is the matches of one window.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known, hashes = template_positions(spark, templates)
    base = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    grams = base.mapInArrow(_rolling(spark.sparkContext.broadcast(hashes)), HITS)
    hits = grams.join(known, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram"))).select("rid", "doc_id", "n_words", "template", "pos", "t_pos")
    row = ["rid", "doc_id", "n_words", "template"]
    sizes, shares = (_per_template(templates, v) for v in ([float(len(t.grams())) for t in templates], [float(t.share) for t in templates]))
    whole, length = (_per_template(templates, v) for v in ([t.share >= 1 for t in templates], [len(t.grams()) + t.k - 1 for t in templates]))
    diagonal, step = F.col("pos") - F.col("t_pos"), F.floor(F.col("pos") / length)
    # a phrase's place is its diagonal; a text's are windows that begin at every multiple of its length, so each match is in two
    places = F.when(whole | (F.col("template") < 0), F.array(diagonal)).otherwise(F.array(step, step - 1))
    # one exchange: everything up to the chains groups by the row first
    votes = hits.repartition("rid").select(*row, "t_pos", diagonal.alias("diagonal"), F.explode(places).alias("place")).groupBy(*row, "place", "diagonal").agg(F.collect_list("t_pos").alias("held"))
    merged = votes.groupBy(*row, "place").agg(F.collect_list(F.struct("diagonal", "held")).alias("votes"))
    enough = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda v: v["held"])))) / sizes >= shares  # no chain is longer
    found = merged.where((F.col("template") < 0) | enough).mapInArrow(_verified([t.k for t in templates]), PLACES)
    sized = found.withColumn("share", F.when(F.col("template") < 0, 0.0).otherwise(F.col("held") / sizes)).where((F.col("template") < 0) | (F.col("share") >= shares))
    by = Window.partitionBy(*row).orderBy("place")
    me = F.struct("place", "held", "first", "last")
    best = sized.withColumns({"prior": F.lag(me).over(by), "next": F.lead(me).over(by)})
    meets = lambda o: (F.abs(F.col(f"{o}.place") - F.col("place")) == 1) & (F.col(f"{o}.first") <= F.col("last")) & (F.col(f"{o}.last") >= F.col("first"))
    worse = (meets("prior") & (F.col("prior.held") >= F.col("held"))) | (meets("next") & (F.col("next.held") > F.col("held")))
    return best.where((F.col("template") < 0) | whole | ~F.coalesce(worse, F.lit(False))).select(*row, "first", "last", "share")


def _per_template(templates: Sequence[Template], values: list) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("template"))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest verified share of a template; labels are distinct, sorted and comma-joined, those of weak templates left out
    where there is another. Awkward rows are treated as :func:`find_spans` says; a row without places has empty labels, no base words and score 0.
    """
    base = _per_template(templates, [t.base for t in templates]) & (F.col("template") >= 0)
    label = F.when(F.col("template") >= 0, _per_template(templates, [t.label for t in templates]))
    weak = _per_template(templates, [t.weak for t in templates])
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  at most one entry a label
    return (
        find_spans(docs, templates, id_col, text_col)
        .groupBy("rid", "doc_id", "n_words")
        .agg(
            F.sum(F.when(base, 1).otherwise(0)).cast("long").alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
            joined(F.when(base, label)).alias("base_labels"),
            F.coalesce(F.nullif(joined(F.when(~weak, label)), F.lit("")), joined(label)).alias("labels"),
            F.max("share").alias("score"),
        )
        .drop("rid")
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def scan_sql(templates: Sequence[Template] = TEMPLATES) -> str:
    """The scan over ``documents`` in DuckDB's SQL, on words instead of hashes; chains are found by patience sorting."""
    rows = lambda values: ", ".join("(" + ", ".join(str(v) if not isinstance(v, str) else f"'{v}'" for v in r) + ")" for r in values)
    grams = rows((n, i, t.k, g) for n, t in enumerate(templates) for i, g in enumerate(t.grams()))
    facts = rows((n, t.label, t.base, t.weak, t.share, len(t.grams()), len(t.grams()) + t.k - 1) for n, t in enumerate(templates))
    every_k = " UNION ALL ".join(f"SELECT rid, i, {k} AS k, array_to_string(w[i + 1 : i + {k}], ' ') AS gram FROM (SELECT rid, w, unnest(range(greatest(len(w) - {k - 1}, 0))) AS i FROM d)" for k in sorted({t.k for t in templates}))
    return f"""
WITH tg(template, t_pos, k, gram) AS (VALUES {grams}),
tf(template, label, base, weak, share, size, length) AS (VALUES {facts}),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), g AS ({every_k}),
h AS (SELECT rid, template, i AS pos, t_pos FROM g JOIN tg ON tg.k = g.k AND tg.gram = g.gram),
p AS (
  SELECT rid, template, pos, t_pos, unnest(CASE WHEN share >= 1 THEN [pos - t_pos] ELSE [pos // length, pos // length - 1] END) AS place FROM h JOIN tf USING (template)
), m AS (
  SELECT rid, template, place, min(pos) AS start, list([t_pos] ORDER BY pos, t_pos DESC) AS held
  FROM p JOIN tf USING (template) GROUP BY rid, template, place, size, share HAVING CAST(count(DISTINCT t_pos) AS DOUBLE) / size >= share
), c AS (
  SELECT rid, template, start, len(list_reduce(list_prepend([-1], held), lambda tails, x: list_filter(tails, lambda y: y < x[1]) || x || list_filter(tails, lambda y: y >= x[1])[2:])) - 1 AS held FROM m
), ok AS (SELECT rid, start, label, base, weak, CAST(held AS DOUBLE) / size AS part FROM c JOIN tf USING (template) WHERE CAST(held AS DOUBLE) / size >= share),
n AS (
  SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE NOT weak), string_agg(DISTINCT label, ',' ORDER BY label)) AS labels, max(part) AS score
  FROM ok GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN n USING (rid)
"""


OP4_SQL = scan_sql()
