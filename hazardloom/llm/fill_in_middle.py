"""Fill-in-the-middle transformation in Spark SQL functions alone.

A text becomes the array of its units, two numbers of a digest of its id cut that array, the three slices are joined again
behind sentinels, and a transformed text is read back by its sentinels. Every row stands by itself: no shuffle, and the cuts do not
depend on where or how often a row is computed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    """Marks of the three parts. They must differ, none may hold another, and no mark may begin as another ends."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = self.all()
        if not all(marks) or len(set(marks)) < 3 or any(a in b for a in marks for b in marks if a != b):
            raise ValueError("sentinels must differ, and none may hold another")
        if any(a[-n:] == b[:n] for a in marks for b in marks for n in range(1, min(len(a), len(b)))):
            raise ValueError("no sentinel may begin as another ends")  # or a text's end and a sentinel could make one

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def inside(self, text: Column) -> Column:
        return F.contains(text, F.lit(self.prefix)) | F.contains(text, F.lit(self.suffix)) | F.contains(text, F.lit(self.middle))

    def pattern(self) -> str:
        return "|".join(re.escape(m) for m in self.all())


def _draws(seed: int, id_col: Column) -> list[Column]:
    """The first four 8-digit groups of the hex digest of ``<seed>:<id>``, as whole numbers (a null id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20,
    sentinels: Sentinels = Sentinels(), unit: str = "(?s).",
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n, form, prefix_units, middle_units, prefix_chars, middle_chars, output.

    ``unit`` is a pattern whose matches, left to right, make up a text: code points as they stand, or ``(?s)\\s*\\S+|\\s+$`` for
    words; ``n`` is their number. ``percent`` of the ids are transformed, ``spm_percent`` of those with the suffix first. A text that is
    null (it counts as empty), empty, or holds a sentinel stays plain, with null part lengths, as does one that the pattern does not cover. A null id is
    drawn for as an empty one; repeated rows come out alike; an empty table gives no rows; columns other than id and text are
    not read. A row's units are in memory at once: about 70 bytes a unit.
    """
    marks = sentinels
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = _draws(seed, F.col("doc_id"))
    cut = rows.withColumns({"units": F.regexp_extract_all("text", F.lit(unit), F.lit(0)), "h1": h1, "h2": h2, "h3": h3, "h4": h4}).withColumn("n", F.size("units"))
    places = cut.withColumns({"a": (F.col("h1") % (F.col("n") + 1)).cast("int"), "b": (F.col("h2") % (F.col("n") + 1)).cast("int")})
    low, high = F.least("a", "b"), F.greatest("a", "b")
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    parts = places.withColumns({"prefix": part(F.lit(1), low), "middle": part(low + 1, high - low), "suffix": part(high + 1, F.col("n") - high)})
    stays = (F.col("text") == "") | marks.inside(F.col("text")) | (F.col("h3") % 100 >= percent)
    if unit != "(?s).":
        stays |= F.concat("prefix", "middle", "suffix") != F.col("text")
    form = F.when(stays, PLAIN).when(F.col("h4") % 100 < spm_percent, SPM).otherwise(PSM)
    formed = parts.withColumn("form", form)
    mark = {k: F.lit(getattr(marks, k)) for k in ("prefix", "suffix", "middle")}
    put = lambda *order: F.concat(*[c for k in order for c in (mark[k], F.col(k))])
    output = F.when(F.col("form") == PLAIN, F.col("text")).when(F.col("form") == PSM, put("prefix", "suffix", "middle")).otherwise(put("suffix", "prefix", "middle"))
    moved = F.col("form") != PLAIN
    return formed.select(
        "doc_id",
        F.col("n").cast("long").alias("n"),
        "form",
        F.when(moved, low).cast("long").alias("prefix_units"),
        F.when(moved, high - low).cast("long").alias("middle_units"),
        F.when(moved, F.char_length("prefix")).cast("long").alias("prefix_chars"),
        F.when(moved, F.char_length("middle")).cast("long").alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The text that ``output`` was made of, read back by its sentinels: the mark before a part says which one it is.

    Null where either is null, or where a transformed output does not hold the three sentinels as its form has them.
    """
    parts = F.split(output, sentinels.pattern(), -1)
    whole = F.size(parts) == 4
    first, second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    begins = lambda m: F.startswith(output, F.lit(m))
    psm = F.when(whole & begins(sentinels.prefix), F.concat(first, third, second))
    spm = F.when(whole & begins(sentinels.suffix), F.concat(second, third, first))
    return F.when(form == PLAIN, output).when(form == PSM, psm).when(form == SPM, spm)


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    found = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP13_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), g AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4
  FROM d
), f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
), p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
