"""Spelling variant grouping by a rare-first q-gram prefix filter.

Words are counted over all texts. Bigrams are ordered by how many words hold them, rarest first, and words meet on the
three rarest bigrams of each: an edit spoils at most two bigrams of a word, so words one edit apart share one of their three,
at places that differ by the edit alone. Candidates are then compared in full.

Where a bigram, place and length are common, words also have to share a half, as words one edit apart do: a large group is split
by content and never pairs all its members. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: runs of letters: A-Z, a-z and the Latin-1 range that holds the accented ones
RUN = "[A-Za-zÀ-ÿ]+"
#: bigrams that a word is known by: twice the edits, and one
PREFIX = 3
#: words of one bigram, place and length above which they meet by halves too
HOT = 64
#: distinct bigrams up to which their counts are broadcast
BROADCAST_GRAMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other characters stay."""
    return F.translate(text, UPPER, LOWER)


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = RUN, spell: Callable[[Column, Column], Column] | None = None, least_chars: int = 5, least_count: int = 3,
) -> DataFrame:
    """(word, n): the lower-cased matches of ``pattern`` in all texts, counted, of ``least_chars`` code points and ``least_count`` occurrences at least.

    ``spell(id, run)`` may rewrite an occurrence first. A null text has no words; repeated rows count again; an empty table gives no rows. Occurrences
    are counted within each task before they are shuffled, so a word that fills a third of the corpus costs one row a task.
    """
    runs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col).cast("string")), F.lit(pattern), F.lit(0))).alias("run"))
    words = runs.select((spell(F.col("doc_id"), F.col("run")) if spell else F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _grams(words: DataFrame) -> DataFrame:
    """(word, len, at, gram) of every bigram of every word; places count from 0."""
    sized = words.select("word", F.char_length("word").alias("len"))
    return sized.select("word", "len", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("len") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("at", "gram"))


def rare_grams(words: DataFrame) -> DataFrame:
    """(word, len, at, gram): the ``PREFIX`` bigrams of each word that the fewest words hold (ties by bigram, then place).

    The order is over bigrams whatever their place, as an edit moves what follows it.
    """
    grams = _grams(words)
    held = cut(grams.groupBy("gram").agg(F.count("*").alias("df")))
    # bigrams of a few alphabets fit every task, and common ones then meet where they are
    held = F.broadcast(held) if held.count() <= BROADCAST_GRAMS else held
    # one row a word: its bigrams are sorted where they are, so no second pass by word is needed
    ranked = grams.join(held, "gram").groupBy("word", "len").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "gram", "at"))), 1, PREFIX).alias("rare"))
    return ranked.select("word", "len", F.explode("rare").alias("g")).select("word", "len", "g.at", "g.gram")


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b), once each: words exactly one inserted, deleted or replaced code point apart.

    ``words`` has distinct words in column ``word``; those of fewer than four code points have too few bigrams and are left out, as are nulls.
    A pair of equal lengths has its shared bigrams at equal places; of two lengths, at equal places before the edit and one apart after it: keys
    are (bigram, shorter length, its place, which of the three).
    """
    rare = rare_grams(words.where(F.char_length("word") > PREFIX))
    # (kind, length and place in the shorter word, role): equal lengths; the edit after the bigram; the edit before it
    roles = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), (F.col("len") - F.lit(longer)).alias("size"), (F.col("at") - F.lit(moved)).alias("place"), F.lit(role).alias("role"))
            for kind, longer, moved, role in ((0, 0, 0, 0), (1, 0, 0, 1), (1, 1, 0, 2), (2, 0, 0, 1), (2, 1, 1, 2))
        ]
    )
    key = ["gram", "kind", "size", "place"]
    keyed = cut(rare.select("word", "gram", F.explode(roles).alias("r")).select("word", "gram", "r.*").where("place >= 0"))
    crowds = keyed.groupBy(*key).agg(F.count("*").alias("members"), F.max("role").alias("hi"), F.min("role").alias("lo"))
    met = keyed.join(crowds.where("members > 1 and (kind = 0 or hi > lo)").drop("hi", "lo"), key)
    # an edit lies in one half, so the other half is shared; of the longer word, halves are measured as the shorter one's
    half = F.floor(F.col("size") / 2).cast("int")
    left = F.concat(F.lit("<"), F.substring("word", F.lit(1), half))
    right = F.concat(F.lit(">"), F.substring("word", half + F.when(F.col("role") == 2, 2).otherwise(1), F.char_length("word")))
    split = met.withColumn("half", F.explode(F.when(F.col("members") > hot, F.array(left, right)).otherwise(F.array(F.lit("")))))
    one = split.where("role < 2").select(*key, "half", F.col("word").alias("a"))
    two = split.where("role <> 1").select(*key, "half", F.col("word").alias("b"))
    pairs = one.join(two, [*key, "half"]).where("(kind > 0 or a < b) and levenshtein(a, b, 1) = 1")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variant_forms(counts: DataFrame, ratio: int = 2, hot: int = HOT) -> DataFrame:
    """(word, n, n_near, form, form_n) for ``counts`` (word, n): how many words are near, and the commonest of them if it is ``ratio`` times as common.

    Ties between near words go to the smallest in code-point order; without near words n_near is 0 and form null.
    """
    pairs = near_pairs(counts, hot)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select(F.col("b"), F.col("a")))
    known = both.join(counts.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = known.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    joined = counts.join(best, "word", "left")
    strong = -F.col("best.m") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.m")).alias("form_n"))


def with_roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """``forms`` with root: where following forms from word to word ends.

    A form is at least twice as common as its word, so a chain has at most 63 steps; each round doubles what a link spans.
    """
    links = cut(forms.where("form is not null").select("word", F.col("form").alias("to")))
    for _ in range(rounds):
        on = links.join(links.select(F.col("word").alias("to"), F.col("to").alias("next")), "to", "left")
        stepped = cut(on.select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            break
        links = stepped.drop("moved")
    else:
        raise RuntimeError("forms do not come to an end")
    return forms.join(links.select("word", F.col("to").alias("root")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spell=None, least_chars: int = 5, least_count: int = 3, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``docs``, as :func:`word_counts` and :func:`variant_forms` say.

    Nulls in any column, empty and very long texts and repeated rows are no matter; an empty table gives no rows; columns other than id and text are not read.
    The vocabulary is written once to the shared folder; nothing is fetched to the driver.
    """
    counts = cut(word_counts(docs, id_col, text_col, spell=spell, least_chars=least_chars, least_count=least_count))
    forms = cut(variant_forms(counts, ratio))
    return with_roots(forms)


def planted_slips(doc_id: Column, run: Column, every: int = 97) -> Column:
    """An occurrence, less one code point where ``every`` divides the crc32 h of ``<doc_id>:<run>``: the one at h % length (a null id counts as an empty one)."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), spell=planted_slips)


def variants_sql(every: int = 97) -> str:
    """The query in DuckDB's SQL: candidates are words that agree with one code point left out, and the checksum is the bitwise one."""
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) AS run FROM documents WHERE text IS NOT NULL) GROUP BY ALL
), steps(i, c) AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FROM range(256) t(i)
), bytes(b) AS (SELECT list(c ORDER BY i) FROM steps
), spelt AS (
  SELECT run, k, length(run) AS len, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, x: xor(c >> 8, b[(xor(c, x) & 255) + 1]))) AS h
  FROM runs, bytes
), w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % {every} = 0 THEN substr(run, 1, h % len) || substr(run, h % len + 2) ELSE run END AS word FROM spelt)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), less AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, w.word FROM less JOIN w ON w.word = less.rest
  UNION SELECT w.word, less.word FROM less JOIN w ON w.word = less.rest
), best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS m FROM near JOIN w ON w.word = near.other GROUP BY near.word
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)
), chain(word, node, form) AS (
  SELECT word, word, form FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.form
)
SELECT f.word, n, n_near, f.form, form_n, node AS root FROM f JOIN chain ON chain.word = f.word AND chain.form IS NULL
"""


OP12_SQL = variants_sql()
