"""Awkward documents and brute-force versions of the operators."""

import hashlib
import re
from collections import Counter

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: extra columns with the names that operators use inside or return
CLASH = ["rid", "batch", "r", "h", "d", "size", "sha", "norm", "best", "n", "score", "lang_pred", "kept_text", "n_words", "carried", "bucket", "chunk", "ids", "top", "label"]


def awkward(spark, more=()):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    texts = [
        (1, base), (2, base.replace(" ", "\n")), (3, base + " more"), (4, None), (5, ""), (6, "   \t\n"), (7, long), (8, long + " tail"), (9, base), (9, base), (None, base), (None, None),
        (10, "Released under the MIT License. MIT license again"), (11, "Über die Straße ging 漢字 😀\x00 end"), (12, "a"), (13, "B b"), (14, "12345 67890"), (15, "the gnu general public license version 3"), (16, "<|endoftext|> x.y don't STOP."), *more,
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, *["?"] * len(CLASH)) for i, t in texts], schema).coalesce(2)


def empty(spark):
    return awkward(spark).where("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def linked(texts, width, percent):
    """(set size, smallest reachable index) for each text, by comparing all pairs."""
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def without_repeats(texts, width):
    """(words, removed, kept text) for each text."""
    lists = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in lists for i in range(len(w) - width + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
