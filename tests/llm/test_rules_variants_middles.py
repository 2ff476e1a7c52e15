"""Quality rules, spelling variants and fill-in-middle against brute force."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from hazardloom.llm import fill_in_middle as fim  # noqa: E402
from hazardloom.llm import quality_rules as qr  # noqa: E402
from hazardloom.llm import spelling_variants as sv  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    more = [
        (20, "a\nb c\na\n\n \nb c\nb  c\na\r\n"), (21, "x y z w v x y z w v x y z w v"), (22, "a b c d e f a b c d e f g h i"), (23, "#*$ %&| <> # ok"), (24, "<P> is here"), (25, "a<S"), (26, "Übergröße übergröße Übergröse übergröse naïve façade ×÷"),
        (27, "日本語 テキスト です"), (28, "слово и дело"), (29, "a\x00b   c"), (30, "hello hello hello helo helo hellos hallo hallo hallo hallo hallo hallo"),
    ]
    return h.awkward(spark, more).persist()


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---- 11 quality rules -----------------------------------------------------------------------------------


def brute_base(text):
    w = h.words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if h.words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def brute_measures(texts, path):
    coder = qr._Coder(path)
    for text in texts:
        w = h.words(text)
        ids = [i for word in w for i in coder.code([word])[0]]
        n = len(ids)
        if not n:
            yield (0, None, None, None)
            continue
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
        yield n, sum(map(len, w)) / n, sum(bool(coder.bare[i]) for i in ids) / n, entropy


@pytest.mark.parametrize("name", ["docs", "real"])
def test_base_counts_and_fertility(name, request):
    df = request.getfixturevalue(name)
    items = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = qr.quality_rules(df)
    assert Counter((r["doc_id"], *[r[c] for c in qr.BASE]) for r in got.collect()) == Counter((i, *brute_base(t)) for i, t in items)
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["failed"])
    for v in qr.public_vocabularies():
        rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r[f"{v.name}_n_tokens"]), [r[f"{v.name}_{m}"] for m in ("chars_per_token", "bare_share", "entropy")]) for r in got.collect())
        want = sorted(((i is None, i or 0, m[0]), m[1:]) for (i, _), m in zip(items, brute_measures([t for _, t in items], v.path)))
        assert [a for a, _ in rows] == [a for a, _ in want]
        for (_, a), (_, b) in zip(rows, want):
            assert list(b) == pytest.approx(list(a)) if a[0] is not None else a == list(b)


def test_bands_equal_brute_force(spark, real):
    vocabularies = qr.public_vocabularies()[:1]
    measured = qr.measure_texts(real, vocabularies).persist()
    least = 20
    bands = {(r["kin"], r["octave"]): r for r in qr.fit_bands(measured, vocabularies, least).collect()}
    cells = {}
    for r in {tuple(r[c] for c in ("kin", "n_words", "n_repeat_words", "word_chars", "piece_n_tokens", "piece_chars_per_token", "piece_bare_share", "piece_entropy_gap")) for r in measured.collect()}:
        if r[1] >= 10 and 100 * r[2] <= 20 * r[1]:
            for octave in (int(math.log2(r[4])), None):
                cells.setdefault((r[0], octave), []).append(r[5:])
    assert set(bands) == {k for k, v in cells.items() if len(v) >= least} and any(o is not None for _, o in bands)
    for k, b in bands.items():
        for j, (m, floor) in enumerate(qr.SPREADS.items()):
            q1, q3 = np.quantile(np.round(np.array([x[j] for x in cells[k]]) * 256) / 256, [0.25, 0.75])
            assert b[f"piece_{m}_low"] == pytest.approx(q1 - 3 * max(q3 - q1, floor), abs=1e-6) and b[f"piece_{m}_high"] == pytest.approx(q3 + 3 * max(q3 - q1, floor), abs=1e-6)


def test_copies_do_not_make_the_bands_and_odd_texts_go(spark, real):
    good = real.where("lang = 'en'").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, " ".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(60)), "en"), (-2, " ".join("📎🧷" + chr(0x1F300 + i) for i in range(90)), "en")], good.schema)
    copies = spark.range(3000).select((-100 - F.col("id")).alias("doc_id"), F.lit(odd.first()["text"]).alias("text"), F.lit("en").alias("lang"))
    bands = lambda df: qr.fit_bands(qr.measure_texts(df, qr.public_vocabularies()), qr.public_vocabularies(), 20).where("octave is null").collect()
    assert bands(good.union(odd).union(copies)) == bands(good.union(odd))
    got = {r["doc_id"]: r for r in qr.quality_rules(good.union(odd), least_texts=20).collect()}
    assert not got[-1]["kept"] and "piece_chars_per_token" in got[-1]["failed"] and "piece_bare_share" in got[-2]["failed"]
    passed = [r for i, r in got.items() if i >= 0 and not r["base_failed"]]
    assert np.mean([r["kept"] for r in passed]) > 0.9


def test_scripts_stand_in_for_unknown_languages(docs):
    got = {r["doc_id"]: r for r in qr.quality_rules(docs.where("doc_id in (26, 27, 28, 14)").drop("lang"), language_col="lang").collect()}
    assert {i: r["kin"] for i, r in got.items()} == {26: "latin", 27: "kana", 28: "cyrillic", 14: "other"}
    assert {r["kin"] for r in qr.quality_rules(docs.where("doc_id = 28").withColumn("lang", F.lit("ru"))).collect()} == {"ru"}


def test_rules_of_nothing(spark):
    assert qr.quality_rules(h.empty(spark)).count() == 0


def test_repeats_are_compared_word_by_word(monkeypatch):
    monkeypatch.setattr(qr, "window_hashes", lambda w, n: np.zeros(max(len(w) - n + 1, 0), np.uint64))  # every window meets every other
    words = np.array([0, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4, 9, 8, 7, 6, 0, 1, 2, 3, 4])
    bounds = np.array([0, 12, 12, 20])
    assert qr.repeated_words(words, bounds).tolist() == [10, 0, 0]


def test_a_small_table_of_words_gives_the_same_measures():
    texts = pa.array(["some words of a text", None, "", "other words 日本 of it " * 50])
    paths = [v.path for v in qr.public_vocabularies()]
    for a, b in zip(qr.measures(texts, qr.WordTable(paths)), qr.measures(texts, qr.WordTable(paths, limit=4))):
        assert np.array_equal(a, b, equal_nan=a.dtype.kind == "f")


# ---- 12 spelling variants ---------------------------------------------------------------------------------


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(items):
    n = Counter()
    for i, t in items:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(h.LOWER)
            x = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if x % 97 == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [] for w in n}
    listed = sorted(n)
    for a in range(len(listed)):
        for b in range(a):
            if one_apart(listed[a], listed[b]):
                near[listed[a]].append(listed[b])
                near[listed[b]].append(listed[a])
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def test_variants_equal_brute_force(docs, real):
    for df in (docs, real.where("length(text) < 900")):
        got = sv.spelling_variants(df, spell=sv.planted_slips)
        assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.collect()} == brute_variants([(r["doc_id"], r["text"]) for r in df.collect()])


@pytest.mark.parametrize("hot", [1, 3, 64, 10**9])
def test_pairs_do_not_depend_on_how_large_groups_are_split(spark, hot):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abß"), rng.integers(4, 9))) for _ in range(700)} | {"a" * n for n in range(4, 12)} | {"ab" * 6, "ab" * 6 + "a", "ba" * 6})
    df = spark.createDataFrame([(w,) for w in words] + [("abc",), ("ab",), (None,)], "word string")
    got = sv.near_pairs(df, hot).collect()
    want = {(a, b) for i, b in enumerate(words) for a in words[:i] if one_apart(a, b)}
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want


def test_long_chains_of_forms_end_at_one_root(spark):
    n = 40
    forms = spark.createDataFrame([(f"w{i:02}", 1 << i, 1, f"w{i + 1:02}" if i < n else None, 1 << (i + 1) if i < n else None) for i in range(n + 1)], "word string, n long, n_near long, form string, form_n long")
    assert {r["root"] for r in sv.with_roots(forms).collect()} == {f"w{n}"}


def test_variants_of_nothing(spark):
    assert sv.spelling_variants(h.empty(spark)).count() == 0
    assert sv.spelling_variants(h.awkward(spark).select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 0


# ---- 13 fill-in-middle ---------------------------------------------------------------------------------------


def brute_middle(i, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * j : 8 * j + 8], 16) for j in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("name", ["docs", "real"])
def test_middles_equal_brute_force_and_come_back(name, request):
    df = request.getfixturevalue(name)
    made = fim.fill_in_middle(df)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    items = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got) == Counter((i, *brute_middle(i, t)) for i, t in items)
    assert Counter((r["doc_id"], r["back"]) for r in got) == Counter((i, t or "") for i, t in items)
    assert "python" not in made._jdf.queryExecution().toString().lower()


def test_middles_by_words_with_other_sentinels(real):
    marks = fim.Sentinels("[[pre]]", "[[suf]]", "[[mid]]")
    made = fim.fill_in_middle(real, percent=100, spm_percent=50, sentinels=marks, unit=r"(?s)\s*\S+|\s+$")
    got = made.join(real.select("doc_id", "text"), "doc_id").withColumn("back", fim.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {r["form"] for r in got} == {"psm", "spm"}
    for r in got:
        assert r["back"] == r["text"] and r["n"] == len(re.findall(r"\s*\S+|\s+$", r["text"]))
        assert re.findall(r"\s*\S+|\s+$", r["text"])[: r["prefix_units"]] == re.findall(r"\s*\S+|\s+$", r["text"][: r["prefix_chars"]])


def test_texts_that_units_do_not_cover_stay_plain(spark):
    df = spark.createDataFrame([(1, "only LETTERS, please")], "doc_id long, text string")
    assert fim.fill_in_middle(df, percent=100, unit="[a-z]").first()["form"] == "plain"


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "a<P>", "<M>"), ("ab", "bc", "x"), ("aba", "y", "z"), ("", "a", "b")])
def test_sentinels_that_cannot_be_told_apart_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Sentinels(*marks)


def test_outputs_that_lack_their_sentinels_do_not_restore(spark):
    df = spark.createDataFrame([("<P>a<S>b", "psm"), ("x", "spm"), (None, "psm"), ("x", None), ("<S>b<P>a<M>c", "psm"), ("<S>b<P>a<M>c", "spm")], "o string, f string")
    assert [r[0] for r in df.select(fim.restored(F.col("o"), F.col("f"))).collect()] == [None] * 5 + ["acb"]


def test_middles_of_nothing(spark):
    assert fim.fill_in_middle(h.empty(spark)).count() == 0
