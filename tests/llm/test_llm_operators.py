import os
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

from hazardloom.llm import exact_dedup, language_id, license_scan, lm_scoring, ngram_jaccard, packing, piece_coding, sharding, substring_dedup, text_arrays, vector_topk  # noqa: E402
from hazardloom.llm.components import components  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return h.awkward(spark).persist()


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---- text arrays ------------------------------------------------------------------------------------


def test_words_and_hashes_do_not_cross_rows():
    flat, offsets = text_arrays.text_bytes(pa.array(["ab cd", "cd ab", None, "", "ab"]))
    s, e, b = text_arrays.word_spans(~text_arrays.spaces(flat), offsets)
    assert [bytes(flat[x:y]).decode() for x, y in zip(s, e)] == ["ab", "cd", "cd", "ab", "ab"]
    assert b.tolist() == [0, 2, 4, 4, 4, 5]
    w = text_arrays.word_hashes(flat, s, e)
    assert w[0] == w[3] == w[4] and w[1] == w[2] != w[0]
    two = text_arrays.window_hashes(np.concatenate([w[:2], w[3:4], w[1:2]]), 2)
    assert two[0] == two[2] != two[1]


def test_long_words_differ_in_their_tails():
    flat, offsets = text_arrays.text_bytes(pa.array(["x" * 200 + "a", "x" * 200 + "b", "x" * 200 + "a"]))
    w = text_arrays.word_hashes(flat, *text_arrays.word_spans(~text_arrays.spaces(flat), offsets)[:2])
    assert w[0] == w[2] != w[1]


# ---- 1 sharding ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["docs", "real"])
def test_shards_are_even_and_slots_gapless(name, request):
    df = request.getfixturevalue(name)
    got = sharding.shard_documents(df).collect()
    want = df.select("doc_id", "text").collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in want)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    for s, part in by.items():
        assert 0 <= s < 16 and sorted(r["slot"] for r in part) == list(range(len(part)))
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(16):
        assert abs(sum(r["size"] for r in by.get(s, [])) - total / 16) <= most


def test_sharding_of_nothing(spark):
    assert sharding.shard_documents(h.empty(spark)).count() == 0


def test_sharding_splits_one_huge_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    sizes = [r["count"] for r in sharding.shard_documents(df).groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 1


# ---- 2 exact dedup -----------------------------------------------------------------------------------------


def brute_exact(items):
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in items:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {n: (min(g)[3], len(g)) for n, g in groups.items()}, norm


@pytest.mark.parametrize("name", ["docs", "real"])
def test_exact_groups(name, request):
    df = request.getfixturevalue(name)
    items = [(r["doc_id"], r["text"]) for r in df.collect()]
    best, norm = brute_exact(items)
    got = exact_dedup.exact_groups(df)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == Counter((i, *best[norm(t)], h.sha(norm(t))) for i, t in items)
    kept = Counter(r["text_sha256"] for r in got.where("kept").collect())
    assert set(kept.values()) == {1} and len(kept) == len(best)
    assert exact_dedup.exact_dedup(df).count() == len(best)


def test_exact_dedup_of_a_hot_group(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("copy of  it"), F.repeat(F.lit(" "), (F.col("id") % 5).cast("int"))).alias("text"))
    got = exact_dedup.exact_groups(df)
    assert rows(got, "keep_id", "group_size") == {(4, 2000): 2000}
    assert [r["doc_id"] for r in got.where("kept").collect()] == [4]


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_groups(h.empty(spark)).count() == 0
    assert exact_dedup.exact_dedup(h.empty(spark)).columns == h.empty(spark).columns


# ---- 3 language ID --------------------------------------------------------------------------------------------


def test_held_out_accuracy(real):
    filters = language_id.fit_filters(real.where(language_id.learnable()), "text", "lang")
    got = language_id.predict_language(real, filters).where(~language_id.learnable() & F.col("lang").isNotNull()).collect()
    assert len(got) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("name", ["docs", "real"])
def test_languages_equal_brute_force(name, request):
    """Exact n-gram sets in place of the filters: the same languages wherever two are not about alike, and the same scores."""
    df = request.getfixturevalue(name)
    items = [(r["text"], r["lang"], learn) for r, learn in ((r, r["learn"]) for r in df.withColumn("learn", language_id.learnable()).select("text", "lang", "learn").collect())]

    def grams(text):
        b = bytes(32 if c < 32 else c for c in f" {text.lower()}   ".encode())
        return [b[i : i + 4] for i in range(len(b) - 3)]

    seen, size = {}, Counter()
    for text, lang in {(t, lang) for t, lang, learn in items if learn and t is not None and lang is not None}:
        seen.setdefault(lang, Counter()).update(set(grams(text)))
        size[lang] += 1
    known = {lang: {g for g, n in c.items() if n >= 0.002 * size[lang]} for lang, c in sorted(seen.items())}
    filters = language_id.fit_filters(df.where(language_id.learnable()), "text", "lang")
    assert filters.languages == list(known)
    got = language_id.predict_language(df.select("text"), filters).collect()
    assert len(got) == len(items)
    best = {}
    for text in {t for t, _, _ in items}:
        lettered = any(c.isalpha() for c in text or "")
        g = grams(text) if lettered else []
        best[text] = sorted(((sum(x in s for x in g) / len(g), lang) for lang, s in known.items()), key=lambda x: (-x[0], x[1])) if lettered else [(0.0, "und")]
    for r in got:
        (score, lang), *rest = best[r["text"]]
        assert r["score"] == pytest.approx(score, abs=0.01)
        assert r["lang_pred"] == lang or any(x > score - 0.01 and y == r["lang_pred"] for x, y in rest)


def test_a_rare_language_is_learned_beside_a_hot_text(spark):
    rows = [("the same english text again and again", "en")] * 3000 + [(f"ein seltener satz auf deutsch nummer {i}", "de") for i in range(3)]
    filters = language_id.fit_filters(spark.createDataFrame(rows, "text string, lang string"), "text", "lang", texts_each=2)
    assert filters.languages == ["de", "en"]
    got = language_id.predict_language(spark.createDataFrame([("noch ein seltener satz",), ("some english text",)], "text string"), filters).collect()
    assert [r["lang_pred"] for r in got] == ["de", "en"]


def test_language_of_awkward_texts(docs, spark):
    filters = language_id.fit_filters(docs.where(language_id.learnable()), "text", "lang")
    got = language_id.predict_language(docs, filters)
    assert got.columns.count("score") == 1 and got.count() == docs.count()
    lettered = {r["text"]: r["lang_pred"] for r in got.collect()}
    assert lettered[None] == lettered[""] == lettered["12345 67890"] == "und" and lettered["a"] == "en"
    nothing = language_id.fit_filters(h.empty(spark), "text", "lang")
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict_language(docs, nothing).collect()} == {("und", 0.0)}
    assert language_id.predict_language(h.empty(spark), filters).count() == 0


def test_filters_return_all_languages_and_correct_false_positives():
    grams = {"a": np.arange(0, 5000, dtype=np.uint32) * 7919, "b": np.arange(4000, 9000, dtype=np.uint32) * 7919}
    f = language_id.LanguageFilters.build(["a", "b"], grams)
    masks = f.containing(np.arange(0, 9000, dtype=np.uint32) * 7919)[:, 0]
    assert (masks[4000:5000] == 3).all() and (masks[:5000] & np.uint8(1)).all() and (masks[4000:] & np.uint8(2)).all()
    assert (f.rate < 0.01).all() and (f.rate > 0).all()


# ---- 4 licence scans -------------------------------------------------------------------------------------------------


def licence_words(text):
    import regex

    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(h.LOWER))


def brute_licenses(text):
    w = licence_words(text)
    at, labels = [], set()
    for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def brute_chain(pairs):
    """The length of the longest chain that rises in both, by trying every pair as an end."""
    best = []
    for i, (x, t) in enumerate(pairs):
        best.append(1 + max((best[j] for j in range(i) if pairs[j][0] < x and pairs[j][1] < t), default=0))
    return max(best, default=0)


def brute_labels(text, templates=license_scan.TEMPLATES):
    """(labels, score) by looking at every diagonal of a phrase and at every window of a licence's text."""
    w, labels, weak, score = licence_words(text), set(), set(), 0.0
    for t in templates:
        p = licence_words(t.text)
        grams = [tuple(p[i : i + t.k]) for i in range(len(p) - t.k + 1)]
        pairs = [(i, j) for i in range(len(w) - t.k + 1) for j, q in enumerate(grams) if tuple(w[i : i + t.k]) == q]
        if t.share >= 1:
            held = max((sum(i - j == d for i, j in pairs) for d in {i - j for i, j in pairs}), default=0)
        else:
            held = max((brute_chain([x for x in pairs if a <= x[0] < a + 2 * len(p)]) for a in range(-len(p), len(w), len(p))), default=0)
        if held / len(grams) >= t.share:
            (weak if t.weak else labels).add(t.label)
            score = max(score, held / len(grams))
    return ",".join(sorted(labels or weak)), score


@pytest.mark.parametrize("name", ["docs", "real"])
def test_license_places(name, request):
    df = request.getfixturevalue(name)
    got = license_scan.scan_licenses(df)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((r["doc_id"], *brute_licenses(r["text"])) for r in df.collect())
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_license_labels_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ["all rights all rights", "all rights are rights reserved", "rights reserved, all rights", "all rights reserved", "mit license " * 50, "the software the software and to permit persons " * 30]
    for t in license_scan.TEMPLATES:
        w = t.text.split()
        for changes in (0, 1, 4, 12, 40):
            some = list(w)
            for i in rng.integers(0, len(w), changes):
                some[i] = ["", "kindly", some[i] + " or so", some[int(rng.integers(0, len(w)))]][int(rng.integers(0, 4))]
            texts.append("before " + " ".join(some) + " after " + " ".join(rng.permutation(w)[:40]) + " " + " ".join(w[: len(w) // 2]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(df).collect()}
    assert got == {i: brute_labels(t) for i, t in enumerate(texts)}
    assert [got[i][0] for i in range(4)] == ["", "", "", "proprietary"] and sum(bool(x) for x, _ in got.values()) > 40


def test_license_text_survives_a_changed_word(spark):
    text = next(t for t in license_scan.TEMPLATES if t.k == 4 and t.label == "mit").text.replace("charge, to any", "charge kindly to any")
    df = spark.createDataFrame([(1, f"before {text} after"), (2, "permission is hereby granted")], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(df).collect()} == {1: "mit", 2: ""}


BSD3 = """Copyright (c) 2019, Some Holder
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,
STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE."""


def test_licences_as_projects_word_them(spark):
    text = {t.label: t.text for t in reversed(license_scan.TEMPLATES) if t.k == 4}
    mit = text["mit"]
    middle = mit.replace("subject to the following conditions:", "subject to the following conditions, which our lawyers have asked us to put before you in a plain and friendly way:")
    old = BSD3.replace("the copyright holder nor the names of its", "the University nor the names of its").replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR")
    variants = {
        1: (BSD3, "bsd"), 2: (old, "bsd"), 3: ("All rights reserved. " + mit, "mit"), 4: (middle, "mit"),
        5: (mit + " " + text["x11"].replace("X Consortium", "authors"), "mit,x11"), 6: (mit + "\n" + BSD3, "bsd,mit"), 7: ("all rights all rights", ""), 8: ("All rights reserved.", "proprietary"),
        9: (" ".join(reversed(mit.split())), ""), 10: (" filler ".join(mit.split()), ""), 11: (mit[: len(mit) // 2], ""), 12: ("preface " * 5000 + mit + " tail" * 5000, "mit"),
        13: ("\n".join("// " + line for line in mit.split("\n")), "mit"), 14: ("Apache License Version 2.0, January 2004 " + text["apache"], "apache"),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in variants.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(df).collect()} == {i: labels for i, (_, labels) in variants.items()}
    places = license_scan.find_spans(df.where("doc_id in (6, 12)")).where("share > 0.9").collect()
    assert {(r["doc_id"], license_scan.TEMPLATES[r["template"]].label) for r in places} == {(6, "mit"), (6, "bsd"), (6, "proprietary"), (12, "mit")}  # the scan still finds the phrase
    (far,) = [r for r in places if r["doc_id"] == 12]
    assert (far["first"], far["last"]) == (5000, 5000 + len(licence_words(mit)) - 1)


def test_chains_rise_in_text_and_template():
    assert license_scan.rising_chain([]) == []
    assert license_scan.rising_chain([(0, 9), (1, 0), (2, 1), (3, 2)]) == [(1, 0), (2, 1), (3, 2)]  # an early outlier drops nothing
    assert len(license_scan.rising_chain([(0, 0), (0, 1), (0, 2), (1, 1)])) == 2
    rng = np.random.default_rng(1)
    for _ in range(50):
        pairs = [tuple(x) for x in rng.integers(0, 12, (15, 2)).tolist()]
        chain = license_scan.rising_chain(pairs)
        assert len(chain) == brute_chain(sorted(pairs)) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:])) and set(chain) <= set(pairs)


def test_license_scan_of_nothing(spark):
    assert license_scan.scan_licenses(h.empty(spark)).count() == 0


# ---- 5 n-gram Jaccard ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("name", ["docs", "real"])
def test_near_duplicates_equal_all_pairs(name, width, percent, request):
    df = request.getfixturevalue(name)
    items = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = h.linked([t for _, t in items], width, percent)
    ids = {}
    for (i, t), (n, root) in zip(items, want):
        if i is not None and (root not in ids or i < ids[root]):
            ids[root] = i
    got = ngram_jaccard.near_duplicates(df, width, percent)
    assert rows(got, "doc_id", "n_shingles", "component_id") == Counter((i, n, ids.get(root)) for (i, _), (n, root) in zip(items, want))
    assert ngram_jaccard.near_dedup(df, width, percent).count() == len({root for _, root in want})


def test_chain_of_near_copies_is_one_component(spark):
    w = [f"t{i}" for i in range(120)]
    texts = []
    for step in range(30):
        w = w[:step] + [f"u{step}"] + w[step + 1 :]
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(ngram_jaccard.near_duplicates(df, 3, 90), "component_id") == {(0,): 30}


def test_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(0)
    base = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(300):
        w = list(base)
        for j in rng.integers(0, 150, rng.integers(0, 6)):
            w[j] = f"v{rng.integers(0, 400)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = h.linked(texts, 3, 90)
    assert rows(ngram_jaccard.near_duplicates(df, 3, 90), "doc_id", "component_id") == Counter((i, r) for i, (_, r) in enumerate(want))


def test_opening_groups_finds_every_link():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    side = lambda part: (np.array([i for i, _ in part]), np.array([len(s) for _, s in part]), np.concatenate([s for _, s in part]))
    left, right = list(enumerate(sets))[:20], list(enumerate(sets))[20:]
    for percent in (40, 50, 60):
        pairs = {(i, j) for i, a in left for j, b in right if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))}
        links = ngram_jaccard.open_groups(percent, side(left), side(right))
        assert set(links) <= pairs
        find = lambda edges: sorted(map(sorted, _classes(40, edges)))
        assert find(links) == find(pairs)


def test_bounds_let_every_link_through():
    rng = np.random.default_rng(6)
    draw = lambda n, most: [np.unique(rng.integers(0, most, rng.integers(10, 60)).astype(np.uint64)) for _ in range(n)]
    queries, others = draw(20, 90) + draw(10, 40), draw(20, 40)
    for percent in (20, 40, 60):
        good = ngram_jaccard.through_bound(percent, np.array([len(q) for q in queries]), np.concatenate(queries), np.unique(np.concatenate(others)), min(map(len, others)))
        linked = [any(100 * len(np.intersect1d(q, d)) >= percent * len(np.union1d(q, d)) for d in others) for q in queries]
        assert (good >= linked).all()
    assert any(linked) and not good.all()


@pytest.mark.parametrize("name", ["docs", "real"])
def test_near_pairs_are_all_pairs(name, request):
    df = request.getfixturevalue(name)
    sets = [h.shingles(r["text"], 3) for r in df.collect()]
    want = Counter(sum(bool(a) and i != j and 100 * len(a & b) >= 60 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets))
    pairs, members = ngram_jaccard.near_pairs(df, 3, 60)
    got = members.collect()
    assert Counter(r["links"] for r in got) == want and len(got) == len(sets)
    copies, partners = Counter(r["class"] for r in got), Counter()
    for r in pairs.collect():
        assert r["class_a"] < r["class_b"]
        partners[r["class_a"]] += copies[r["class_b"]]
        partners[r["class_b"]] += copies[r["class_a"]]
    assert all(r["links"] == (partners[r["class"]] + copies[r["class"]] - 1 if r["n_shingles"] else 0) for r in got)


def _classes(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    out = {}
    for i in range(n):
        out.setdefault(find(i), []).append(i)
    return out.values()


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert {v: r for v, r in got.items()} == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}


def test_components_say_when_they_are_not_at_rest(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components(path, rounds=1)


def test_near_duplicates_of_nothing(spark):
    assert all(x.count() == 0 for x in ngram_jaccard.near_pairs(h.empty(spark)))
    assert ngram_jaccard.near_duplicates(h.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " ")], "doc_id long, text string")
    assert rows(ngram_jaccard.near_duplicates(blank), "doc_id", "n_shingles", "component_id") == {(1, 0, 1): 1, (2, 0, 2): 1, (3, 0, 3): 1}


# ---- 6 packing -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["docs", "real"])
def test_pieces_hold_each_id_once(name, request):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    coded = Counter()
    for r in df.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        coded[(r["doc_id"], ids.tobytes())] += 1
    pieces = packing.pack_documents(df, packing.tokenizer_path()).orderBy("sequence_id").collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    got, held = Counter(), b""
    for p in pieces:
        assert p["length"] == 1 << p["bucket"] <= 4096 and p["offset"] == 0 and len(p["ids"]) == 4 * p["length"]
        assert p["start"] * 4 == len(held)
        held += p["ids"]
        if len(held) == 4 * p["doc_tokens"]:
            got[(p["doc_id"], held)] += 1
            held = b""
    assert got == coded


def test_piece_lengths_are_binary_digits():
    assert packing.piece_lengths(13, 4096) == [8, 4, 1]
    assert packing.piece_lengths(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1]


def test_small_word_table_gives_the_same_ids():
    texts = pa.array(["Hello world. Éa, it's", "world hello?! <|endoftext|> A.B", "", None, "x" * 300 + ". é. ×. …."])
    small, large = packing.WordEncoder(packing.tokenizer_path(), limit=2), packing.WordEncoder(packing.tokenizer_path())
    for _ in range(2):
        a, b = small.encode(texts, 2), large.encode(texts, 2)
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    want = [i for t in texts.to_pylist() for i in [*large.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]]
    assert a[0].tolist() == want


def test_packing_of_nothing(spark):
    assert packing.pack_documents(h.empty(spark), packing.tokenizer_path()).count() == 0


# ---- 7 substring dedup ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [5, 35])
@pytest.mark.parametrize("name", ["docs", "real"])
def test_repeated_windows_go(name, width, request):
    df = request.getfixturevalue(name)
    items = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = Counter((i, *w) for (i, _), w in zip(items, h.without_repeats([t for _, t in items], width)))
    assert rows(substring_dedup.substring_dedup(df, width), "doc_id", "n_words", "n_removed", "kept_text") == want


def test_substring_dedup_across_many_batches(spark):
    texts = [" ".join(f"d{i}w{j}" for j in range(20)) + (" shared passage of seven plain words here" if i % 3 == 0 else "") for i in range(1200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(df, 6).collect()}
    assert all(got[i] == (7 if i % 3 == 0 else 0) for i in range(1200))


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.substring_dedup(h.empty(spark)).count() == 0


# ---- 8 top-k --------------------------------------------------------------------------------------------------------------------------------


def brute_top(items, every=50, k=5):
    vectors = []
    for n, (i, v) in enumerate(items):
        if v and all(x is not None and np.isfinite(x) for x in v):
            vectors.append((n, i, np.floor(256 * np.array(v, float)).astype(object)))
    out = []
    for n, i, q in vectors:
        if i is not None and i % every == 0:
            found = sorted((-int(q @ v), j is None, j, m) for m, j, v in vectors if m != n and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, _, j, _) in enumerate(found)]
    return Counter(out)


def test_top_products_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    items = [(int(i), [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(3000)]
    items += [(0, items[0][1]), (50, None), (100, [None] * 24), (150, [float("nan")] * 24), (200, [float("inf")] * 24), (250, []), (300, [1.0, 2.0]), (7, [0.5, 0.5]), (9, [0.0] * 24), (9, [0.0] * 24)]
    df = spark.createDataFrame(items, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    assert rows(vector_topk.top_products(df), "query_id", "rank", "vec_id", "score") == brute_top(items)


def test_floors_lose_nothing(spark, monkeypatch):
    """All vectors drawn, ties at the floor, and queries with fewer vectors than asked for."""
    rng = np.random.default_rng(9)
    items = [(i, [float(x) for x in rng.integers(0, 3, 4) / 4]) for i in range(400)] + [(1000, [1.0, 2.0]), (1050, [2.0, 1.0])]
    df = spark.createDataFrame(items, "vec_id long, embedding array<float>")
    for drawn in (1, 1_000_000):
        monkeypatch.setattr(vector_topk, "DRAWN", drawn)
        assert rows(vector_topk.top_products(df), "query_id", "rank", "vec_id", "score") == brute_top(items)


def test_bounds_never_undercut():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(40, 64)) * 100, rng.normal(size=(50, 64)) * 100
    sa, sb = vector_topk.SegmentStatistics(a), vector_topk.SegmentStatistics(b)
    exact, last = a @ b.T, None
    for level in range(3):
        upper = sa.upper(sb, level, np.arange(40), np.arange(50))
        assert (upper >= exact).all()
        assert last is None or upper.mean() < last
        last = upper.mean()


@pytest.mark.parametrize("big", [1e17, 4e7])
def test_products_that_do_not_fit_are_refused(spark, big):
    df = spark.createDataFrame([(50, [big] * 4096), (1, [1.0] * 4096)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        vector_topk.top_products(df)
    assert vector_topk.top_products(df.withColumn("embedding", F.transform("embedding", lambda x: x / big))).count() == 1


def test_top_products_of_nothing(spark):
    assert vector_topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- 9 LM scoring -------------------------------------------------------------------------------------------------------------------------------


def brute_scores(items, target):
    """Both models counted anew for each text, without it."""
    low = [[w.translate(h.LOWER) for w in h.words(t)] for _, t in items]
    chosen = [i in target and i is not None for i, _ in items]
    pairs = [list(zip([None, *w], w)) for w in low]

    def counts(which):
        uni, pair, lead = Counter(), Counter(), Counter()
        for w, q, c in zip(low, pairs, which):
            if c:
                uni.update(w)
                pair.update(q)
                lead.update([None] * bool(w))
        return uni, pair, lead

    every, good = counts([True] * len(items)), counts(chosen)
    out = []
    for w, q, mine in zip(low, pairs, chosen):
        uni, pair = Counter(w), Counter(q)
        total, mass = every[0].total() - len(w), good[0].total() - len(w) * mine
        losses = []
        for (u, b, lead), off, by in ((good, mine, 1.0), (every, True, mass / max(total, 1))):
            loss = 0.0
            for v, x in q:
                prior = (every[0][x] - uni[x] + lm_scoring.OPEN_WEIGHT / lm_scoring.OPEN_WORDS) / (total + lm_scoring.OPEN_WEIGHT)
                one = ((u[x] - uni[x] * off) * by + lm_scoring.PRIOR * prior) / (mass + lm_scoring.PRIOR)
                before = (lead[None] - off) if v is None else (u[v] - uni[v] * off)
                loss -= np.log(((b[v, x] - pair[v, x] * off) * by + lm_scoring.BACKOFF * one) / (before * by + lm_scoring.BACKOFF))
            losses.append(loss / max(len(w), 1))
        out.append((len(w), *losses))
    return out


@pytest.mark.parametrize("name", ["docs", "real"])
def test_scores_equal_brute_force(name, request, spark):
    df = request.getfixturevalue(name)
    items = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    target = {i for i, _ in items if i is not None and i % 3 == 1}
    got = lm_scoring.score_documents(df, spark.createDataFrame([(i,) for i in target] * 2, "doc_id long")).orderBy("rid").collect()
    for r, (i, _), w in zip(got, items, brute_scores(items, target)):
        assert (r["doc_id"], r["n_words"]) == (i, w[0])
        assert (r["target_loss"], r["background_loss"]) == pytest.approx(w[1:], rel=1e-9)
        assert r["score"] == pytest.approx(w[1] - w[2], abs=1e-9)


def test_a_text_is_not_scored_by_itself(spark):
    """Texts that occur twice stand out, and a target's only text does not score as the target does."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*texts, *texts[:10]])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(df, spark.createDataFrame([(i,) for i in range(20, 40)], "doc_id long")).collect()}
    assert max(got[i]["background_loss"] for i in [*range(10), *range(60, 70)]) < min(got[i]["background_loss"] for i in range(10, 60))
    assert abs(np.mean([got[i]["score"] for i in range(20, 40)]) - np.mean([got[i]["score"] for i in range(40, 60)])) < 0.3  # by itself it would be over 2


def test_batches_do_not_depend_on_pieces(spark, monkeypatch):
    from hazardloom.llm import blobs

    monkeypatch.setattr(blobs, "BATCH_BYTES", 50)
    monkeypatch.setattr(blobs, "BATCH_ROWS", 4)
    texts = pa.array(["x" * n for n in (10, 45, 200, 0, 0, 0, 0, 0, 3, 60, 20, 20, 20)])
    rids = pa.array(range(len(texts)), pa.int64())
    seen = set()
    for step in (1, 2, 5, 13):
        pieces = [pa.RecordBatch.from_arrays([rids.slice(i, step), texts.slice(i, step)], names=["rid", "text"]) for i in range(0, len(texts), step)]
        seen.add(tuple((n, tuple(t.column("rid").to_pylist())) for n, t in blobs.whole_batches(iter(pieces), 0, 1)))
    assert seen == {((0, (0,)), (1, (1,)), (2, (2,)), (3, (3, 4, 5, 6)), (7, (7, 8)), (9, (9,)), (10, (10, 11)), (12, (12,)))}


def test_windows_of_one_key_are_told_apart():
    key, check = np.array([5, 7, 5, 5, 7], np.uint64), np.array([1, 2, 3, 1, 2], np.uint32)
    order, first = substring_dedup._sorted_windows(key, check)
    assert key[order].tolist() == [5, 5, 5, 7, 7] and check[order].tolist() == [1, 1, 3, 2, 2] and first.tolist() == [True, False, True, True, False]


def test_scoring_without_target_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.score_documents(docs, none).count() == docs.count()
    assert lm_scoring.score_documents(h.empty(spark), none).count() == 0


# ---- 10 piece coding ----------------------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return piece_coding.PieceModel(piece_coding.model_path())


@pytest.mark.parametrize("name", ["docs", "real"])
@pytest.mark.parametrize("chunk", [piece_coding.CHUNK, 200])
def test_coding_round_trip(name, chunk, request, model):
    df = request.getfixturevalue(name)
    coded = piece_coding.decode_documents(piece_coding.encode_documents(df, piece_coding.model_path(), chunk=chunk), piece_coding.model_path()).collect()
    texts, scores, parts = {}, {}, {}
    for r in sorted(coded, key=lambda r: (r["rid"], r["chunk"])):
        assert r["decoded"] == r["text"]
        texts[r["rid"]] = texts.get(r["rid"], "") + r["text"]
        scores[r["rid"]] = scores.get(r["rid"], 0.0) + r["score"]
        parts.setdefault(r["rid"], []).append(r["chunk"])
        assert len(parts[r["rid"]]) <= r["chunks"]
    want = [model.normal(r["text"] or "") for r in df.collect()]
    assert Counter(texts.values()) == Counter(want)
    by_text = {t: s for t, s in zip(want, model.encode_batch(want)[2])}
    for rid, t in texts.items():
        assert scores[rid] == pytest.approx(by_text[t], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("chunk", [piece_coding.CHUNK, 8])
def test_round_trip_is_against_the_text_itself(spark, chunk, model):
    """Texts that hold the blank's own mark normalise to what others do, and cannot come back."""
    texts = ["a b", "a▁b", "  two  blanks ", "▁", "", None, "漢字 😀 end", "many words in a row " * 9, "many words in▁a row " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in piece_coding.round_trips(df, piece_coding.model_path(), chunk=chunk).collect():
        got.setdefault(r["doc_id"], []).append((r["chunk"], r["chunks"], r["round_trip"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: [(c, len(got[i]), "▁" not in (t or "")) for c in range(len(got[i]))] for i, t in enumerate(texts)}
    plain, ids = {}, {}
    for r in sorted(piece_coding.decode_documents(piece_coding.encode_documents(df, piece_coding.model_path(), chunk=chunk), piece_coding.model_path()).collect(), key=lambda r: r["chunk"]):
        plain[r["doc_id"]] = plain.get(r["doc_id"], "") + r["restored"]
        ids[r["doc_id"]] = ids.get(r["doc_id"], []) + np.frombuffer(r["ids"], "<u4").tolist()
    assert plain == {i: model.processor.decode(x) for i, x in ids.items()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}


@pytest.mark.parametrize("name", ["docs", "real"])
@pytest.mark.parametrize("chunk", [piece_coding.CHUNK, 200])
def test_ids_are_the_library_s(name, chunk, request, model):
    df = request.getfixturevalue(name)
    got, parts = {}, {}
    for r in sorted(piece_coding.encode_documents(df, piece_coding.model_path(), chunk=chunk, own=True).collect(), key=lambda r: (r["rid"], r["chunk"])):
        got[r["rid"]] = (r["doc_id"], got.get(r["rid"], (0, b""))[1] + r["ids"])
        parts.setdefault(r["rid"], []).append((r["chunk"], r["chunks"]))
    assert all(x == [(c, len(x)) for c in range(len(x))] for x in parts.values())
    assert Counter(got.values()) == Counter((r["doc_id"], np.array(model.processor.encode(r["text"] or ""), "<u4").tobytes()) for r in df.collect())


def test_registered_coding_has_the_library_s_counts(spark, sf_dir, real, model):
    got = Counter()
    for r in piece_coding.op10_piece_coding(spark, sf_dir).collect():
        got[r["doc_id"]] += r["n_ids"]
    want = Counter()
    for r in real.collect():
        want[r["doc_id"]] += len(model.processor.encode(r["text"] or ""))
    assert got == want


def test_chunks_of_merges_begin_where_no_piece_spans():
    m = piece_coding.MergeModel(piece_coding.model_path())
    for text in (m.normal("the quick brown fox " * 9), m.normal("e" * 50 + " ab" * 30), "a", ""):
        pieces = m.chunks(text, 16)
        assert len(pieces) == max(1, -(-len(text) // 16)) and "".join(x for _, x in pieces) == text
        assert [i for _, x in pieces for i in m.merger.encode(x)] == m.merger.encode(text)


def test_coding_is_the_best_path(model):
    """The library's own lattice search (the model read as a unigram one) finds no better sum of scores for single words."""
    from sentencepiece import SentencePieceProcessor

    with open(piece_coding.model_path(), "rb") as f:
        unigram = SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")
    for word in "the with hello wonderful interesting segmentation elephants naturally tionou stingung éléphant".split():
        ids, _, scores = model.encode_batch([model.normal(word)])
        best = unigram.nbest_encode_as_ids(word, 2)[0]
        total = lambda q: sum(model.scores[unigram.id_to_piece(int(i))] for i in q)
        assert total(ids) == scores[0] >= total(best)
        assert model.trace(model.normal(word), 0, len(model.normal(word)))[1] == scores[0]


def test_max_plus_products_are_associative():
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(size=(3, 6, 6))
    assert piece_coding.max_plus(piece_coding.max_plus(a, b), c) == pytest.approx(piece_coding.max_plus(a, piece_coding.max_plus(b, c)))


def test_unit_table_survives_repeats(model):
    m = piece_coding.PieceModel(piece_coding.model_path())
    m.learn(["ab", "cd", "ab"])
    m.learn(["ef", "gh", "cd"])
    for u in ("ab", "cd", "ef", "gh"):
        k = m.memo[u]
        assert m.flat[m.first[k] : m.first[k] + m.count[k]].tolist() == m.trace(u, 0, 2)[0]


def with_field(path, field, body, to):
    """A copy of a model file with one more field of a submessage (protocol buffers merge them)."""
    size, x = [], len(body)
    while x > 127:
        size.append(x & 127 | 128)
        x >>= 7
    with open(path, "rb") as f:
        raw = f.read()
    with open(to, "wb") as f:
        f.write(raw + bytes([field << 3 | 2, *size, x]) + body)
    return str(to)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The model's pieces and ranks read as a unigram model: many of its sums are equal."""
    return with_field(piece_coding.model_path(), 2, b"\x18\x01", tmp_path_factory.mktemp("model") / "unigram.model")


@pytest.mark.parametrize("own", [True, False])
def test_texts_that_normalising_lengthens_are_coded(spark, own, tmp_path):
    import sentencepiece

    nfkc = sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto()
    spec = next(v for n, v in piece_coding._fields(nfkc) if n == 3)
    path = with_field(piece_coding.model_path(), 3, next(b"\x12" + _length(v) + v for n, v in piece_coding._fields(spec) if n == 2), tmp_path / "m.model")
    assert piece_coding.maps_characters(path)
    texts = ["…" * 100, "words", "… words " * 100, "…" * 66]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sorted(piece_coding.encode_documents(df, path, chunk=200, own=own).collect(), key=lambda r: r["chunk"]):
        got[r["doc_id"]] = got.get(r["doc_id"], "") + r["text"]
    assert got == {i: sentencepiece.SentencePieceProcessor(model_file=path).normalize(t) for i, t in enumerate(texts)}
    assert len(got[0]) > 250


def _length(body):
    out, x = [], len(body)
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes([*out, x])


def whole_ids(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["rid"], r["chunk"])):
        got[r["rid"]] = (r["doc_id"], got.get(r["rid"], (0, b""))[1] + r["ids"])
    return Counter(got.values())


def brute_path(m, text):
    """Ids of the best sum, with the longest last piece of equals, by trying every piece at every place."""
    best, back = [0.0] + [float("-inf")] * len(text), [0] * (len(text) + 1)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - m.reach), j):
            score = m.scores.get(text[i:j], m.unknown if j - i == 1 else float("-inf"))
            if best[i] + score > best[j]:
                best[j], back[j] = best[i] + score, i
    out, j = [], len(text)
    while j:
        out = m.ids_of(text[back[j] : j]) + out
        j = back[j]
    return out


@pytest.mark.parametrize("name", ["docs", "real"])
def test_ids_do_not_depend_on_chunks(name, request, model):
    df = request.getfixturevalue(name)
    df = df.where("length(text) < 4000 or text is null")
    if name == "docs":
        df = df.select("doc_id", "text").union(df.sparkSession.createDataFrame([(77, "a" * 900 + " some words of it " * 90 + "b" * 400)], "doc_id long, text string"))
    path = piece_coding.model_path()
    want = Counter((r["doc_id"], np.array(brute_path(model, model.normal(r["text"] or "")), "<u4").tobytes()) for r in df.collect())
    for chunk in (100, 700, piece_coding.CHUNK):
        assert whole_ids(piece_coding.encode_documents(df, path, chunk=chunk)) == want


def test_unigram_sums_are_no_less_than_the_library_s(spark, real, unigram):
    """Whole texts in unigram mode: no path that the library finds has a better sum of scores."""
    from sentencepiece import SentencePieceProcessor

    library, m = SentencePieceProcessor(model_file=unigram), piece_coding.PieceModel(unigram)
    assert not piece_coding.merges(unigram)
    df = real.where("length(text) < 1500").limit(60)
    coded = piece_coding.encode_documents(df, unigram, chunk=150, own=True).collect()
    ids, score = {}, {}
    for r in sorted(coded, key=lambda r: (r["doc_id"], r["chunk"])):
        ids[r["doc_id"]] = ids.get(r["doc_id"], []) + np.frombuffer(r["ids"], "<u4").tolist()
        score[r["doc_id"]] = score.get(r["doc_id"], 0.0) + r["score"]
    same = 0
    for r in df.collect():
        theirs = library.encode(r["text"])
        if not any(library.is_byte(i) or library.is_unknown(i) for i in theirs):  # characters without a piece have no score there
            assert score[r["doc_id"]] >= sum(m.scores[library.id_to_piece(i)] for i in theirs)
            assert score[r["doc_id"]] == sum(m.scores[library.id_to_piece(i)] for i in ids[r["doc_id"]])
            same += 1
    assert same > 5


def test_products_by_pairs_and_states_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(piece_coding, "BLOCK", 3)
    rng = np.random.default_rng(4)
    matrices = [rng.normal(size=(5, 5)) for _ in range(11)]
    left = matrices[0]
    for m in matrices[1:]:
        left = piece_coding.max_plus(left, m)
    assert piece_coding.product(matrices) == pytest.approx(left)
    states, sure = piece_coding.boundary_states(matrices)
    assert sure and sum(m[a, b] for m, a, b in zip(matrices, states, states[1:])) == pytest.approx(left[0, 0])
    assert not piece_coding.boundary_states([np.zeros((2, 2))] * 3)[1]
    df = spark.createDataFrame([(1, i, bytearray(m.tobytes())) for i, m in enumerate(matrices)] + [(2, 0, bytearray(matrices[0].tobytes()))], "rid long, chunk int, matrix binary")
    got = {(r["rid"], r["chunk"]): (r["entry"], r["exit"], r["sure"]) for r in piece_coding.chunk_states(df).collect()}
    assert got == {(1, i): (*states[i : i + 2], True) for i in range(11)} | {(2, 0): (0, 0, True)}


def test_coding_of_nothing(spark):
    assert piece_coding.encode_documents(h.empty(spark), piece_coding.model_path()).count() == 0
