import os
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import helpers as h  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from hazardloom.llm import language_id, queries  # noqa: E402
from hazardloom.llm.common import cut  # noqa: E402


def test_queries_equal_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        assert Counter(tuple(r[c] for c in order) for r in got.collect()) == Counter(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), name


def brute_packed(texts):
    """(doc_id, start, ids) of all pieces of the texts by the tokenizer itself."""
    from tokenizers import Tokenizer

    from hazardloom.llm import packing

    tokenizer, out = Tokenizer.from_file(packing.tokenizer_path()), Counter()
    for i, t in texts.items():
        ids, start = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n in packing.piece_lengths(len(ids), 4096):
            out[i, start, np.array(ids[start : start + n], "<u4").tobytes()] += 1
            start += n
    return out


def test_stages_follow_each_other(spark, sf_dir, tmp_path):
    """Every stage, and ``run`` from end to end, against brute force."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, left = [docs.count()], None
    for number, (name, stage) in enumerate(cp.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()] if number < 4 else None
        out = stage(spark, docs, sf_dir)
        if number < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r["doc_id"]: r["text"] for r in docs.collect()} if number < 4 else None
        if name == "language_id":
            found = language_id.predict_language(spark.read.parquet(f"{sf_dir}/documents.parquet"), language_id.fit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet").where(language_id.learnable()), "text", "lang"))
            assert set(after) == {r["doc_id"] for r in found.collect() if r["lang_pred"] != "und" and r["score"] >= cp.LEAST_COVER}
        if name == "exact_dedup":
            norm = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
            best = {}
            for i, t in before:
                best[norm(t)] = min(best.get(norm(t), (0, i)), (-len(t), i))
            assert set(after) == {i for _, i in best.values()}
        if name == "ngram_jaccard":
            want = h.linked([t for _, t in before], 5, 80)
            first = {}
            for (i, _), (_, root) in zip(before, want):
                first[root] = min(i, first.get(root, i))
            assert set(after) == set(first.values())
        if name == "substring_dedup":
            want = {i: k if gone else t for (i, t), (n, gone, k) in zip(before, h.without_repeats([t for _, t in before], 35)) if not n or gone < n}
            assert after == want
            left = after
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] > seen[3] > 0
    pieces = cp.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in pieces) == brute_packed(left)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] for r in pieces)


def test_a_run_leaves_one_stage_s_files(spark, sf_dir):
    from hazardloom.llm import common

    since = common.written()
    cp.run(spark, sf_dir)
    assert common.written() == since + 1


def test_threads_settle_only_their_own_files(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from hazardloom.llm import common

    met = Barrier(2)

    def run(i):
        since = common.written()
        first = cut(spark.range(i, i + 3).toDF("x"))
        met.wait(60)
        kept = common.settle(first.where("x >= 0"), since)
        met.wait(60)
        return sorted(r[0] for r in kept.collect()), common.written() - since

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, (0, 10))) == [([0, 1, 2], 1), ([10, 11, 12], 1)]


def test_pipeline_of_awkward_documents(spark):
    docs = h.awkward(spark)
    for number, (_, stage) in enumerate(cp.STAGES):
        docs = cut(stage(spark, docs, ""))
        if number == 0:
            assert all(r["text"] and r["text"].strip() for r in docs.collect())
    assert docs.count() > 0


@pytest.mark.parametrize("number", range(5))
def test_stages_of_nothing(number, spark):
    assert cp.STAGES[number][1](spark, h.empty(spark), "").count() == 0


@pytest.mark.parametrize("name", ["op1_sharding", "op2_exact_dedup", "op12_spelling_variants", "op13_fill_in_middle"])
def test_native_operators_run_no_python(name, spark, sf_dir):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "BatchEval"))


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
