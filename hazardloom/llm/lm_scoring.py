"""LM scoring by cross-entropy difference.

A target and a background bigram model of the same form share one vocabulary, that of the corpus, and are matched:
the background's counts, those of all rows, are scaled to the target's number of words, so the same smoothing weighs
alike in both. A text's score is the mean over its words of the target's loss minus the background's. No text is scored by
itself: its own counts are taken off both models first. All counts cover whole texts of all rows; they meet by hash
range (:mod:`blobs`), and each batch gets back the counts of just its own words and word pairs, so no task holds a whole model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import batched, bucket_count, bucket_edges, first_of_runs, from_planes, one_array, pack_sorted, planes, small_batches, unpack_sorted
from .common import numbered
from .text_arrays import ascii_lower, mix, spaces, text_bytes, word_hashes, word_spans

#: the pseudo-word before a text's first word, and the key that counts all words
START, ALL = np.uint64(0x5851F42D4C957F00), np.uint64(0x14057B7EF7678100)
#: keys keep 56 bits, a byte less to shuffle; two of a billion keys share one with odds of one in a hundred million each
KEY_BITS = np.uint64(0xFFFFFFFFFFFFFF00)
#: pseudo-counts of the shared unigram prior, and of a model's unigrams in its bigrams
PRIOR, BACKOFF = 100.0, 4.0
#: the vocabulary is open: the prior gives this much weight to as many words that were never seen, each alike
OPEN_WEIGHT, OPEN_WORDS = 1.0, float(1 << 20)


def _pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words before them, pair keys, words before each text)."""
    flat, offsets = text_bytes(texts)
    flat = ascii_lower(flat)
    starts, ends, bounds = word_spans(~spaces(flat), offsets)
    word = word_hashes(flat, starts, ends) & KEY_BITS
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = START
    return word, before, mix(before * np.uint64(0x2545F4914F6CDD1D) + word) & KEY_BITS, bounds


def _distinct(word: np.ndarray, before: np.ndarray, pair: np.ndarray, opens: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys of a batch with their counts over all words and over chosen ones."""
    keys = np.concatenate([word, pair, before[before == START], np.full(len(word), ALL)])
    mine = np.concatenate([chosen, chosen, chosen[before == START], chosen])
    order = np.argsort(keys, kind="stable")
    keys, mine = keys[order], mine[order]
    first = np.flatnonzero(first_of_runs(keys))
    chosen_count = np.add.reduceat(mine, first, dtype=np.uint32) if len(first) else np.zeros(0, np.uint32)
    return keys[first], np.diff(np.append(first, len(keys))).astype(np.uint32), chosen_count


def _in_order(table: pa.Table) -> tuple[pa.Table, pa.Array]:
    table = table.combine_chunks().sort_by("rid") if table.num_rows > 1 else table
    return table, one_array(table, "text")


def _send(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[list] = [[], [], [], [], []]
        if left.num_rows:
            left, texts = _in_order(left)
            batch = left.column("batch")[0].as_py()
            word, before, pair, bounds = _pairs(texts)
            target = np.isin(left.column("rid").to_numpy(), right.column("t_rid").to_numpy())
            keys, count, chosen = _distinct(word, before, pair, len(texts), np.repeat(target, np.diff(bounds)))
            edges = bucket_edges(keys, buckets)
            rows = [[-1], [batch], [b""], [b""], [np.packbits(target).tobytes()]]  # which rows are the target's passes by the counting
            for b in np.flatnonzero(np.diff(edges)):
                x = slice(edges[b], edges[b + 1])
                for column, value in zip(rows, (int(b), batch, pack_sorted(keys[x]), planes(count[x]), planes(chosen[x]))):
                    column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "batch", "keys", "counts", "chosen"])

    return run


def _total(table: pa.Table) -> pa.Table:
    """For each blob: the corpus and target counts of its keys, in its order."""
    if table.column("bucket")[0].as_py() < 0:
        return table.select(["batch", "bucket", "counts", "chosen"])
    parts = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    every = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    del parts
    order = np.argsort(every)
    first = np.flatnonzero(first_of_runs(every[order]))
    runs = np.diff(np.append(first, len(every)))
    answers = []
    for name in ("counts", "chosen"):
        n = np.concatenate([from_planes(x, np.uint32) for x in table.column(name).to_pylist()]).astype(np.int64)
        total = np.empty(len(n), np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], first), runs)
        answers.append([planes(total[z - s : z]) for s, z in zip(sizes, np.cumsum(sizes))])
    return pa.table([table.column("batch"), table.column("bucket"), pa.array(answers[0], pa.binary()), pa.array(answers[1], pa.binary())], names=["batch", "bucket", "counts", "chosen"])


def _own(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each entry's key is in its own row."""
    _, back, count = np.unique(row * (int(key.max()) + 1) + key, return_inverse=True, return_counts=True)
    return count[back].astype(np.float64)


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    left, texts = _in_order(left)
    word, before, pair, bounds = _pairs(texts)
    n_words = np.diff(bounds)
    losses = [np.zeros(len(texts)), np.zeros(len(texts))]
    if len(word):
        keys, _, _ = _distinct(word, before, pair, len(texts), np.zeros(len(word), bool))
        right = right.combine_chunks().sort_by("bucket")
        buckets, counts, chosen = (right.column(c).to_pylist() for c in ("bucket", "counts", "chosen"))
        mine = np.unpackbits(np.frombuffer(chosen[0], np.uint8), count=len(texts)).astype(np.float64)  # the flags come first
        corpus, target = (np.concatenate([from_planes(x, np.int64) for x, b in zip(c, buckets) if b >= 0]).astype(np.float64) for c in (counts, chosen))
        row = np.repeat(np.arange(len(texts)), n_words)
        w, v, p = (np.searchsorted(keys, x) for x in (word, before, pair))
        every, own_w, own_p, flag = np.searchsorted(keys, ALL), _own(row, w), _own(row, p), mine[row]
        own_v = np.where(before == START, 1.0, np.concatenate([[0.0], own_w[:-1]]))
        size = n_words[row].astype(np.float64)
        total, mass = corpus[every] - size, target[every] - size * flag
        prior = (corpus[w] - own_w + OPEN_WEIGHT / OPEN_WORDS) / (total + OPEN_WEIGHT)
        scale = mass / np.maximum(total, 1.0)
        for loss, n, off, by in zip(losses, (target, corpus), (flag, 1.0), (1.0, scale)):
            unigram = ((n[w] - own_w * off) * by + PRIOR * prior) / (mass + PRIOR)
            bigram = ((n[p] - own_p * off) * by + BACKOFF * unigram) / ((n[v] - own_v * off) * by + BACKOFF)
            sums = np.zeros(len(word) + 1)
            np.cumsum(-np.log(bigram), out=sums[1:])
            loss += (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n_words, 1)
    return pa.table({"rid": left.column("rid"), "doc_id": left.column("doc_id"), "n_words": pa.array(n_words), "target_loss": losses[0], "background_loss": losses[1]})


def score_documents(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: rid, doc_id, n_words, target_loss, background_loss (nats a word) and score, their difference.

    The target is the rows whose id is in ``target_ids`` (one column of its id name), the background all rows; a row's own counts
    are left out of both when it is scored. A low score means closer to the target. A text without words (null, empty, blank) has
    losses and score 0; a null id is never in the target; repeated rows count each, and score one another; an empty target leaves the
    shared prior as both models, so scores are 0; an empty table gives no rows; columns other than id and text are not read.
    """
    small_batches(docs.sparkSession)
    base = batched(numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text"))
    chosen = base.select("rid", "batch", "doc_id").join(target_ids.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("rid").alias("t_rid"), F.col("batch").alias("t_batch"))
    buckets = 2 * bucket_count(docs.select(F.col(text_col).cast("string").alias("text")), "text")  # words and pairs: two keys a word
    sent = base.groupBy("batch").cogroup(chosen.groupBy("t_batch")).applyInArrow(_send(buckets), "bucket int, batch long, keys binary, counts binary, chosen binary")
    known = sent.withColumn("bucket", F.when(F.col("bucket") < 0, -1 - F.pmod("batch", F.lit(buckets)).cast("int")).otherwise(F.col("bucket")))
    answers = known.groupBy("bucket").applyInArrow(_total, "batch long, bucket int, counts binary, chosen binary")
    scored = base.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_score, "rid long, doc_id long, n_words long, target_loss double, background_loss double")
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document against the labelled good ones; losses to six decimals."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score_documents(docs, labels.where("quality = 1").select("doc_id"))
    return scored.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), t AS (SELECT rid, coalesce(good, false) AS good, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
p AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY rid ORDER BY i), '') AS v FROM t),
one AS (SELECT x, count(*) AS n, count(*) FILTER (WHERE good) AS g FROM p GROUP BY x UNION ALL SELECT '', count(*), count(*) FILTER (WHERE good) FROM p WHERE v = ''),
two AS (SELECT v, x, count(*) AS n, count(*) FILTER (WHERE good) AS g FROM p GROUP BY v, x),
own AS (SELECT rid, x, count(*) AS n FROM p GROUP BY rid, x UNION ALL SELECT rid, '', 1 FROM p WHERE v = ''),
own2 AS (SELECT rid, v, x, count(*) AS n FROM p GROUP BY rid, v, x),
al AS (SELECT count(*) AS n, count(*) FILTER (WHERE good) AS g FROM p),
c AS (
  SELECT p.rid, CASE WHEN good THEN 1 ELSE 0 END AS f, CAST(al.n - len(d.w) AS DOUBLE) AS total, CAST(al.g - CASE WHEN p.good THEN len(d.w) ELSE 0 END AS DOUBLE) AS mass,
         a.n - ox.n AS ax, a.g - CASE WHEN p.good THEN ox.n ELSE 0 END AS gx, b.n - ov.n AS av, b.g - CASE WHEN p.good THEN ov.n ELSE 0 END AS gv,
         e.n - o2.n AS a2, e.g - CASE WHEN p.good THEN o2.n ELSE 0 END AS g2
  FROM (SELECT * FROM p) p JOIN (SELECT rid, w FROM d) d ON d.rid = p.rid JOIN al ON true
  JOIN one a ON a.x = p.x JOIN one b ON b.x = p.v JOIN two e ON e.v = p.v AND e.x = p.x
  JOIN own ox ON ox.rid = p.rid AND ox.x = p.x JOIN own ov ON ov.rid = p.rid AND ov.x = p.v JOIN own2 o2 ON o2.rid = p.rid AND o2.v = p.v AND o2.x = p.x
), q AS (SELECT *, (ax + {OPEN_WEIGHT} / {OPEN_WORDS}) / (total + {OPEN_WEIGHT}) AS prior, mass / greatest(total, 1) AS s FROM c),
l AS (
  SELECT rid, avg(-ln((g2 + {BACKOFF} * (gx + {PRIOR} * prior) / (mass + {PRIOR})) / (gv + {BACKOFF}))) AS target_loss,
         avg(-ln((a2 * s + {BACKOFF} * (ax * s + {PRIOR} * prior) / (mass + {PRIOR})) / (av * s + {BACKOFF}))) AS background_loss
  FROM q GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(target_loss, 0), 6) AS target_loss, round(coalesce(background_loss, 0), 6) AS background_loss,
       round(coalesce(target_loss - background_loss, 0), 6) AS score
FROM d LEFT JOIN l USING (rid)
"""
