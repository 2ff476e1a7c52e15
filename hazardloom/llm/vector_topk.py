"""Exact top-k search by multi-resolution segment statistics.

Each vector is summed up at several resolutions: the mean and deviation norm of 1, 4, 16 segments.
For a query q and a vector v, the squared distance is at least
``sum over segments of size * (mean_q - mean_v)^2 + (dev_q - dev_v)^2``, which with the norms bounds the
inner product from above. Bounds run coarse to fine against the k-th best score so far; only survivors
get an exact integer product. Queries and vectors meet in bounded blocks; before they do, each query's k-th best score
against a small drawn set of vectors becomes the floor that every block starts from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blobs import small_batches
from .common import hash_unit, numbered

#: vectors of one block and queries of one block
VECTOR_BLOCK, QUERY_BLOCK = 16_384, 2_048
STEP = 2_048
#: vectors, about, that give the queries their first floor
DRAWN = 1_024
LEVELS = (1, 4, 16)


class SegmentStatistics:
    """Means (times the root of the segment size) and deviation norms at each resolution."""

    def __init__(self, x: np.ndarray):
        self.square = (x * x).sum(axis=1)
        self.levels = []
        for n in LEVELS:
            if x.shape[1] < n:
                break
            edges = np.linspace(0, x.shape[1], n + 1).astype(int)
            size = np.diff(edges)
            mean = np.add.reduceat(x, edges[:-1], axis=1) / size
            spread = x - np.repeat(mean, size, axis=1)
            dev = np.sqrt(np.add.reduceat(spread * spread, edges[:-1], axis=1))
            self.levels.append(np.concatenate([mean * np.sqrt(size), dev], axis=1))

    def upper(self, other: SegmentStatistics, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of rows ``i`` here with rows ``j`` there (a matrix)."""
        slack = 1e-9 * (self.square[i][:, None] + other.square[j][None, :]) + 1e-6
        return self.levels[level][i] @ other.levels[level][j].T + slack


def best_products(q: np.ndarray, v: np.ndarray, q_rid: np.ndarray, v_rid: np.ndarray, v_id: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, score) of each query's k best in this block that reach its ``floor``; ties to the smaller id, then row."""
    in_floats = q.shape[1] * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(v).max(initial=0)) < 2**53
    kind, lowest = (np.float64, -np.inf) if in_floats else (np.int64, np.iinfo(np.int64).min)
    qs, order = SegmentStatistics(q), np.lexsort((v_rid, v_id))
    v, v_rid = v[order], v_rid[order]
    qe, floor = q.astype(kind), np.full(len(q), -np.inf) if floor is None else floor.copy()
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for at in range(0, len(v), STEP):
        part = v[at : at + STEP]
        stats, pe = SegmentStatistics(part), part.astype(kind)
        i, j = np.arange(len(q)), np.arange(len(part))
        alive = np.ones((len(i), len(j)), bool)
        for level in range(len(stats.levels)):  # coarse to fine, on the queries and vectors that still have a pair
            alive &= qs.upper(stats, level, i, j) >= floor[i][:, None]
            rows, columns = alive.any(axis=1), alive.any(axis=0)
            i, j, alive = i[rows], j[columns], alive[rows][:, columns]
        alive &= q_rid[i][:, None] != v_rid[at + j][None, :]
        if alive.mean() < 0.05 if alive.size else True:
            x, y = np.nonzero(alive)
            found = i[x], j[y], np.einsum("ij,ij->i", qe[i[x]], pe[j[y]])
        else:
            score = np.where(alive, qe[i] @ pe[j].T, lowest)
            if len(j) > k:
                alive &= score >= np.partition(score, len(j) - k, axis=1)[:, [len(j) - k]]
            x, y = np.nonzero(alive)
            found = i[x], j[y], score[x, y]
        rows = [np.concatenate([h, n]) for h, n in zip(held, (found[0], at + found[1], found[2].astype(np.int64)))]
        best = np.lexsort((rows[1], -rows[2], rows[0]))
        first = np.searchsorted(rows[0][best], np.arange(len(q)))
        best = best[np.arange(len(best)) - first[rows[0][best]] < k]
        held = [r[best] for r in rows]
        full = np.bincount(held[0], minlength=len(q)) >= k
        last = np.searchsorted(held[0], np.arange(len(q)), side="right") - 1
        floor[full] = np.maximum(floor[full], held[2][last[full]])
    return held[0], order[held[1]], held[2]


def _floors(drawn, k: int):
    """Queries with the k-th best exact score among the drawn vectors of their length, their own row aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floor = np.full(batch.num_rows, -np.inf)
            length, rid = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            for n, (rids, s) in drawn.value.items():
                at = np.flatnonzero(length == n)
                if not len(at) or len(rids) <= k:
                    continue
                q = np.stack(batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False)).astype(np.float64)
                if n * max(1.0, np.abs(q).max()) * max(1.0, np.abs(s).max()) >= 2**53:
                    continue  # not exact in floats: no floor
                score = np.where(rid[at][:, None] == rids[None, :], -np.inf, q @ s.T)
                floor[at] = np.partition(score, len(rids) - k, axis=1)[:, len(rids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    return run


def _cells(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        if vectors.num_rows and queries.num_rows:
            v, q = (np.stack(t.column("x").to_numpy(zero_copy_only=False)).astype(np.float64) for t in (vectors, queries))
            v_rid, q_rid, q_id = (t.column(c).to_numpy() for t, c in ((vectors, "rid"), (queries, "rid"), (queries, "vec_id")))
            v_id = vectors.column("vec_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            i, j, score = best_products(q, v, q_rid, v_rid, v_id, k, queries.column("floor").to_numpy())
            ids = vectors.column("vec_id").combine_chunks().take(pa.array(j))
            return pa.table({"q_rid": q_rid[i], "query_id": q_id[i], "rid": v_rid[j], "vec_id": ids, "score": score})
        return pa.table(out, names=["q_rid", "query_id", "rid", "vec_id", "score"])

    return run


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Each query's ``k`` largest integer inner products: query_id, rank (from 1), vec_id, score.

    Components become ``floor(scale * x)``. Queries are the rows whose id is divisible by ``every``, candidates all
    rows but the query's own. Vectors that are null, empty or hold a null or non-finite component take no part;
    vectors of different lengths are not compared; ties go to the smaller id (a null id last), then the earlier
    row; repeated rows take part each on their own; an empty table gives no rows; other columns are not read.
    Every block pair is searched, so the result is exact. ValueError where scaled components reach 2**53 or squared lengths 2**63: their
    products would not be whole numbers that 64 bits hold.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    values = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    sound = F.size(vector_col) > 0, ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = numbered(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col))).where(sound[0] & sound[1]).select("rid", "vec_id", values.alias("x"), F.size(vector_col).alias("length"))
    asked = (F.col("vec_id") % every == 0) & F.col("vec_id").isNotNull()
    square = F.aggregate("x", F.lit(0.0), lambda at, x: at + x * x)
    n, n_asked, widest, longest = rows.agg(F.count("*"), F.count(F.when(asked, 1)), F.max(F.array_max(F.transform("x", F.abs))), F.max(square)).first()
    if (widest or 0.0) >= 2.0**53 or (longest or 0.0) >= 2.0**63:
        raise ValueError(f"components up to {widest:.3g} are too large for exact products")
    parts, blocks = max(1, -(-n // VECTOR_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    cell = lambda count: F.pmod(F.xxhash64("rid"), F.lit(count)).cast("int")
    every_cell = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.withColumn("part", cell(parts)).withColumn("block", every_cell(blocks))
    by_length: dict[int, list] = {}
    for x in rows.where(hash_unit(F.lit(8), F.col("rid")) < F.lit(DRAWN / max(n, 1))).select("rid", "length", "x").collect():
        by_length.setdefault(x["length"], []).append((x["rid"], x["x"]))
    drawn = spark.sparkContext.broadcast({m: (np.array([i for i, _ in part]), np.array([x for _, x in part], np.float64)) for m, part in by_length.items()})
    floored = rows.where(asked).mapInArrow(_floors(drawn, k), "rid long, vec_id long, x array<double>, length int, floor double")
    right = floored.withColumn("block", cell(blocks)).withColumn("part", every_cell(parts))
    by = ["length", "part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_cells(k), "q_rid long, query_id long, rid long, vec_id long, score long")
    order = Window.partitionBy("q_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_vector_topk(spark, sf_dir: str) -> DataFrame:
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.rid AS q_rid, q.vec_id AS query_id, v.vec_id, v.rid,
         CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.rid <> q.rid AND len(v.e) = len(q.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY q_rid ORDER BY score DESC, vec_id, rid) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
