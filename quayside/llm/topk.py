"""Exact top-k search by columnar branch and bound.

Vectors are turned into integers, and scores are integer inner products. Queries are taken in
blocks of bounded size; each block is broadcast, and every task passes its own vectors in
a vertical layout (one row per dimension). Scores are added up block of dimensions by block of
dimensions, the dimensions with the most mass first. After each block a bound on what the
remaining dimensions can still add (product of the remaining lengths, by Cauchy-Schwarz)
is compared with the query's k-th best score so far, and only the surviving (query,
vector) pairs are compacted and carried on. The bound never undercuts the true rest, and
pairs that may tie survive, so the result is exact.

Each task returns k rows per query at most; Spark merges them with a partial top-k. A block's
result is written to shared storage before the next block starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quayside.session import scratch_dir

_EXACT = float(1 << 52)
_MOST = (1 << 63) - 1


def usable(vec: str):
    """Vectors that take part: not null, no null and no non-finite component."""
    x = F.col(vec)
    return x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))


def quantized(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    return df.where(usable(vec_col)).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(F.col(vec_col), lambda v: F.greatest(F.lit(-_MOST), F.floor(F.lit(float(scale)) * v.cast("double")))).alias("v"))


class QueryBlock:
    """A block of queries with what the bound needs: dimensions by falling mass, in blocks."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, width: int = 16):
        self.ids, mass = ids, (rows.astype(np.float64) ** 2).sum(0)
        self.order = np.argsort(-mass, kind="stable")
        self.v = rows[:, self.order]
        self.cuts = [(a, min(a + width, rows.shape[1])) for a in range(0, rows.shape[1], width)]
        self.rest = rest_lengths(self.v, self.cuts)


def rest_lengths(v: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
    """Length of each row behind each block of dimensions, rounded up."""
    sq = np.stack([(v[:, a:b].astype(np.float64) ** 2).sum(1) for a, b in cuts], 1) if cuts else np.zeros((len(v), 0))
    tail = np.cumsum(sq[:, ::-1], 1)[:, ::-1]
    return np.sqrt(np.concatenate([tail[:, 1:], np.zeros((len(v), 1))], 1)) * (1 + 1e-12)


class TopK:
    """Best k (score, id) per query of a block, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.found = np.zeros((n, k), bool)

    def floor(self) -> np.ndarray:
        """Score a newcomer must reach; minus infinity while places are free."""
        return np.where(self.found[:, -1], self.score[:, -1].astype(np.float64), -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(q):
            return
        known = np.unique(q)
        qi, place = np.nonzero(self.found[known])
        q = np.concatenate([q, known[qi]])
        score = np.concatenate([score, self.score[known[qi], place]])
        ids = np.concatenate([ids, self.id[known[qi], place]])
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.score[q[keep], rank[keep]], self.id[q[keep], rank[keep]] = score[keep], ids[keep]
        self.found[q[keep], rank[keep]] = True


def search_chunk(block: QueryBlock, best: TopK, v: np.ndarray, ids: np.ndarray, query_rows: int = 256) -> None:
    """Pass one chunk of vectors (rows of integers) by all queries of the block."""
    v = v[:, block.order]
    big = max(np.abs(block.v).max(initial=0), 1) * float(max(np.abs(v).max(initial=0), 1)) * v.shape[1]
    kind = np.float64 if big < _EXACT else object  # beyond exact doubles: Python integers
    columns = np.ascontiguousarray(v.T.astype(kind))  # vertical layout: one row per dimension
    rest = rest_lengths(v, block.cuts)
    for at in range(0, len(block.ids), query_rows):
        rows = slice(at, min(at + query_rows, len(block.ids)))
        floor = best.floor()[rows]
        a, b = block.cuts[0]
        part = block.v[rows, a:b].astype(kind) @ columns[a:b]
        reach = part.astype(np.float64) + block.rest[rows, 0][:, None] * rest[:, 0][None, :]
        slack = 1 + 1e-9 * np.abs(reach)
        alive = (reach + slack >= floor[:, None]) & (block.ids[rows][:, None] != ids[None, :])
        q, c = np.nonzero(alive)
        s = part[q, c]
        for n, (a, b) in enumerate(block.cuts[1:], 1):
            if not len(q):
                break
            for d in range(a, b):
                s = s + block.v[rows, d].astype(kind)[q] * columns[d, c]
            reach = s.astype(np.float64) + block.rest[rows, n][q] * rest[c, n]
            live = reach + 1 + 1e-9 * np.abs(reach) >= floor[q]
            if not live.all():
                q, c, s = q[live], c[live], s[live]
        best.add(q + at, (np.clip(s, -_MOST, _MOST) if kind is object and len(s) else s).astype(np.int64), ids[c])


def _search(batches: Iterator[pa.RecordBatch], block: QueryBlock, k: int, chunk: int) -> Iterator[pa.RecordBatch]:
    best, dims = TopK(len(block.ids), k), block.v.shape[1]
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        col = batch.column(1)
        sizes = np.diff(col.offsets.to_numpy())
        flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        for n in np.unique(sizes):
            # components beyond the query's length meet none and add nothing, and the reverse
            rows = np.flatnonzero(sizes == n)
            for i in range(0, len(rows), chunk):
                r = rows[i:i + chunk]
                v = np.zeros((len(r), dims), np.int64)
                w = min(int(n), dims)
                if w:
                    v[:, :w] = flat[start[r][:, None] + np.arange(w)]
                if dims:
                    search_chunk(block, best, v, ids[r])
                else:
                    q, c = np.nonzero(block.ids[:, None] != ids[r][None, :])
                    best.add(q, np.zeros(len(q), np.int64), ids[r][c])
    q, place = np.nonzero(best.found)
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(best.id[q, place], pa.int64()), pa.array(best.score[q, place], pa.int64())],
                                     ["q", "vec_id", "score"])


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id",
               vec_col: str = "embedding", block_queries: int = 8192, chunk: int = 2048) -> DataFrame:
    """The ``k`` best scores per query row: query_id, rank (from 1), vec_id, score.

    A component x counts as ``floor(scale * x)``; the score is the inner product. Rows with the
    query's id are not its candidates; ties go to the smaller id; a repeated row fills a rank
    of its own, and a repeated query row has its own ranks. Vectors that are null or hold
    null or non-finite components take no part; a null id is no query and no candidate. Of
    vectors of different lengths the missing components count as zero. Fewer candidates
    give fewer rows, none give none. A component beyond a long stands at the end of its range,
    and so does a score; up to there scores are exact.

    Queries are gathered ``block_queries`` at a time, which bounds what is broadcast and what
    the driver holds; there is one pass over the vectors per block.
    """
    spark = vectors.sparkSession
    cand = quantized(vectors.where(F.col(id_col).isNotNull()), id_col, vec_col, scale)
    path = scratch_dir(spark, "topk")
    cast = quantized(queries.where(F.col(id_col).isNotNull()), id_col, vec_col, scale)
    # blocks by a hash of the row, as many as keep the largest well within the bound
    n = queries.count()
    blocks = max(1, -(-n * 5 // (4 * block_queries))) if n > block_queries else 1
    cast = cast.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    out_schema = "query_id long, rank int, vec_id long, score long"
    wrote = False
    for b in range(blocks):
        rows = cast.where(F.col("block") == b).select("id", "v").toArrow()
        # repeated query rows may fill a block beyond the bound: pass it in slices
        for at in range(0, rows.num_rows, block_queries):
            part = rows.slice(at, block_queries)
            ids = np.array(part.column("id").to_pylist(), np.int64)
            vs = part.column("v").to_pylist()
            dims = max(map(len, vs), default=0)
            block = QueryBlock(np.array([v + [0] * (dims - len(v)) for v in vs], np.int64).reshape(len(vs), dims), ids)
            shared = spark.sparkContext.broadcast(block)
            best = cand.mapInArrow(lambda it, s=shared: _search(it, s.value, k, chunk), "q int, vec_id long, score long")
            order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
            top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "q int, query_id long")
            top.join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            wrote = True
    if not wrote:
        return spark.createDataFrame([], out_schema)
    return spark.read.schema(out_schema).parquet(path)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best rows for every embedding whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, scale=256)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
