"""Exact top-k search by columnar branch and bound.

Vectors become whole numbers, floor(256 * x). A task lays its candidates out dimension by dimension
and adds up the inner products one block of dimensions after the other. After each block the rest
of a score is at most the product of the remaining lengths of both vectors, so candidates that
cannot reach the k-th best certain score are dropped and the survivors compacted. Each task returns
its k best for each query; a window merges them.

Queries of up to BROADCAST_BYTES are broadcast and held against all rows in one pass. More of them
make a grid: queries and candidates are dealt into blocks of up to BLOCK_BYTES, Spark brings each
pair of blocks together, and each pair gives its k best; nothing is gathered by the driver.

Rows: vectors that are null, empty, or hold null or non-finite parts, and rows with a null id take
no part; a query meets only vectors of its own length; rows that share the query's id are its own;
of several query rows with one id the smallest vector asks; ties go to the smaller id; scores must
fit into 64 bits; repeated candidate rows are ranked one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

DIMS, ROWS_AT_ONCE = 16, 8192
BROADCAST_BYTES, BLOCK_BYTES = 32 << 20, 16 << 20  # of vectors as 64-bit numbers
MOST_TASKS = 4096  # of the grid; more pairs of blocks share tasks
_FOUND = "query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part, as arrays of whole numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    rows = vectors.where(ok).where(F.coalesce(finite, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).cast("array<long>").alias("v"))


def _rests(x: np.ndarray) -> np.ndarray:
    """Length of what is left of each vector (row) after each block of dimensions, rounded up."""
    squares = (x * x).reshape(len(x), -1)
    tail = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    cuts = [*range(DIMS, x.shape[1], DIMS)]
    return np.stack([np.sqrt(tail[:, c]) * (1 + 1e-12) for c in cuts] + [np.zeros(len(x))])


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best of x for each query; floor holds known k-th scores and is raised."""
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52
    kind = np.float64 if exact else object  # whole numbers are exact in doubles up to 2**53
    q, columns = q.astype(kind), np.ascontiguousarray(x.T.astype(kind))  # vertical layout
    rest_q, rest_x = _rests(q.astype(np.float64)), _rests(x.astype(np.float64))
    out = []
    starts = [*range(0, x.shape[1], DIMS)]
    for first in range(0, len(q), 128):
        head = q[first : first + 128, :DIMS] @ columns[:DIMS]
        for i in range(first, min(first + 128, len(q))):
            alive = np.flatnonzero(ids != q_ids[i])
            score = head[i - first][alive]
            for b in range(len(starts)):
                if b:
                    part = slice(starts[b], starts[b] + DIMS)
                    score = score + q[i, part] @ columns[part, alive]
                slack = rest_q[b, i] * rest_x[b, alive]
                if len(alive) > k:
                    sure = (score - slack).astype(np.float64)
                    floor[i] = max(floor[i], np.partition(sure, len(sure) - k)[len(sure) - k])
                keep = (score + slack).astype(np.float64) >= floor[i] - 1e-6 * max(1.0, abs(floor[i])) if not exact else score + slack >= floor[i] - 1e-3
                alive, score = alive[keep], score[keep]
            best = np.lexsort((ids[alive], -score.astype(np.float64)))[:k] if exact else np.array(sorted(range(len(alive)), key=lambda j: (-score[j], ids[alive[j]]))[:k], int)
            out.extend((int(q_ids[i]), int(ids[alive[j]]), int(score[j])) for j in best)
    return out


def _merged(rows: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    rows.sort(key=lambda r: (r[0], -r[2], r[1]))
    out, last, n = [], None, 0
    for r in rows:
        last, n = (last, n + 1) if r[0] == last else (r[0], 1)
        if n <= k:
            out.append(r)
    return out


def _by_size(ids, vectors) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length, in order of id."""
    groups: dict[int, list] = {}
    for i, v in zip(ids, vectors):
        groups.setdefault(len(v), []).append((i, v))
    out = {}
    for n, own in groups.items():
        own.sort(key=lambda x: x[0])
        out[n] = (np.array([i for i, _ in own], np.int64), np.stack([np.asarray(v, np.int64) for _, v in own]))
    return out


class _Search:
    """The k best candidates of some queries among all rows that it is shown."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
        self.queries, self.k = queries, k
        self.floors = {n: np.full(len(ids), -np.inf) for n, (ids, _) in queries.items()}
        self.best: list[tuple[int, int, int]] = []

    def show(self, rows: pd.DataFrame) -> None:
        for n, (ids, x) in _by_size(rows["vec_id"], rows["v"]).items():
            if n in self.queries:
                for at in range(0, len(ids), ROWS_AT_ONCE):
                    self.best += search_block(*self.queries[n], ids[at : at + ROWS_AT_ONCE], x[at : at + ROWS_AT_ONCE], self.k, self.floors[n])
        self.best = _merged(self.best, self.k)

    def found(self) -> pd.DataFrame:
        return pd.DataFrame(self.best, columns=["query_id", "vec_id", "score"], dtype="int64")


def _with_broadcast(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    own = asked.collect()  # no more than BROADCAST_BYTES, see top_k
    shared = rows.sparkSession.sparkContext.broadcast(_by_size([r["vec_id"] for r in own], [r["v"] for r in own]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = _Search(shared.value, k)
        for part in batches:
            search.show(part)
        yield search.found()

    return rows.mapInPandas(run, _FOUND)


def _with_grid(rows: DataFrame, asked: DataFrame, k: int, block_bytes: int) -> DataFrame:
    """Rows are dealt by number, not by id, so that rows that share an id spread over the blocks."""
    dealt = written(rows.withColumn("nth", F.monotonically_increasing_id()), "vectors")
    sizes = [df.agg(F.coalesce(F.sum(F.size("v") * 8), F.lit(0))).first()[0] for df in (dealt, asked)]
    c_blocks, q_blocks = (max(1, math.ceil(size / block_bytes)) for size in sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = dealt.select(F.pmod(F.xxhash64("nth"), F.lit(c_blocks)).alias("c"), every(q_blocks).alias("q"), "vec_id", "v")
    right = asked.select(every(c_blocks).alias("c"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("q"), "vec_id", "v")
    tasks = min(MOST_TASKS, c_blocks * q_blocks)
    left, right = (df.repartition(tasks, "c", "q") for df in (left, right))

    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        search = _Search(_by_size(queries["vec_id"], queries["v"]), k)
        search.show(candidates)
        return search.found()

    return left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(run, _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k rows of vectors with the largest inner product."""
    rows = whole_vectors(vectors)
    asked = written(whole_vectors(queries).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    size = asked.agg(F.coalesce(F.sum(F.size("v") * 8 + 8), F.lit(0))).first()[0]
    found = _with_broadcast(rows, asked, k) if size <= broadcast_bytes else _with_grid(rows, asked, k, block_bytes)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


SQL = """
with x as (
  select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from x q join x c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
