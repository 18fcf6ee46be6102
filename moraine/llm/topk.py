"""Exact top-k inner products by the threshold algorithm over sorted lists.

Vectors are dealt to shards by their id, queries to blocks; every block meets
every shard once. A shard sorts each dimension. A query reads its lists in
parallel, from the large end where its own component is positive and from the
small end where it is negative, some depth further each round. What it meets
for the first time is scored in full; the query stops as soon as its kth score
exceeds the bound, the score of a vector made of the values the lists have
reached. Ties go to the smaller id, so a bound equal to the kth score goes on.
Shards' results, k rows for a query each, are merged by rank.

Components are floor(scale * x). Components and scores beyond the range of a
long stand at its ends (scores are exact up to there). Vectors that are null, hold null or non-finite
components, or have a null id take no part; shorter ones are filled up with
zeros; an empty one scores 0. Repeated rows of an id are one query, and each is
a candidate for others; no row with the query's id is a candidate. No queries
or no candidates give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, ready, table

SHARD, BLOCK, DEPTH = 8192, 1024, 64


def whole_vectors(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """vec_id, v: the vectors that take part, as integers."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias(embedding))
    return rows.where(F.col("vec_id").isNotNull() & F.col(embedding).isNotNull() & fine).select("vec_id", F.transform(embedding, lambda x: F.floor(scale * x)).alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of lists, filled up with zeros."""
    if not len(column):
        return np.zeros((0, width), np.int64)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy()
    return out


def threshold_search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, depth: int = DEPTH) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best of the vectors for every query."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    n, width = vectors.shape
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    big = most(vectors) * most(queries) * max(1, width) * max(1, n)
    kind = np.float64 if big < 1 << 52 else np.int64 if big < 1 << 62 else object  # all exact
    ends = np.iinfo(np.int64)

    def as_long(x: np.ndarray) -> np.ndarray:
        return np.minimum(np.maximum(x, ends.min + 1), ends.max).astype(np.int64) if kind is object else x.astype(np.int64)

    values, asked = vectors.astype(kind), queries.astype(kind)
    by = np.argsort(vectors, axis=0, kind="stable")  # each dimension's list, ascending
    place = np.empty_like(by)
    np.put_along_axis(place, by, np.arange(n)[:, None], axis=0)
    place = place.astype(np.int32)
    listed = np.take_along_axis(values, by, axis=0)
    up, down = (queries > 0).astype(np.float32), (queries < 0).astype(np.float32)
    nothing = ends.min
    active = np.arange(len(queries))
    known = np.zeros(n, bool)  # candidates scored so far; a score is made once
    made = np.zeros((len(queries), n), np.int64)
    seen_at = min(n, depth)
    out: list[tuple[int, int, int]] = []
    while len(active):
        high, low = (place >= n - seen_at).astype(np.float32), (place < seen_at).astype(np.float32)
        met = up[active] @ high.T + down[active] @ low.T > 0
        if seen_at == n:
            met[:] = True  # also for a query of zeros
        new = np.flatnonzero(met.any(axis=0) & ~known)
        if len(new):
            made[np.ix_(active, new)] = as_long(asked[active] @ values[new].T)
            known[new] = True
        scores = np.where(met, made[active], nothing)
        scores[query_ids[active][:, None] == ids[None, :]] = nothing
        bound = as_long(np.maximum(asked[active], 0) @ listed[n - seen_at] + np.minimum(asked[active], 0) @ listed[seen_at - 1])
        if n > k:
            kth = np.partition(scores, n - k, axis=1)[:, n - k]
            done = (kth != nothing) & (kth > bound) | (seen_at == n)
        else:
            done = np.full(len(active), seen_at == n)
        for row in np.flatnonzero(done):
            s = scores[row]
            if n > k:
                at = np.flatnonzero((s >= kth[row]) & (s != nothing))
            else:
                at = np.flatnonzero(s != nothing)
            at = at[np.lexsort((ids[at], -s[at]))][:k]
            q = int(query_ids[active[row]])
            out += [(q, int(ids[i]), int(s[i])) for i in at]
        active = active[~done]
        seen_at = min(n, seen_at * 4)
    return out


def top_k(df: DataFrame, is_query: Callable[[Column], Column], k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all vectors for the queries among them."""
    ready(df.sparkSession)
    vectors = keep(whole_vectors(df, vec_id, embedding, scale), "vectors")
    queries = vectors.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = keep(queries, "queries")
    n, q = vectors.count(), queries.count()
    shards, blocks = -(-n // SHARD), -(-q // BLOCK)
    width = (vectors.agg(F.max(F.size("v"))).first()[0] or 0) if n else 0

    def deal(part: str, k_: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(part)), F.lit(max(1, k_))).cast("int")

    every = lambda k_: F.explode(F.sequence(F.lit(0), F.lit(max(1, k_) - 1)))
    one = vectors.select(deal("shard", shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("query"), "vec_id", "v")
    two = queries.select(every(shards).alias("shard"), deal("block", blocks).alias("block"), F.lit(True).alias("query"), "vec_id", "v")

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("query").to_numpy()
        ids, rows = group.column("vec_id").to_numpy(), matrix(group.column("v"), width)
        found = threshold_search(ids[~asks], rows[~asks], ids[asks], rows[asks], k) if asks.any() and not asks.all() else []
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    found = one.unionByName(two).groupBy("shard", "block").applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.v, c.v)::bigint as score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s
qualify rank <= 20
"""
