"""Exact top-k search: tiled matrix products of query blocks and shards of candidates.

Candidates are dealt into shards of bounded size; queries stream past each shard in blocks. A tile
is one matrix product of whole numbers, exact in floating point under a checked bound; each tile
keeps k a query, a task merges its tiles, and the lists of the shards are merged group by group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a shard at most, and of a tile.
SHARD, QUERY_TILE, SHARD_TILE = 65_536, 512, 4096
#: Shard lists merged by one step of the tree.
FAN_IN = 16


def quantised(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<bigint>): floor(scale * component) of rows whose id, vector and components are there and finite."""
    good = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(good).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, int64."""
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 1 << 24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First k of each row by score, then smaller id; an id of -1 with the least score is no entry."""
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


NONE = -(1 << 62)


def tile_top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of one tile; c_ids ascend, so a column's place breaks ties."""
    s = _products(q, c)
    s[q_ids[:, None] == c_ids[None, :]] = NONE
    n = len(c_ids)
    if n > k:
        if np.abs(s[s != NONE]).max(initial=0) < 1 << 40:
            key = np.maximum(s, -(1 << 41)) * n - np.arange(n)
            at = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            at = np.lexsort((np.broadcast_to(np.arange(n), s.shape), -s), axis=1)[:, :k]
        return c_ids[at], np.take_along_axis(s, at, 1)
    return np.broadcast_to(c_ids, s.shape), s


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20) -> DataFrame:
    """The k best candidates of each query by inner product, ties to the smaller id.

    Both have (id, v array<bigint>). Returns query_id, rank int (from 1), vec_id, score long. A
    candidate with a query's own id is its own row and no result. Rows that repeat an id are
    candidates each; as a query, an id is asked once, with its smallest vector. Only vectors of
    equal length meet. Fewer candidates give all; no queries or no candidates give no rows.
    """
    spark = candidates.sparkSession
    shards = max(-(-candidates.count() // SHARD), 4 * spark.sparkContext.defaultParallelism)
    asked = queries.groupBy("id").agg(F.min("v").alias("v"))
    held = candidates.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("d"), F.lit(0).alias("asks"), "id", "v")
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("v").alias("d"), F.lit(1).alias("asks"), "id", "v")
    rows = held.unionByName(asks).repartition(shards, "shard", "d").sortWithinPartitions("shard", "d", "asks", "id")
    out = T.StructType().add("query_id", "long").add("shard", "integer").add("ids", T.ArrayType(T.LongType())).add("scores", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, c_ids, c, waiting = None, [], [], []

        def answer(tile):
            q_ids, q = np.concatenate([x for x, _ in tile]), np.concatenate([y for _, y in tile])
            if not c_ids:
                return
            all_ids, all_c = np.concatenate(c_ids), np.concatenate(c)
            for a in range(0, len(q_ids), QUERY_TILE):
                qi, qv = q_ids[a : a + QUERY_TILE], q[a : a + QUERY_TILE]
                best = np.empty((len(qi), 0), np.int64), np.empty((len(qi), 0), np.int64)
                for b in range(0, len(all_ids), SHARD_TILE):
                    new = tile_top(qi, qv, all_ids[b : b + SHARD_TILE], all_c[b : b + SHARD_TILE], k)
                    best = _merge(np.concatenate([best[0], new[0]], 1), np.concatenate([best[1], new[1]], 1), k)
                real = best[1] != NONE
                yield pa.RecordBatch.from_arrays(
                    [pa.array(qi), pa.array(np.full(len(qi), group[0], np.int32)), pa.array([x[m] for x, m in zip(best[0], real, strict=True)], pa.list_(pa.int64())), pa.array([x[m] for x, m in zip(best[1], real, strict=True)], pa.list_(pa.int64()))],
                    names=out.names,
                )

        for batch in batches:
            shard, d, asking = (batch.column(i).to_numpy() for i in (0, 1, 2))
            ids, flat, at = batch.column(3).to_numpy(), batch.column(4).flatten().to_numpy(), 0
            cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(d) != 0) | (np.diff(asking) != 0)) + 1
            for a, b in zip(np.r_[0, cut], np.r_[cut, batch.num_rows], strict=True):
                v = flat[at : at + (b - a) * d[a]].reshape(b - a, d[a])
                at += (b - a) * d[a]
                if (shard[a], d[a]) != group:
                    if waiting:
                        yield from answer(waiting)
                    group, c_ids, c, waiting = (shard[a], d[a]), [], [], []
                if asking[a]:
                    waiting.append((ids[a:b], v))
                    if sum(len(x) for x, _ in waiting) >= 8 * QUERY_TILE:
                        yield from answer(waiting)
                        waiting = []
                else:
                    c_ids.append(ids[a:b])
                    c.append(v)
        if waiting:
            yield from answer(waiting)

    lists = rows.mapInArrow(run, out)

    level = shards
    best = lists.select("query_id", "shard", F.zip_with("scores", "ids", lambda s, i: F.struct((-s).alias("loss"), i.alias("vec"))).alias("best"))
    while True:
        last = level <= FAN_IN
        keys = ["query_id"] if last else ["query_id", F.floor(F.col("shard") / FAN_IN).cast("int").alias("shard")]
        best = best.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
        if last:
            break
        level = -(-level // FAN_IN)
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec").alias("vec_id"), (-F.col("b.loss")).alias("score"))
