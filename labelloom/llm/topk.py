"""Exact top-k search by inner product with the threshold algorithm.

Queries are dealt into blocks of a bounded size, which are broadcast in turn; every task searches its own rows, a shard
at a time, and rows never move. In a shard each dimension has a sorted list. Lists are read from both ends in rounds of
doubling depth, one entry at first; rows met in any list are scored exactly (random access); a query stops once its kth
score beats the bound that unmet rows can reach. The bound is the smaller of two: the sum over dimensions of what the
lists still hold, and the query's length times the largest length of an unmet row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import cut
from labelloom.llm.vectors import padded, usable

SHARD_ROWS = 1 << 15
BLOCK_BYTES = 32_000_000  # of one broadcast block of queries
SCORES_AT_ONCE = 1 << 22
FIRST_DEPTH = 1
NEVER = -(2**62)


def quantised(table: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x). Vectors null, empty, or with a null or non-finite component are
    left out, and so are null ids; repeated rows and different rows of one id all stay."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def threshold_topk(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Top k of ``rows`` for each query but its own row: arrays (query index, row index, score), and how many rows each
    query met. ids must ascend."""
    n, width = rows.shape
    by_dimension, met_at = np.empty_like(rows), np.full(n, n, dtype=np.int64)
    for d in range(width):
        order = np.argsort(rows[:, d], kind="stable")
        by_dimension[:, d] = rows[order, d]
        met_at[order] = np.minimum(met_at[order], np.minimum(np.arange(n), np.arange(n)[::-1]))  # depth, from either end
    by_depth = np.argsort(met_at, kind="stable")
    depth_of = met_at[by_depth]
    lengths = np.sqrt((rows[by_depth].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    unmet = np.append(np.maximum.accumulate(lengths[::-1])[::-1], 0.0)  # the largest length from a place on
    exact = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * width < 2**52
    if not exact:
        rows, queries, by_dimension = rows.astype(np.int64), queries.astype(np.int64), by_dimension.astype(np.int64)
    met, parts = np.zeros(len(queries), dtype=np.int64), [(np.empty(0, dtype=np.int64),) * 3]
    at_once = max(1, SCORES_AT_ONCE // max(1, n))
    for start in range(0, len(queries), at_once):
        active = np.arange(start, min(start + at_once, len(queries)))
        best = np.empty((len(active), 0), dtype=np.int64)  # scores so far
        who, depth, read = best.copy(), FIRST_DEPTH, 0
        while len(active):
            stop = int(np.searchsorted(depth_of, depth))
            new = np.sort(by_depth[read:stop])
            read = stop
            scores = (queries[active] @ rows[new].T).astype(np.int64)
            scores[ids[new][None, :] == query_ids[active][:, None]] = NEVER
            best, who = np.concatenate([best, scores], axis=1), np.concatenate([who, np.broadcast_to(new, scores.shape)], axis=1)
            if best.shape[1] > k:
                top = _top(best, who, k)
                best, who = np.take_along_axis(best, top, 1), np.take_along_axis(who, top, 1)
            if read == n:
                done = np.ones(len(active), dtype=bool)
            else:
                low, high, q = by_dimension[depth - 1], by_dimension[n - depth], queries[active]
                lists = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low
                bound = np.minimum(lists, np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9) * unmet[read])
                done = (best.min(axis=1) > bound) if best.shape[1] >= k else np.zeros(len(active), dtype=bool)
            met[active[done]] = read
            own = best[done] != NEVER
            query = np.broadcast_to(active[done][:, None], own.shape)
            parts.append((query[own], who[done][own], best[done][own]))
            active, best, who = active[~done], best[~done], who[~done]
            depth = min(depth * 2, n)
    query, row, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    return query, row, score, met


def _top(scores: np.ndarray, who: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each line: higher scores first, then smaller rows."""
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    near = scores >= kth
    if (near.sum(axis=1) == k).all():
        return np.nonzero(near)[1].reshape(-1, k)
    out = np.empty((len(scores), k), dtype=np.int64)
    for i, line in enumerate(near):
        at = np.flatnonzero(line)
        out[i] = at[np.lexsort((who[i, at], -scores[i, at]))[:k]]
    return out


def _best(lists: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each list the k best: higher scores first, ties by the smaller id."""
    order = np.lexsort((ids, -scores, lists))
    lists, ids, scores = lists[order], ids[order], scores[order]
    begin = np.searchsorted(lists, lists)
    kept = np.arange(len(lists)) - begin < k
    return lists[kept], ids[kept], scores[kept]


def exact_topk(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k highest inner products of every query with the candidates, without those of the query's own id; ties go to
    the smaller vec_id. Both tables are (vec_id long, v array<double>) of integers, as ``quantised`` makes them; shorter
    vectors count as padded with zeros. Every one of repeated rows counts as a candidate, and repeated queries each get
    their rows. Columns query_id, rank, vec_id, score; a query with no candidate has no row.
    """
    spark = candidates.sparkSession
    asked = cut(queries.select(F.monotonically_increasing_id().alias("query"), "vec_id", "v"), "queries")
    n, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = max(1, math.ceil(n * width * 8 / BLOCK_BYTES))
    tables = [asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) if blocks > 1 else asked for b in range(blocks)]
    found = reduce(DataFrame.unionByName, [_searched(candidates, block, k) for block in tables])
    order = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, query_id, vec_id, score): the k best rows that each task has for every query of a block."""
    block = asked.toArrow().sort_by("query")
    _, matrix = usable(pa.concat_arrays(block.column("v").chunks)) if len(block) else (None, np.empty((0, 0)))
    shared = candidates.sparkSession.sparkContext.broadcast((block.column("query").to_numpy(), block.column("vec_id").to_numpy(), matrix))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, rows, held = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                ids.append(part.column(0).to_numpy())
                rows.append(usable(part.column(1))[1])
                held += len(part)
                if held >= SHARD_ROWS:
                    yield _stacked(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield _stacked(ids, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, query_ids, queries = shared.value
        best = (np.empty(0, dtype=np.int64),) * 3
        for ids, rows in shards(batches):
            wide = max(rows.shape[1], queries.shape[1])
            query, row, score, _ = threshold_topk(ids, padded(rows, wide), query_ids, padded(queries, wide), k)
            best = _best(*(np.concatenate(x) for x in zip(best, (query, ids[row], score), strict=True)), k)
        query, ids, score = best
        yield pa.RecordBatch.from_pydict({"query": numbers[query], "query_id": query_ids[query], "vec_id": ids, "score": score})

    return candidates.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def _stacked(ids: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One shard, by ascending id."""
    wide = max(r.shape[1] for r in rows)
    names, matrix = np.concatenate(ids), np.concatenate([padded(r, wide) for r in rows])
    order = np.argsort(names, kind="stable")
    return names[order], matrix[order]
