"""Hard negatives of anchors by blocked matrix products.

Anchors are dealt into blocks of a bounded size. A block is broadcast, and every task multiplies it with its own
batches of candidates, tile by tile, in float64: products of integers are exact below 2^53, and larger ones are taken in
int64. A first pass keeps each anchor's best rows of its own label. Lists of different tasks merge by rank. A second
pass looks, below each of these positives, for the best rows of other labels inside the window. Rows of the table are
never shuffled or copied; what is shuffled are the short lists.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.common import cut
from labelloom.llm.vectors import embeddings, padded, usable

BLOCK_BYTES = 32_000_000  # of one broadcast block of anchors
TILE = 1 << 20  # scores at once
NEVER = -(2**62)
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Best:
    """The ``k`` best (score, id) of each list so far: higher scores first, ties by the smaller id."""

    def __init__(self, lists: int, k: int):
        self.k, self.score, self.id = k, np.full((lists, k), NEVER, dtype=np.int64), np.full((lists, k), 2**63 - 1, dtype=np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: a line for each list from ``first`` on, NEVER for what is none of it; ids: of the columns."""
        lists, own = slice(first, first + len(scores)), self.score[first : first + len(scores)]
        least = own[:, -1:]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k, None])
        line, column = np.nonzero((scores >= least) & (scores > NEVER))
        if not len(line):
            return
        who = np.concatenate([np.repeat(np.arange(len(own)), self.k), line])
        score = np.concatenate([own.ravel(), scores[line, column]])
        names = np.concatenate([self.id[lists].ravel(), ids[column]])
        order = np.lexsort((names, -score, who))
        begin = np.searchsorted(who[order], np.arange(len(own)))
        top = order[begin[:, None] + np.arange(self.k)]
        self.score[lists], self.id[lists] = score[top], names[top]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * values)


def labelled(table: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that have an id and a label, with the labels of every seventh id moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings(table, "label").where("vec_id IS NOT NULL AND label IS NOT NULL").select("vec_id", label.alias("label"), "v")


def _anchors(rows: DataFrame, every: int, scale: int) -> DataFrame:
    """(anchor, vec_id, label, v) of the usable rows whose id is divisible by ``every``; anchor numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            at, values = usable(batch.column(2))
            columns = [pa.array(np.arange(number, number + len(at))), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(list(scaled(values, scale)), pa.list_(pa.float64()))]
            number += len(at)
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "vec_id", "label", "v"])

    return cut(rows.where(F.col("vec_id") % every == 0).mapInArrow(run, "anchor long, vec_id long, label long, v array<double>"), "anchors")


def _first(found: DataFrame, lists: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*lists).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(rows: DataFrame, anchors: DataFrame, k: int, scale: int, window: tuple[int, int]) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for one block of anchors."""
    spark = rows.sparkSession
    block = anchors.toArrow().sort_by("anchor")
    number, (_, matrix) = block.column("anchor").to_numpy(), usable(pa.concat_arrays(block.column("v").chunks))
    shared = spark.sparkContext.broadcast((matrix, block.column("vec_id").to_numpy(), block.column("label").to_numpy()))
    below, above = window

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first anchor, scores, ids, whether a row has another id, whether it has the same label)"""
        held, own_id, own_label = shared.value
        for batch in batches:
            at, values = usable(batch.column(2))
            if not len(at):
                continue
            ids, label = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at]
            width = max(values.shape[1], held.shape[1])
            candidates, wide, step = padded(scaled(values, scale), width), padded(held, width), max(1, TILE // len(at))
            for i in range(0, len(wide), step):
                part = slice(i, i + step)
                yield i, _scores(wide[part], candidates), ids, own_id[part, None] != ids, own_label[part, None] == label

    def listed(best: Best, place: int | None = None) -> pa.RecordBatch:
        line, at = np.nonzero(best.score > NEVER)
        columns = {"anchor": number[line]} | ({} if place is None else {"place": np.full(len(line), place, dtype=np.int32)})
        return pa.RecordBatch.from_pydict({**columns, "id": best.id[line, at], "score": best.score[line, at]})

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(number), k)
        for i, score, ids, other, same in tiles(batches):
            best.add(i, np.where(other & same, score, NEVER), ids)
        yield listed(best)

    near = _first(rows.mapInArrow(positives, "anchor long, id long, score long"), ["anchor"], k)
    near = cut(near.select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    found = near.toArrow()  # k rows an anchor of the block
    limit = np.full((len(number), k), NEVER, dtype=np.int64)
    limit[np.searchsorted(number, found.column("anchor").to_numpy()), found.column("place").to_numpy() - 1] = found.column("positive_score").to_numpy()
    limits = spark.sparkContext.broadcast(limit)

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, best = limits.value, [Best(len(number), k) for _ in range(k)]
        for i, score, ids, _, same in tiles(batches):
            for p in range(k):
                top = most[i : i + len(score), p, None]
                inside = ~same & (top > NEVER) & (below * top <= above * score) & (score <= top)
                best[p].add(i, np.where(inside, score, NEVER), ids)
        for p in range(k):
            yield listed(best[p], p + 1)

    ranked = _first(rows.mapInArrow(negatives, "anchor long, place int, id long, score long"), ["anchor", "place"], k)
    named = ranked.join(near, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(table: DataFrame, k: int = 5, every: int = 100, scale: int = 256, window: tuple[int, int] = (80, 100)) -> DataFrame:
    """The ``k`` best rows of other labels that score between a share of a positive's score and that score itself, for
    each of the ``k`` best positives of each anchor: columns anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score.

    table: (vec_id, embedding, label), of which other columns are ignored. A component becomes floor(scale * x), a score
    is an inner product, and products and a hundredfold of them must stay below 2^62. Anchors are the rows whose id is
    divisible by ``every``; positives have the anchor's label and another id. A negative's score lies between
    ``window[0] / window[1]`` of the positive's and the positive's. Ties go to the smaller vec_id.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; shorter
    vectors count as padded with zeros. Every one of repeated rows is a candidate, but rows that share the anchor's id
    are not its positives; repeated anchors each get their own rows. An empty table gives an empty result.
    """
    rows = labelled(table)
    anchors = _anchors(rows, every, scale)
    n, width = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n * (width or 0) * 8 / BLOCK_BYTES))
    if not n:
        return table.sparkSession.createDataFrame([], RESULT)
    dealt = lambda b: anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b) if blocks > 1 else anchors
    return reduce(DataFrame.unionByName, [_block(rows, dealt(b), k, scale, window) for b in range(blocks)])
