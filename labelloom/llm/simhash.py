"""SimHash near-duplicates: fingerprints of 3-word shingles, linked through BK-trees, grouped into components.

Two fingerprints within 2 bits agree on at least two of their four 16-bit blocks, so each distinct fingerprint goes
to six shards, one for each pair of blocks and its values; crowded shards are split by pairs of the other bytes, which
is exact too and bounds a shard. A BK-tree of each shard finds the links. A tree over all fingerprints would grow with
the corpus, so shards are shipped by key and no tree is broadcast whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut, drop, text_or_empty

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
TASK_ROWS = 200_000
SHARD_ROWS = 10_000
FRONTIER = 500_000
SLICE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the text's word shingles, repeats included, slice by slice; of all its words if they are fewer than
    ``words``; nothing without words. bytes.lower and bytes.split know ASCII alone."""
    data, at, held, many = text.encode("utf-8", "surrogatepass").lower(), 0, [], False
    hashed = partial(xxhash.xxh64_intdigest, seed=seed)
    while at < len(data):
        edge = _SPACE.search(data, at + SLICE_BYTES)
        stop = edge.start() if edge else len(data)
        found = held + data[at:stop].split()
        at = stop
        if len(found) < words:
            if at >= len(data) and found and not many:
                yield np.array([hashed(b" ".join(found))], dtype=np.uint64)
            held = found
            continue
        many = True
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
        yield np.fromiter(map(hashed, shingles), dtype=np.uint64, count=len(found) - words + 1)
        held = found[len(found) - words + 1 :]


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, highest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def simhash(text: str, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash as a signed long; 0 without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, words, seed):
        ones += _ones(hashes)
        n += len(hashes)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((simhash(t.as_py()) for t in batch.column(1)), type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fp long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, which are rows of one or more 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def bk_forest(fps: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of several shards, built level by level.

    fps: fingerprints (rows of unsigned words); tree: the shard of each, ascending. Returns the root of each shard,
    and the children: ascending keys node * (bits + 1) + distance, and the child behind each key.
    """
    roots, at = np.unique(tree, return_index=True)
    parent = np.repeat(at, np.diff(np.append(at, len(tree))))
    waiting = np.setdiff1d(np.arange(len(fps)), at)
    parent, keys, children = parent[waiting], [], []
    while len(waiting):
        key = parent * (64 * fps.shape[1] + 1) + distances(fps[waiting], fps[parent])
        kinds, first, of = np.unique(key, return_index=True, return_inverse=True)
        keys.append(kinds)
        children.append(waiting[first])
        rest = np.ones(len(waiting), dtype=bool)
        rest[first] = False
        parent, waiting = waiting[first][of][rest], waiting[rest]
    if not keys:
        return at, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return at, key[order], child[order]


def near_pairs(fps: np.ndarray, tree: np.ndarray, radius: int, asked: np.ndarray, shard: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, node, distance) of all pairs within ``radius``, in batches.

    tree: the shard of each fingerprint, ascending; asked: fingerprints that are looked for, each in the tree of its
    ``shard``. Every query walks the tree from the root and follows only children whose distance to the parent is
    within ``radius`` of its own.
    """
    roots, keys, children = bk_forest(fps, tree)
    names = tree[roots]
    place = np.searchsorted(names, shard)
    known = np.flatnonzero(place < len(names))
    known = known[names[place[known]] == shard[known]]
    wide = 64 * fps.shape[1] + 1
    low, high = (np.searchsorted(keys, np.arange(len(fps)) * wide + d) for d in (0, wide))
    todo = [(known[at : at + FRONTIER], roots[place[known[at : at + FRONTIER]]]) for at in range(0, len(known), FRONTIER)]
    while todo:
        query, node = todo.pop()
        if len(query) > FRONTIER:
            half = len(query) // 2
            todo += [(query[:half], node[:half]), (query[half:], node[half:])]
            continue
        distance = distances(asked[query], fps[node])
        near = distance <= radius
        yield query[near], node[near], distance[near]
        inner = high[node] > low[node]
        query, node, distance = query[inner], node[inner], distance[inner]
        first = np.searchsorted(keys, node * wide + np.maximum(distance - radius, 0))
        last = np.searchsorted(keys, node * wide + np.minimum(distance + radius, wide - 1) + 1)
        many = last - first
        if total := int(many.sum()):
            offset = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            todo.append((np.repeat(query, many), children[np.repeat(first, many) + offset]))


def linked(fps: np.ndarray, tree: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each fingerprint the smallest position of its component inside its shard. Links are merged as they are
    found, so their number needs no memory."""
    label = np.arange(len(fps))
    for query, node, _ in near_pairs(fps, tree, radius, fps, tree):
        apart = query != node
        merge(label, query[apart], node[apart])
    return flat(label)


def flat(label: np.ndarray) -> np.ndarray:
    """Every label points to the root of its chain."""
    while not np.array_equal(up := label[label], label):
        label[:] = up
    return label


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of every a and b; a component is named by its smallest member."""
    while len(a):
        flat(label)
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def _shards(fp: Column) -> Column:
    """Keys of the fingerprint, one for each pair of its blocks: their values and the number of the pair."""
    width = 64 // BLOCKS
    values = [F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    return F.array(*[(values[i] * (1 << width) + values[j]) * 8 + n for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))])


def _split(sharded: DataFrame, shard_rows: int) -> DataFrame:
    """Shards of more than ``shard_rows`` fingerprints give way to shards of their own that agree on two more bytes.

    Members of a shard agree on two blocks of 16 bits. Two of them within 2 bits agree on two at least of the other
    four bytes, so each goes to six smaller shards; what agrees on 48 bits has 65,536 different fingerprints at most.
    """
    hot = cut(sharded.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).select("shard"), "hot")
    if hot.isEmpty():
        return sharded
    width = 64 // BLOCKS
    known = sharded.join(hot.withColumn("hot", F.lit(True)), "shard", "left")
    rest = F.lit(0).cast("long")  # the 32 bits outside of the shard's two blocks
    for n, pair in enumerate(combinations(range(BLOCKS), 2)):
        i, j = (k for k in range(BLOCKS) if k not in pair)
        value = F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit(65535)) * 65536 + F.shiftrightunsigned("fp", width * j).bitwiseAND(F.lit(65535))
        rest = F.when(F.col("shard").bitwiseAND(F.lit(7)) == n, value).otherwise(rest)
    octets = [F.shiftrightunsigned("rest", 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    inner = [((F.col("shard") * 8 + n) * 65536 + octets[i] * 256 + octets[j]) + F.lit(1 << 60) for n, (i, j) in enumerate(combinations(range(4), 2))]
    finer = known.where("hot").withColumn("rest", rest).select("fp", F.explode(F.array(*inner)).alias("shard"))
    return known.where("hot IS NULL").select("fp", "shard").unionByName(finer)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to join every pair within ``radius`` (2 or less).

    Within a shard each fingerprint gets one link to a representative of its component there, so the rows are at most
    six times the fingerprints (36 times in crowded shards), however many pairs are close.
    """
    if radius > 2:
        raise ValueError("four blocks find pairs of 2 bits or less")
    sharded = _split(distinct.select("fp", F.explode(_shards(F.col("fp"))).alias("shard")), shard_rows)
    tasks = max(1, math.ceil(6 * distinct.count() / TASK_ROWS))
    dealt = sharded.withColumn("task", F.pmod(F.xxhash64("shard"), F.lit(tasks * 8)).cast("int"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["shard", "fp"], ignore_index=True)
        shard = rows["shard"].to_numpy()
        again = np.zeros(len(rows), dtype=bool)
        again[1:] = shard[1:] == shard[:-1]
        again[:-1] |= again[1:]
        rows, shard = rows[again], shard[again]
        fp = rows["fp"].to_numpy()
        label = linked(fp.view(np.uint64).reshape(-1, 1), shard) if len(fp) else np.empty(0, dtype=np.int64)
        other = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[other], "b": fp[label[other]]})

    return dealt.groupBy("task").applyInPandas(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every node that has a link.

    Alternating star contraction: each round hooks all larger neighbours of a node to its smallest neighbour, then
    the smaller ones, so that the depth shrinks geometrically, until only stars are left. What a join meets is a table
    in the shared folder, so that adaptive execution can split the rows of a node with many links.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        drop(edges, least)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct(), "edges")
        drop(large, least)
        # a star forest: no node is both a child and a parent, and no child has two parents
        if edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = cut(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    drop(edges)
    return found


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs``.

    Rows whose fingerprints differ in ``radius`` bits or fewer are linked; component_id is the smallest doc_id that
    links reach. A null text counts as empty, texts without words share fingerprint zero; a null doc_id is kept and
    never becomes a component_id unless the whole component has none; repeated rows stay; an empty table gives an
    empty result; other columns are ignored.
    """
    table = cut(fingerprints(docs), "fingerprints")
    distinct = cut(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    rooted = components(fingerprint_links(distinct.select("fp"), radius))
    placed = distinct.join(rooted.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = cut(placed.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    by_fp = cut(placed.join(smallest, "root").select("fp", "component_id"), "components")
    drop(distinct, rooted, smallest)
    return table.join(by_fp, "fp").select("doc_id", "fp", "component_id")
