"""Near-duplicate texts by the Jaccard similarity of their word shingles, searched through BK-trees of SimHashes.

A node is a distinct set of shingles. Its SimHash has eight 64-bit words, so that the distance follows the similarity
closely. Shards keep the trees small: nodes whose ``ROWS`` smallest values agree under one of ``BANDS`` groups of hash
functions share a shard, and a crowded shard is split into trees of TREE_NODES. A pair that a tree finds within the
radius counts only if its sets, compared in full, are similar enough.

First every node tries its nearest neighbour, in rounds: in each one only shards that still hold different components
take part, and only neighbours of another component count. Then every pair of different components that is left is
compared, none is left out. A shard of TREE_NODES nodes or fewer is one tree, which is walked with the sets at hand and
gives one link for each node that it joins to others. Nodes of larger shards, such as pages of one template whose own
parts keep them apart, meet by the rarest shingles of their sets (``_prefix_links``), so that what they have in common
brings none of them together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut, drop, text_or_empty
from labelloom.llm.simhash import TASK_ROWS, components, flat, merge, near_pairs, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 40, 7  # a pair of similarity 0.8 shares no shard once in 12,000 times
PRINT_WORDS = 8
DEVIATIONS = 4.0  # the radius lies so many standard deviations above the expected distance
TREE_NODES = 1024
TASK_BYTES = 64_000_000
BITS_AT_ONCE = 1 << 20  # words of 64 bits
BLOCK = 512
ROUNDS = 3  # of nearest neighbours


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def radius(similarity: float = SIMILARITY) -> int:
    """Bits by which the prints of two sets of that similarity differ at most, but for chance. Two sets of Jaccard
    similarity s have a cosine of 2s / (1 + s) or more."""
    bits = 64 * PRINT_WORDS
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def sketch(text: str, words: int = WORDS) -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """(key, print, band keys, set) of a text: the set are the distinct shingles as ascending 32-bit hashes."""
    hashes = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *shingle_hashes(text, words)]))
    functions, weights = _odd(BANDS * ROWS, 1), _odd(ROWS, 2)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    ones = np.zeros(64 * PRINT_WORDS, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK]
        np.minimum(least, (part[:, None] * functions).min(axis=0), out=least)
        spread = _mix(part[:, None] * _odd(PRINT_WORDS, 3))
        ones += np.unpackbits(spread.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    bands = _mix((least.reshape(BANDS, ROWS) * weights).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return xxhash.xxh3_128_digest(hashes.tobytes()), np.packbits(2 * ones > len(hashes)).tobytes(), bands, np.unique((hashes >> np.uint64(32)).astype("<u4"))


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            made = [sketch(t.as_py(), words) for t in batch.column(1)]
            columns = [
                pa.array(np.arange(row, row + len(made))), batch.column(0), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary()), pa.array([len(m[3]) for m in made], pa.int64()),
                pa.array([m[2].view(np.int64) for m in made], pa.list_(pa.int64())), pa.array([m[3].tobytes() for m in made], pa.binary()),
            ]
            row += len(made)
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], ["row", "doc_id", "key", "fp", "n", "bands", "shingles", "tk"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), text_key().alias("tk"))
    return named.mapInArrow(run, "row long, doc_id long, key binary, fp binary, n long, bands array<long>, shingles binary, tk long")


def text_key():
    """A text's hash; with doc_id it names a row and its exact repetitions."""
    return F.xxhash64(text_or_empty(), F.length(text_or_empty()))


def _arrays(table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    column = {name: table.column(name).to_numpy() for name in table.column_names if name not in ("fp", "shingles")}
    return column, np.frombuffer(b"".join(table.column("fp").to_pylist()), dtype="<u8").reshape(-1, PRINT_WORDS)


def _walk(column: dict[str, np.ndarray], prints: np.ndarray, reach: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asking row, held row, distance) of pairs of different labels that the trees find and whose sizes allow the
    similarity. Rows that ask are looked for among those that do not."""
    held, ask = np.flatnonzero(~column["asks"]), np.flatnonzero(column["asks"])
    held = held[np.argsort(column["tree"][held], kind="stable")]
    if not len(held) or not len(ask):
        return
    for query, node, distance in near_pairs(prints[held], column["tree"][held], reach, prints[ask], column["tree"][ask]):
        a, b = ask[query], held[node]
        small, large = np.minimum(column["n"][a], column["n"][b]), np.maximum(column["n"][a], column["n"][b])
        good = (column["label"][a] != column["label"][b]) & (small >= similarity * large)
        yield a[good], b[good], distance[good]


def _nearest(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """(a, b, distance): the nearest neighbour that each tree finds for a node, among ``size`` rows (tree, asks, node,
    label, n, fp)."""
    reach = radius(similarity)
    tasks = max(1, math.ceil(size / TASK_ROWS)) * 8

    def run(table: pa.Table) -> pa.Table:
        column, prints = _arrays(table)
        best = (np.empty(0, dtype=np.int64),) * 3
        for a, b, distance in _walk(column, prints, reach, similarity):
            a, b, distance = (np.concatenate(x) for x in zip(best, (column["node"][a], column["node"][b], distance), strict=True))
            order = np.lexsort((b, distance, a))
            first = order[np.concatenate([[True], np.diff(a[order]) > 0])] if len(order) else order
            best = a[first], b[first], distance[first]
        return pa.table(dict(zip(("a", "b", "distance"), best, strict=True)))

    dealt = rows.withColumn("task", F.pmod(F.xxhash64("tree"), F.lit(tasks)).cast("int"))
    return dealt.groupBy("task").applyInArrow(run, "a long, b long, distance long")


class Sets:
    """The shingles that two sets of one tree or more have, as rows of bits, for exact sizes of intersections."""

    def __init__(self, sets: list[np.ndarray]):
        values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(counts > 1) - 1
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        kept = counts[place] > 1
        bit, row = shared[place[kept]], row[kept]
        self.bits = np.zeros((len(sets), max(1, -(-int((counts > 1).sum()) // 64))), dtype=np.uint64)
        np.bitwise_or.at(self.bits, (row, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of rows a and b."""
        at_once = max(1, BITS_AT_ONCE // self.bits.shape[1])
        parts = [np.bitwise_count(self.bits[a[i : i + at_once]] & self.bits[b[i : i + at_once]]).sum(axis=1, dtype=np.int64) for i in range(0, len(a), at_once)]
        return np.concatenate([np.empty(0, dtype=np.int64), *parts])


def _joined(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between nodes that pairs of that similarity connect within a tree, among rows (tree, asks, node,
    label, n, fp, shingles) of ``size`` bytes. A row has a link at most."""
    reach = radius(similarity)
    tasks = max(1, math.ceil(size / TASK_BYTES)) * 8

    def run(table: pa.Table) -> pa.Table:
        column, prints = _arrays(table)
        shingles = table.column("shingles").combine_chunks()
        order = np.argsort(column["tree"], kind="stable")
        label = np.arange(len(order))
        for rows_ in np.split(order, np.flatnonzero(np.diff(column["tree"][order])) + 1) if len(order) else []:
            part = {name: values[rows_] for name, values in column.items()}
            sets = Sets([np.frombuffer(shingles[int(i)].as_buffer(), dtype="<u4") for i in rows_])
            for a, b, _ in _walk(part, prints[rows_], reach, similarity):
                both = sets.common(a, b)
                alike = both >= (similarity - 1e-12) * (part["n"][a] + part["n"][b] - both)
                merge(label, rows_[a[alike]], rows_[b[alike]])
        label = flat(label)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": column["node"][other], "b": column["node"][label[other]]})

    dealt = rows.withColumn("task", F.pmod(F.xxhash64("tree"), F.lit(tasks)).cast("int"))
    return dealt.groupBy("task").applyInArrow(run, "a long, b long")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity; sets: (node, shingles)."""

    def share(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = (np.frombuffer(v.as_buffer(), dtype="<u4") for v in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            every = len(a) + len(b) - both
            out.append(both / every if every else 1.0)
        return pa.array(out, type=pa.float64())

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.where(F.arrow_udf(share, "double")("left", "right") >= similarity - 1e-12).select("a", "b")


def _prefix_links(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between nodes (node, label) of different labels whose sets have that similarity.

    Two sets so alike share a shingle among the rarest of either, by one order of all shingles: of n, the larger set
    shows its n - t n + 1 rarest, the smaller one its n - 2 t n / (1 + t) + 1 rarest. A shingle that only one label shows
    joins nothing, and its places in both sets bound what they can still share.
    """
    t = similarity

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                values = np.frombuffer(batch.column(3)[at].as_buffer(), dtype="<u4").astype(np.int64)
                named = [pa.array(np.full(len(values), batch.column(c)[at].as_py())) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(values)], ["node", "label", "n", "token"])

    tokens = cut(nodes.join(sets, "node").select("node", "label", "n", "shingles").mapInArrow(spread, "node long, label long, n long, token long"), "tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("c"))
    rarest = tokens.join(counts, "token").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("all"))
    shown = lambda share: (F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).cast("int")
    first = rarest.withColumn("few", shown(2 * t / (1 + t))).select("node", "label", "n", "few", F.posexplode(F.slice("all", F.lit(1), shown(t))).alias("i", "x"))
    prefix = cut(first.select("node", "label", "n", "i", (F.col("i") < F.col("few")).alias("short"), F.col("x.token").alias("token")), "prefixes")
    drop(tokens)
    per_label = prefix.groupBy("token", "label").agg(F.count("*").alias("k"))
    mixed = per_label.groupBy("token").agg(F.max(F.struct("k", "label"))["label"].alias("most"), F.count("*").alias("labels")).where("labels > 1").select("token", "most")
    live = cut(prefix.join(mixed, "token").select("token", "node", "label", "n", "i", "short", (F.col("label") != F.col("most")).alias("asks")), "shared")
    drop(prefix)

    def met(larger: DataFrame, smaller: DataFrame) -> DataFrame:
        x = larger.select("token", *[F.col(c).alias(f"x_{c}") for c in ("node", "label", "n", "i")])
        y = smaller.where("short").select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "label", "n", "i")])
        ordered = F.expr("x_n > y_n OR (x_n = y_n AND x_node > y_node)") & F.expr("x_label <> y_label")
        left = 1 + F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i")) - 1
        enough = (F.col("y_n") >= t * F.col("x_n") - 1e-9) & (left >= t / (1 + t) * (F.col("x_n") + F.col("y_n")) - 1e-9)
        return x.join(y, "token").where(ordered & enough).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))

    pairs = cut(met(live.where("asks"), live).unionByName(met(live.where("NOT asks"), live.where("asks"))).distinct(), "pairs")
    links = cut(_similar(pairs, sets, similarity), "links")
    drop(live, pairs)
    return links


def _members(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, tk, root) for every row: root names its component."""
    made = cut(_sketches(docs, words), "sketches")
    nodes = cut(made.groupBy("key").agg(F.min("row").alias("node")), "nodes")
    own = made.join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = own.select(F.col("row").alias("node"), F.explode(F.array_distinct("bands")).alias("band"))
    crowd = cut(banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "bands")
    met = cut(banded.join(crowd, "band"), "met")
    sets = cut(own.withColumnRenamed("row", "node").join(met.select("node").distinct(), "node", "left_semi").select("node", "n", "fp", "shingles"), "sets")
    keyed = cut(made.select("doc_id", "key", "tk"), "keyed")
    drop(made, crowd)
    trees = F.ceil(F.col("size") / TREE_NODES)
    tree = lambda number: F.xxhash64("band", number)
    chosen = F.pmod(F.xxhash64("node", F.lit(7)), trees)

    def linked_by_nearest(placed: DataFrame, rows: int) -> DataFrame:
        """Links that the nearest neighbours among rows (node, band, size, label) give."""
        printed = placed.join(sets.select("node", "n", "fp"), "node")
        asked = printed.select(tree(chosen).alias("tree"), F.explode(F.array(F.lit(False), F.lit(True))).alias("asks"), "node", "label", "n", "fp")
        best = _nearest(asked, 2 * rows, similarity).groupBy("a").agg(F.min(F.struct("distance", "b")).alias("x"))
        nearest = cut(best.select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct(), "nearest")
        links = cut(_similar(nearest, sets, similarity), "links")
        drop(nearest)
        return links

    def undecided(labels: DataFrame) -> DataFrame:
        """Rows (node, band, size, label, most) of the shards that hold different components; most: the largest there."""
        named = met.join(labels.withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = named.groupBy("band", "label").agg(F.count("*").alias("k"))
        mixed = cut(sizes.groupBy("band").agg(F.max(F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").select("band", F.col("most.label").alias("most")), "mixed")
        strays = cut(named.join(mixed, "band"), "strays")
        drop(mixed)
        return strays

    stars = lambda labels: labels.select(F.col("node").alias("a"), F.col("root").alias("b"))
    links = linked_by_nearest(met.withColumn("label", F.col("node")), met.count())
    labels = components(links)
    drop(links)
    strays = undecided(labels)
    for _ in range(ROUNDS - 1):
        links = linked_by_nearest(strays.select("node", "band", "size", "label"), strays.count())
        if links.isEmpty():
            break
        last, labels = labels, components(links.unionByName(stars(labels)))
        drop(links, last, strays)
        strays = undecided(labels)
    drop(met)
    small = strays.where(F.col("size") <= TREE_NODES).join(sets, "node")
    asks = F.col("label") != F.col("most")
    size = small.agg(F.sum((4 * F.col("n") + 8 * PRINT_WORDS) * (1 + F.when(asks, 1).otherwise(0)))).first()[0] or 0
    sides = F.explode(F.when(asks, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("asks")
    inside = cut(_joined(small.select(F.col("band").alias("tree"), sides, "node", "label", "n", "fp", "shingles"), size, similarity).distinct(), "links")
    crowded = strays.where(F.col("size") > TREE_NODES).select("node", "label").distinct()
    across = _prefix_links(crowded, sets, similarity)
    drop(strays, sets)

    rooted = components(inside.unionByName(across).unionByName(stars(labels)))
    drop(inside, across, labels)
    named = cut(nodes.join(rooted, "node", "left").select("key", F.coalesce("root", "node").alias("root")), "named")
    members = cut(keyed.join(named, "key").select("doc_id", "tk", "root"), "members")
    drop(keyed, nodes, rooted, named)
    return members


def near_texts(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: the smallest doc_id that links reach.

    Two rows are linked if the sets of their lower-cased (A-Z) word shingles, ``words`` long, have a Jaccard similarity
    of ``similarity`` or more; of fewer words the whole sequence is one shingle, and texts without words are alike.
    A null text counts as empty; a null doc_id is kept and never becomes a component_id unless the whole component has
    none; repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    members = _members(docs, words, similarity)
    smallest = cut(members.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return members.join(smallest, "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, tk) of one row of each component: its smallest doc_id, a null last, and of rows with that id the one with
    the smallest ``text_key``. Links and edge cases are those of ``near_texts``."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "tk")).alias("x")
    return _members(docs, words, similarity).groupBy("root").agg(first).select("x.doc_id", "x.tk")
