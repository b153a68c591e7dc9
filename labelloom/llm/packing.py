"""Packing of tokenised documents into windows of a fixed size by best-fit decreasing.

Best-fit decreasing looks at lengths alone, so the plan is made from the histogram of piece lengths, which has at
most ``capacity`` rows however large the corpus is. Every piece has a rank among the pieces of its length (its
partition's offset plus its place there), and the plan maps ranks to windows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import cut

CAPACITY = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"

_FIELDS = [("doc_id", T.LongType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("pid", T.IntegerType()), ("local_rank", T.LongType())]


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which of them have open windows."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity).bit_length()
        self.open = np.zeros(2 * self.size, dtype=np.int64)

    def add(self, remaining: int, windows: int) -> None:
        node = remaining + self.size
        while node:
            self.open[node] += windows
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity >= length with an open window."""
        node = length + self.size
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                break
            node >>= 1
        if node <= 1:
            return None
        while node < self.size:
            node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.size


@dataclass
class Plan:
    """Runs of pieces of one length: ranks from ``first`` on go ``each`` to a window, in windows ``sequence`` on."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5)
        return tuple(rows[:, i] for i in range(5))


def best_fit_decreasing(histogram: Iterable[tuple[int, int]], capacity: int = CAPACITY) -> Plan:
    """Plan for ``histogram`` rows (length, pieces).

    Windows with the same remaining capacity are interchangeable, so they are kept as ranges of ids. Placing a piece
    in the tightest window leaves it the tightest for the next piece of that length, until that no longer fits.
    """
    plan, tree = Plan(capacity), CapacityTree(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}

    def opened(remaining: int, first: int, windows: int) -> None:
        if windows and remaining:
            ranges.setdefault(remaining, []).append((first, windows))
            tree.add(remaining, windows)

    for length, pieces in sorted(histogram, reverse=True):
        rank = 0
        while rank < pieces:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, windows = plan.sequences, -(-(pieces - rank) // each)
                plan.sequences += windows
            else:
                each = remaining // length
                first, windows = ranges[remaining].pop()
                tree.add(remaining, -windows)
            full = min(windows, (pieces - rank) // each)
            if full:
                plan.rows.append((length, rank, each, first, capacity - remaining))
                rank += full * each
                opened(remaining - each * length, first, full)
            if full < windows and (rest := min(pieces - rank, each - 1)):
                plan.rows.append((length, rank, each, first + full, capacity - remaining))
                rank += rest
                opened(remaining - rest * length, first + full, 1)
                full += 1
            opened(remaining, first + full, windows - full)
    return plan


def _encoder(vocabulary: str, added_tokens: bool):
    """Token ids of a text: those of the tokenizers file, by its tiktoken twin, which has the same merges and is
    several times as fast. With ``added_tokens`` a text is split at the file's added tokens first, as tokenizers does,
    and each stands for its own id; without, they are ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encode = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"] if added_tokens else []
    if not listed:
        return encode
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in listed):
        raise ValueError(f"{vocabulary}: added tokens are matched as plain strings only")
    ids = {t["content"]: t["id"] for t in listed}
    added = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")

    def split(text: str) -> list[int]:
        parts = added.split(text)
        return encode(text) if len(parts) == 1 else [i for k, part in enumerate(parts) for i in ([ids[part]] if k % 2 else encode(part))]

    return split


def tokenised_pieces(docs: DataFrame, capacity: int, vocabulary: str, with_ids: bool, added_tokens: bool) -> DataFrame:
    fields = _FIELDS + [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    names = [name for name, _ in fields]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pid, ranks = _encoder(vocabulary, added_tokens), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        types = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), END_ID], dtype="<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    row = [doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), pid, int(ranks[len(piece)])]
                    ranks[len(piece)] += 1
                    for column, value in zip(out, row + [piece.astype("i4")] * with_ids, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(out, types, strict=True)], names)

    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(pieces, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False, added_tokens: bool = True) -> DataFrame:
    """Pieces of all documents with the window (``sequence_id``) and place in it (``offset``) of each.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids when ``with_ids``. A null or
    empty text is the end id alone; a null doc_id is kept; repeated rows are packed each; an empty table gives an
    empty result; other columns are ignored. A text of any length is cut into full windows and a remainder.
    Added tokens of the vocabulary inside a text get their own ids, as tokenizers gives them, unless ``added_tokens`` is off.
    """
    cutted = cut(tokenised_pieces(docs, capacity, vocabulary, with_ids, added_tokens), "pieces")
    counts = cutted.groupBy("pid", "length").agg(F.count("*").alias("pieces"))
    histogram = [(r["length"], r["pieces"]) for r in counts.groupBy("length").agg(F.sum("pieces").alias("pieces")).collect()]
    plan = best_fit_decreasing(histogram, capacity)
    before = F.sum("pieces").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    based = counts.select("pid", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = cutted.join(based, ["pid", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    extra = ["ids"] * with_ids
    lengths, firsts, each, sequences, offsets = plan.arrays()
    scale = 1 << 50  # ranks stay below

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = lengths * scale + firsts
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            run = np.searchsorted(keys, length * scale + rank, side="right") - 1
            past = rank - firsts[run]
            sequence, offset = sequences[run] + past // each[run], offsets[run] + past % each[run] * length
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)] + [batch.column(n) for n in extra]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset", *extra])

    fields = ", ".join(f"{n} long" for n in [*names, "sequence_id", "offset"]) + ", ids array<int>" * with_ids
    return ranked.select(*names, "rank", *extra).mapInArrow(placed, fields)
