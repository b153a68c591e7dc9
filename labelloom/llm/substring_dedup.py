"""Exact substring deduplication by level-wise doubling of repeated word windows.

Levels are windows of a quarter, half and the whole of the length: 5, 10 and 20 words. Below the full length a window
is looked at by the smallest hash of the shorter windows inside it, which depends on that window's words alone, so equal
windows have equal ones and neighbours share theirs. What is met once at a level is dropped, and what is met again is
extended to the next level alone. What repeats at the full length is removed unless it is its first occurrence.

A word's hash is its XXH3 of 128 bits. The two halves of it go into two polynomials, so windows of the full length are
equal by 128 bits that depend on every bit of their words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut, drop, text_or_empty

WINDOW = 20
CHUNK_BYTES = 1 << 20
LAST = 2**63 - 1

_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit counter generator: spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        out = []
        for b in (base, pow(base, -1, 2**64)):
            x = np.full(n + n // 2 + 2, b, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in slices of about CHUNK_BYTES, so that a long one needs no list of all its words."""
    at = 0
    while at < len(text):
        edge = _SPACE.search(text, at + CHUNK_BYTES)
        stop = edge.start() if edge else len(text)
        yield text[at:stop].split()
        at = stop


class Digest:
    """SHA-256 of words joined by single spaces, given piece by piece."""

    def __init__(self) -> None:
        self.hash, self.begun = hashlib.sha256(), False

    def add(self, words: list[bytes]) -> None:
        if words:
            self.hash.update(b" " * self.begun + b" ".join(words))
            self.begun = True

    def hex(self) -> str:
        return self.hash.hexdigest()


class Windows:
    """Words and window hashes of a batch of texts, all at once. starts: the first word of each text."""

    def __init__(self, texts: list[bytes]):
        self.digests, counts, hashed = [], [], []
        for text in texts:
            digest, n = Digest(), 0
            for words in _words(text):
                digest.add(words)
                n += len(words)
                hashed.append(b"".join(map(xxhash.xxh3_128_digest, words)))
            self.digests.append(digest.hex())
            counts.append(n)
        self.halves = np.ascontiguousarray(np.frombuffer(b"".join(hashed), dtype="<u8").reshape(-1, 2).T)
        self.counts = np.array(counts, dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.text = np.repeat(np.arange(len(texts)), self.counts)

    def hashes(self, length: int, which: int) -> np.ndarray:
        """Hash of the window of ``length`` words that starts at each word, from half 0 or 1 of the words' hashes;
        windows may run over a text's end."""
        word = self.halves[which]
        n = len(word)
        power, inverse = _powers(_BASES[which], n)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word * power[:n], dtype=np.uint64)])
        return _mix((total[length:] - total[:-length]) * inverse[: n - length + 1]) if n >= length else np.empty(0, dtype=np.uint64)

    def anchors(self, window: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, anchor, its place) of every full window within a text: the smallest hash of the windows of
        ``length`` words inside it and the word where the first such one starts."""
        n = len(self.text) - window + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        low = self.hashes(length, 0)
        place, span, whole = np.arange(len(low)), 1, window - length + 1
        while span < whole:
            step = min(span, whole - span)
            left = low[:-step] <= low[step:]
            low, place = np.where(left, low[:-step], low[step:]), np.where(left, place[:-step], place[step:])
            span += step
        start = np.flatnonzero(self.text[:n] == self.text[window - 1 :])
        return start, low[start], place[start]


def _chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK_BYTES of text each, or one longer text."""
    for batch in batches:
        texts = [x.as_py().encode() for x in batch.column(text)]
        at = held = 0
        for i, x in enumerate(texts):
            held += len(x)
            if held >= CHUNK_BYTES or i == len(texts) - 1:
                yield batch.slice(at, i + 1 - at), texts[at : i + 1]
                at, held = i + 1, 0


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its place in the order (null last), the text and the text's hash: rows alike in these count as one."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("dk"), F.xxhash64(text, F.length(text)).alias("tk"), text.alias("text"))


def levels(window: int) -> list[int]:
    """Lengths of the levels below the full window, shortest first."""
    return [n for n in (window // 4, window // 2) if n > 1] or [1]


def _lists(values: np.ndarray, text: np.ndarray, n: int) -> pa.ListArray:
    """One list for each of n texts from values in the order of their texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _owners(lists: pa.ListArray) -> np.ndarray:
    """The number of the list that each value of the flattened lists is in."""
    return np.repeat(np.arange(len(lists), dtype=np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False))


def _flagged(values: np.ndarray, text: np.ndarray, flags: pa.ListArray) -> np.ndarray:
    """Whether each value is among the flags of its text."""
    salt, held = np.uint64(_BASES[1]), flags.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return np.isin(_mix(values ^ (text.astype(np.uint64) * salt)), _mix(held ^ (_owners(flags) * salt)))


def _scan(keyed: DataFrame, window: int) -> DataFrame:
    """Each row's words, their digest and, for every level, the anchors of its windows.

    The lists of levels run side by side over the windows, with one entry where any of them changes. The lowest bit of
    an anchor says whether it stands at another place than the entry before.
    """
    lengths = levels(window)
    names = [f"level{i}" for i in range(len(lengths))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches, 3):
            windows = Windows(texts)
            found = [windows.anchors(window, n) for n in lengths]
            text = windows.text[found[0][0]]
            moved = []
            for _, _, place in found:
                new = np.ones(len(place), dtype=bool)
                new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
                moved.append(new)
            entry = np.any(moved, axis=0)
            marked = [(anchor | np.uint64(1)) - (~new).astype(np.uint64) for (_, anchor, _), new in zip(found, moved, strict=True)]
            lists = [_lists(x[entry].view(np.int64), text[entry], len(texts)) for x in marked]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(windows.counts, type=pa.int64()), pa.array(windows.digests, type=pa.string()), *lists], ["doc_id", "dk", "tk", "n_words", "digest", *names])

    lists = ", ".join(f"{n} array<long>" for n in names)
    return keyed.mapInArrow(run, f"doc_id long, dk long, tk long, n_words long, digest string, {lists}")


def _places(level: str) -> Column:
    """The anchors of a level, once for each place, all with the lowest bit set."""
    return F.filter(level, lambda x: x.bitwiseAND(F.lit(1).cast("long")) == 1)


def _longer(flagged: DataFrame) -> DataFrame:
    """(dk, tk, anchors) of rows (dk, tk, flags, shorter, longer): the longer anchors, once for each place, of windows
    whose shorter anchor is among the flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = np.uint64(1)
        for batch in batches:
            shorter, longer = (batch.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for i in (3, 4))
            text = _owners(batch.column(3))
            place = np.cumsum(longer & one)
            kept = np.flatnonzero(_flagged(shorter | one, text, batch.column(2)))
            kept = kept[np.diff(place[kept], prepend=np.uint64(0)) != 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _lists((longer[kept] | one).view(np.int64), text[kept], batch.num_rows)], ["dk", "tk", "anchors"])

    return flagged.mapInArrow(run, "dk long, tk long, anchors array<long>")


def _extend(repeated: DataFrame, window: int) -> DataFrame:
    """For rows (dk, tk, text, flags) the full windows whose longest anchor is among the flags, as parallel arrays.
    Of equal windows of one text the first stands for all; ``inner`` has the starts of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _chunks(batches, 2):
            windows = Windows(texts)
            start, anchor, _ = windows.anchors(window, levels(window)[-1])
            text = windows.text[start]
            held = _flagged(anchor | np.uint64(1), text, batch.column(3))
            start, text = start[held], text[held]
            h1, h2 = (windows.hashes(window, half)[start].view(np.int64) if len(start) else np.empty(0, dtype=np.int64) for half in (0, 1))
            order = np.lexsort((start, h2, h1, text))
            later = np.zeros(len(start), dtype=bool)
            same = (np.diff(h1[order]) == 0) & (np.diff(h2[order]) == 0) & (np.diff(text[order]) == 0)
            later[order[1:][same]] = True
            place = (start - windows.starts[text]).astype(np.int32)
            lists = [_lists(values[which], text[which], len(texts)) for values, which in ((h1, ~later), (h2, ~later), (place, ~later), (place, later))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lists], ["dk", "tk", "text", "h1", "h2", "starts", "inner"])

    return repeated.mapInArrow(run, "dk long, tk long, text string, h1 array<long>, h2 array<long>, starts array<int>, inner array<int>")


def _removed(flagged: DataFrame, window: int) -> DataFrame:
    """(dk, tk, n_removed, digest, kept) of rows (dk, tk, text, starts) whose windows at starts go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, texts = [], [], []
            for text, starts in zip(batch.column(2), batch.column(3), strict=True):
                at, digest, pieces, seen = np.asarray(starts.values), Digest(), [], 0
                gone = np.cumsum(np.bincount(at, minlength=at.max() + window + 1) - np.bincount(at + window, minlength=at.max() + window + 1)) > 0
                for words in _words(text.as_py().encode()):
                    drop = set(np.flatnonzero(gone[seen : seen + len(words)]).tolist())
                    seen += len(words)
                    piece = [w for i, w in enumerate(words) if i not in drop]
                    digest.add(piece)
                    pieces += [b" ".join(piece).decode()] * bool(piece)
                removed.append(int(gone.sum()))
                digests.append(digest.hex())
                texts.append(" ".join(pieces))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(removed, type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(texts, type=pa.string())], ["dk", "tk", "n_removed", "digest", "kept"])

    return flagged.mapInArrow(run, "dk long, tk long, n_removed long, digest string, kept string")


def _repeated(places: DataFrame, name: str) -> DataFrame:
    """(h) of the anchors that stand at two places or more, as a table, so that a join can split a hot one."""
    return cut(places.select(F.explode("anchors").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), name)


def _among(places: DataFrame, repeated: DataFrame, *key: str) -> DataFrame:
    """(key, flags): the different repeated anchors of each key."""
    return places.select(*key, F.explode(F.array_distinct("anchors")).alias("h")).join(repeated, "h").groupBy(*key).agg(F.collect_set("h").alias("flags"))


def removals(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(per row: doc_id, dk, tk, n_words, digest, copy; per changed text: dk, tk, n_removed, digest, kept).

    ``copy`` marks a row whose words are all those of an earlier document: it loses everything if it has a window.
    """
    keyed = _keyed(docs)
    scanned = cut(_scan(keyed, window).withColumn("row", F.monotonically_increasing_id()), "scanned")
    rows = scanned.select("doc_id", "dk", "tk", "n_words", "digest")
    earliest = rows.where(F.col("n_words") >= window).groupBy("digest").agg(F.min("dk").alias("first"), F.count("*").alias("n"))
    earliest = cut(earliest.where("n > 1").drop("n"), "copies")  # a table of its own, so that a join can split a hot digest
    rows = cut(rows.join(earliest, "digest", "left").withColumn("copy", F.col("first").isNotNull() & (F.col("dk") > F.col("first"))).drop("first"), "rows")
    originals = rows.where(~F.col("copy") & (F.col("n_words") >= window)).select("dk", "tk").distinct()

    last = len(levels(window)) - 1
    level, read = scanned.select("dk", "tk", _places("level0").alias("anchors")), [scanned, earliest]
    if last:
        places = scanned.select("row", _places("level0").alias("anchors"))
        repeated = _repeated(places, "repeated0")
        flags = cut(_among(places, repeated, "row"), "flags0")
        level = cut(_longer(scanned.join(flags, "row").select("dk", "tk", "flags", "level0", "level1")), "level1")
        read += [repeated, flags, level]
    repeated = _repeated(level, f"repeated{last}")
    flags = cut(_among(level, repeated, "dk", "tk").join(originals, ["dk", "tk"]), f"flags{last}")
    texts = keyed.select("dk", "tk", "text")
    full = cut(_extend(flags.join(texts, ["dk", "tk"]).select("dk", "tk", "text", "flags"), window), "full")
    drop(*read, repeated, flags)

    each = full.select("dk", "tk", F.explode(F.arrays_zip("h1", "h2", "starts")).alias("w")).select("dk", "tk", "w.h1", "w.h2", "w.starts")
    first = each.groupBy("h1", "h2").agg(F.min("dk").alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    first = cut(first, "first")
    later = each.join(first, ["h1", "h2"]).where("dk > first").select("dk", "tk", "starts")
    inner = full.select("dk", "tk", F.explode("inner").alias("starts"))
    gone = cut(later.unionByName(inner).groupBy("dk", "tk").agg(F.collect_set("starts").alias("gone")), "gone")
    drop(first)
    return rows, _removed(full.select("dk", "tk", "text").join(gone, ["dk", "tk"]).select("dk", "tk", "text", "gone"), window)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words of every document without those in a window of ``window`` words that starts earlier elsewhere too.

    Columns doc_id, dk, tk, n_words, n_removed, kept_sha256, kept (null: unchanged). Earlier: a smaller doc_id, or the
    same document and an earlier start; a null doc_id comes last. Rows of one doc_id and text are one document and get
    equal results; of two texts under one doc_id neither is earlier. A null text has no words. Windows are judged on
    the input. An empty table gives an empty result; other columns are ignored.
    """
    rows, changed = removals(docs, window)
    joined = rows.join(changed.withColumnRenamed("digest", "new_digest").dropDuplicates(["dk", "tk"]), ["dk", "tk"], "left")
    return joined.select("doc_id", "dk", "tk", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(F.col("copy"), F.lit(Digest().hex())).otherwise(F.coalesce("new_digest", "digest")).alias("kept_sha256"), F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"))
