"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words. The automaton holds every run of item words, each item
inserted from the root, so that no run crosses items. A document's words are streamed through it, which tracks the
longest match that ends at each word: ``window`` words or more mean that a window of an item ends there. Items shorter
than a window are one window, found at the suffix links of the match.

Test items are dealt into automata of a bounded number of words, each built in a task; one at a time is broadcast. Long
items are cut into chunks that share ``window - 1`` words, which keeps every window whole. Words of a document that
follow each other in no item cannot be inside a match of two words or more, so only the runs in between are streamed.
"""

from __future__ import annotations

import math
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut, drop

WINDOW = 10
COVERAGE = 0.5
AUTOMATON_WORDS = 1 << 19  # item words of one automaton, about 100 MB in a worker
CHUNK_WORDS = 4096
PIECE = 1 << 20  # bytes of a text that are held as words at once

_KEPT = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Words are runs of ASCII letters and digits and of all bytes of other characters; the rest becomes a space.
FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEPT else b if b in _KEPT else 0x20 for b in range(256))


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, folded text) in parts of about PIECE bytes that cut no word."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and FOLD[text[end]] != 0x20:
            end += 1
        yield at, text[at:end].translate(FOLD)
        at = end


class Automaton:
    """Words of items as states: 0 is the root; a transition's key is state * words + word."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        """items: (id, words), of at least one word each; fewer than ``window`` words are one window."""
        self.window, self.ids = window, [i for i, _ in items]
        self.word = {w: n for n, w in enumerate(sorted({w for _, words in items for w in words}))}
        coded = [[self.word[w] for w in words] for _, words in items]
        link, size, after = [-1], [0], [{}]
        for words in coded:
            last = 0
            for w in words:
                last = _extended(link, size, after, last, w)
        wide = len(self.word)
        moves = sorted((state * wide + w, to) for state, out in enumerate(after) for w, to in out.items())
        self.keys, self.targets = array("q", (key for key, _ in moves)), array("q", (to for _, to in moves))
        self.link, self.size = array("q", link), array("q", size)
        # of each state the ancestor that stands for its last ``window`` words, and the nearest that ends a short item
        self.holder, self.short = array("q", [-1] * len(size)), array("q", [-1] * len(size))
        owners: dict[int, set[int]] = {}
        for n, words in enumerate(coded):
            if len(words) < window:
                state = 0
                for w in words:
                    state = after[state][w]
                self.short[state] = state
                owners.setdefault(state, set()).add(n)
        for s in sorted(range(1, len(size)), key=size.__getitem__):
            up = link[s]
            self.holder[s] = self.holder[up] if size[up] >= window else s if size[s] >= window else -1
            self.short[s] = s if self.short[s] == s else self.short[up]
        for n, words in enumerate(coded):
            if len(words) >= window:
                for _, state, length in self.streamed(words):
                    if length >= window:
                        owners.setdefault(self.holder[state], set()).add(n)
        self.owners = {s: sorted(found) for s, found in owners.items()}  # items of a window, by the state that holds it
        self.pairs = np.unique(np.array([a * wide + b for words in coded for a, b in zip(words, words[1:])], dtype=np.int64))
        self.alone = np.zeros(wide + 1, dtype=bool)  # words that are a window; the last place is for words of no item
        self.alone[np.array([words[0] for words in coded if len(words) == 1], dtype=np.int64)] = True
        if window == 1:
            self.alone[:wide] = True
        self.least = min([window, *map(len, coded)])

    def streamed(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest match that ends at each word."""
        keys, targets, link, sizes, wide = self.keys, self.targets, self.link, self.size, len(self.word)
        state, length, top = 0, 0, len(keys)
        for place, w in enumerate(words):
            while True:
                key = state * wide + w
                at = bisect_left(keys, key)
                if at < top and keys[at] == key:
                    state, length = targets[at], length + 1
                    break
                if not state:
                    length = 0
                    break
                state = link[state]
                length = sizes[state]
            yield place, state, length

    def found(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """(spans of hit words, states whose windows occur) of a document's word numbers; -1 is no item's word."""
        known = ids >= 0
        if np.count_nonzero(known) < self.least:
            return [], set()
        pair = np.where(known[:-1] & known[1:], ids[:-1] * len(self.word) + ids[1:], -1)
        linked = np.zeros(len(pair), dtype=bool)
        if len(self.pairs):
            linked = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        bounds = np.flatnonzero(np.concatenate([[True], ~linked, [True]]))
        begin, many = bounds[:-1], np.diff(bounds)
        enough = (many >= self.least) & ((many > 1) | self.alone[ids[begin]])
        spans, states = [], set()
        for b, n in zip(begin[enough].tolist(), many[enough].tolist(), strict=True):
            for i, state, length in self.streamed(ids[b : b + n].tolist()):
                end = b + i + 1
                if length >= self.window:
                    spans.append((end - self.window, end))
                    states.add(self.holder[state])
                short = self.short[state]
                if short == state and length < self.size[state]:
                    short = self.short[self.link[state]]
                while short > 0:
                    spans.append((end - self.size[short], end))
                    states.add(short)
                    short = self.short[self.link[short]]
        return merged(spans), states

    def named(self, states: set[int]) -> set[str]:
        return {self.ids[n] for s in states for n in self.owners[s] if self.ids[n] is not None}


def _extended(link: list[int], size: list[int], after: list[dict[int, int]], last: int, w: int) -> int:
    """Add a word behind state ``last``; the state of the longer run."""

    def split(p: int, q: int) -> int:
        clone = len(size)
        size.append(size[p] + 1)
        after.append(dict(after[q]))
        link.append(link[q])
        link[q] = clone
        while p >= 0 and after[p].get(w) == q:
            after[p][w] = clone
            p = link[p]
        return clone

    if (q := after[last].get(w)) is not None:
        return q if size[q] == size[last] + 1 else split(last, q)
    new = len(size)
    size.append(size[last] + 1)
    after.append({})
    link.append(0)
    p = last
    while p >= 0 and w not in after[p]:
        after[p][w] = new
        p = link[p]
    if p >= 0:
        q = after[p][w]
        link[new] = q if size[q] == size[p] + 1 else split(p, q)
    return new


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _chunks(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words, n): the folded words of each item, in chunks that share ``window - 1`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = [w for _, part in pieces(text.as_py()) for w in part.split()]
                step = max(CHUNK_WORDS, 2 * window)
                for at in range(0, max(1, len(words) - window + 1), step):
                    if part := words[at : at + step + window - 1]:
                        rows.append((item, b" ".join(part), len(part)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], ["item_id", "words", "n"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), text.alias("text")).mapInArrow(run, "item_id string, words binary, n long")


def automata(benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS) -> DataFrame:
    """(number, automaton): pickled automata of about ``most`` item words each, which together hold all items."""
    chunks = cut(_chunks(benchmark, window), "items")
    parts = max(1, math.ceil((chunks.agg(F.sum("n")).first()[0] or 0) / most))

    def build(table: pa.Table) -> pa.Table:
        items = [(i, w.split()) for i, w in sorted(zip(table.column("item_id").to_pylist(), table.column("words").to_pylist(), strict=True), key=lambda x: (x[0] or "", x[1]))]
        return pa.table({"number": table.column("number")[:1], "automaton": pa.array([pickle.dumps(Automaton(items, window))], pa.binary())})

    numbered = chunks.withColumn("number", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)))
    return cut(numbered.groupBy("number").applyInArrow(build, "number long, automaton binary"), "automata")


_LOADED: dict[bytes, Automaton] = {}


def _loaded(shared: Broadcast) -> Automaton:
    """The automaton of a broadcast (digest, pickled), unpickled once a worker, which holds one at a time."""
    digest, blob = shared.value
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = pickle.loads(blob)
    return _LOADED[digest]


def _matched(docs: DataFrame, blob: bytes, with_text: bool) -> DataFrame:
    """``docs`` (doc_id, n_words, spans, items, text binary) with the spans and items of one more automaton."""
    kinds = docs.schema if with_text else docs.drop("text").schema
    shared = docs.sparkSession.sparkContext.broadcast((xxhash.xxh3_128_digest(blob), blob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _loaded(shared)
        number = automaton.word.get
        for batch in batches:
            counts, spans, items = [], [], []
            for old_spans, old_items, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                parts = [np.empty(0, dtype=np.int64)]
                for _, part in pieces(text.as_py()):
                    words = part.split()
                    parts.append(np.fromiter(map(number, words, repeat(-1)), dtype=np.int64, count=len(words)))
                ids = np.concatenate(parts)
                found, states = automaton.found(ids)
                counts.append(len(ids))
                spans.append([{"start": s, "end": e} for s, e in merged([(x["start"], x["end"]) for x in old_spans] + found)])
                items.append(sorted(automaton.named(states).union(old_items)))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, batch.schema.field(2).type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(4)] if with_text else columns, ["doc_id", "n_words", "spans", "items", "text"][: 4 + with_text])

    return docs.mapInArrow(run, kinds)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, spans array<struct<start, end>>, items array<string>) for each row of ``docs``: the number of its
    words, the spans of words (half-open) inside any occurrence of a window, and the ids of the items whose windows occur,
    sorted as strings; ``with_text`` adds the text as bytes.

    A window is a run of ``window`` words of an item; an item of fewer words, but not none, is one window. A null text
    has no words; a null doc_id and repeated rows stay; the words of an item without an id are hit, but it is not
    listed; items of one id are listed once. No items: no spans. An empty table gives an empty result; other columns are
    ignored.
    """
    empty = lambda kind: F.array().cast(kind)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), empty("array<struct<start:long,end:long>>").alias("spans"), empty("array<string>").alias("items"), text)
    built = automata(benchmark, window, most)
    numbers = sorted(r[0] for r in built.select("number").collect())
    if not numbers:
        return _matched(state, pickle.dumps(Automaton([], window)), with_text)
    for number in numbers:
        blob = bytes(built.where(F.col("number") == number).first()["automaton"])
        if number == numbers[-1]:
            return _matched(state, blob, with_text)
        last, state = state, cut(_matched(state, blob, True), "matched")  # a worker holds one automaton: the next pass starts from a table
        drop(last)


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, most: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, text, n_words, n_hit, items) of the documents that stay: a document of which more than ``coverage`` of the
    words are hit goes, and from the others the spans of hit words are taken out, from the first character of a span to
    the start of the word behind it. Edge cases are those of ``contamination``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t.as_py(), s) if s else t.as_py() for t, s in zip(batch.column(1), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), *batch.columns[3:]], ["doc_id", "text", "n_words", "n_hit", "items"])

    found = contamination(docs, benchmark, window, most, with_text=True).withColumn("n_hit", hit_words())
    kept = found.where(F.col("n_hit") <= coverage * F.col("n_words")).select("doc_id", "text", "spans", "n_words", "n_hit", "items")
    return kept.mapInArrow(run, "doc_id long, text string, n_words long, n_hit long, items array<string>")


def without(text: bytes, spans: list[dict[str, int]]) -> bytes:
    """The text without the words of the spans."""
    cuts, place, open_at = [], 0, None
    wanted = iter([(s["start"], s["end"]) for s in spans])
    start, end = next(wanted)
    for offset, part in pieces(text):
        at = 0
        for word in part.split():
            at = part.index(word, at)
            if place == end:
                cuts.append((open_at, offset + at))
                start, end, open_at = *next(wanted, (-1, -1)), None
            if place == start:
                open_at = offset + at
            at += len(word)
            place += 1
    if open_at is not None:
        cuts.append((open_at, len(text)))
    out, at = [], 0
    for a, b in cuts:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])
