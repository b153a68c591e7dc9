import re
from collections import Counter

import pytest

from labelloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLDED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, " ".join(f"shared{i}" for i in range(20, 34))), (1, "one"), (2, "x y z " * 5), (3, "Two  WORDS!"), (4, None), (5, ""), (6, "w0 w1 w4 w9 w16 w25 w36 w49 w64 w81"),
    (7, "w1 w4 w9"), (10, "w4 w9"), (11, "a b"), (None, "same text here"), (12, "ﬁ ①,straße"), (13, " ".join(f"w{i * i % 9973}" for i in range(500, 900))), (14, "z x y z x y z x y"),
]
ITEM_SCHEMA = "item_id long, text string, words string, n string, number string"


def words(text):
    return WORD.findall((text or "").translate(FOLDED))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(g) for g in windows}
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    named |= found
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(str(x) for x in named if x is not None))))
    return Counter(out)


def run(docs, items, **kw):
    return Counter((r["doc_id"], r["n_words"], tuple(i for s in r["spans"] for i in range(s["start"], s["end"])), tuple(r["items"])) for r in D.contamination(docs, items, **kw).collect())


@pytest.mark.parametrize("most", [1 << 19, 40])
def test_against_brute_force(spark, docs, sf, monkeypatch, most):
    """Benchmark items and short, empty, repeated and nameless ones, in one automaton and in many."""
    monkeypatch.setattr(D, "CHUNK_WORDS", 25)
    rows = [(r["item_id"] + 100, r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12 if most == 40 else 1000).collect()] + ITEMS
    if most == 40:
        docs = docs.where("doc_id IS NULL OR doc_id % 20 = 0 OR doc_id >= 900")
        rows = rows[:2] + ITEMS[:8] + ITEMS[11:]
    items = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ITEM_SCHEMA)
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], rows)
    assert sum(bool(k[2]) for k in want) > 5
    assert run(docs, items, most=most) == want


def test_every_short_window(spark):
    """Small alphabets, where runs overlap and items are suffixes of each other."""
    rows = [(1, "a b a"), (2, "b a"), (3, "a a b a b"), (4, "c"), (5, "b a b a b a"), (6, "a b"), (7, "c c")]
    texts = [(i, " ".join("abcd"[(i >> (2 * j)) & 3] for j in range(6))) for i in range(4096)]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    for window in (1, 2, 3, 4):
        assert run(docs, items, window=window) == brute(texts, rows, window)


def test_pieces_cut_no_word(monkeypatch):
    text = "One, twoandthree  4ü ß!".encode()
    for size in range(1, 30):
        monkeypatch.setattr(D, "PIECE", size)
        parts = list(D.pieces(text))
        assert [w for _, p in parts for w in p.split()] == [w.encode() for w in words(text.decode())]
        assert all(text[at : at + len(p)].translate(D.FOLD) == p for at, p in parts)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], ITEM_SCHEMA)
    items = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert D.contamination(empty, items).collect() == []
    assert run(docs, none) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], [])


def test_removal(spark):
    items = spark.createDataFrame([(1, "one two three"), (2, "x")], "item_id long, text string")
    texts = [(1, "Before, One two -- THREE; after."), (2, "one two three"), (3, "x ünd x, und y y"), (4, None), (5, "no match"), (6, "a b c d (one two three"), (7, "a x x b c")]
    found = {r["doc_id"]: (r["text"], r["n_hit"]) for r in D.decontaminated(spark.createDataFrame(texts, "doc_id long, text string"), items, coverage=0.6).collect()}
    assert found == {1: ("Before, after.", 3), 3: ("ünd und y y", 2), 4: ("", 0), 5: ("no match", 0), 6: ("a b c d (", 3), 7: ("a b c", 2)}


def test_one_very_long_word_and_text(spark):
    long = "q" * 3_000_000
    texts = [(1, long), (2, f"{long} one two three"), (3, "one two three " * 200_000)]
    rows = [(1, "one two three"), (2, long)]
    docs, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string")
    found = {r["doc_id"]: (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in D.contamination(docs, items).collect()}
    assert found == {1: (1, 1, ["2"]), 2: (4, 4, ["1", "2"]), 3: (600_000, 600_000, ["1"])}
