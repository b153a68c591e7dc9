from collections import Counter

import pytest

from labelloom.llm.substring_dedup import remove_repeats
from tests.llm import brute


@pytest.mark.parametrize("window", [20, 5])
def test_removals(docs, window):
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute.substring(pairs, window)
    rows = remove_repeats(docs, window).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == Counter((d, *want[d, t]) for d, t in pairs)


def test_empty(empty):
    assert remove_repeats(empty).count() == 0


def compared(spark, pairs, window=20):
    want = brute.substring(pairs, window)
    rows = remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string"), window).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == Counter((d, *want[d, t]) for d, t in pairs)
    return {r["doc_id"]: r["n_removed"] for r in rows}


def test_words_that_collide_in_polynomials_modulo_a_power_of_two(spark):
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    common = " ".join(f"common{i}" for i in range(19))
    assert compared(spark, [(1, f"{common} {morse}"), (2, f"{common} {morse.translate(str.maketrans('ab', 'ba'))}")])[2] == 0


def test_repeats_inside_one_text_and_null_ids(spark):
    words = [f"w{i}" for i in range(40)]
    removed = compared(spark, [(7, " ".join(words)), (8, " ".join(words[:25] * 3)), (None, " ".join(words)), (9, "\t".join(words[5:30]) + "\n")])
    assert removed[None] == 40 and removed[9] == 25


def test_two_texts_of_one_id(spark):
    """Neither is earlier than the other; both are earlier than a later document."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = remove_repeats(spark.createDataFrame([(7, text), (7, "x " + text), (8, text + " y")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in rows) == [(7, 40, 0), (7, 41, 0), (8, 41, 40)]


def test_texts_read_in_slices(spark, docs, monkeypatch):
    import labelloom.llm.substring_dedup as S

    text = ("one  two\x0bthree\n" * 50 + "four ").encode()
    for size in (1, 2, 7, 1000):
        monkeypatch.setattr(S, "CHUNK_BYTES", size)
        assert sum(S._words(text), []) == text.split()
        windows = S.Windows([b"", text, b" "])
        assert windows.counts.tolist() == [0, 151, 0] and windows.digests[1] == S.hashlib.sha256(b" ".join(text.split())).hexdigest()


def test_every_level_keeps_repeats_at_two_places_of_one_text(spark):
    """Texts of few words, where anchors repeat at once, and passages whose copies lie apart in one text."""
    import random

    rng = random.Random(8)
    pairs = [(i, " ".join(rng.choice("ab" if i % 2 else "abcdefgh") for _ in range(rng.randint(0, 150)))) for i in range(40)]
    passage, filler = " ".join(f"p{i}" for i in range(20)), [" ".join(f"f{n}-{i}" for i in range(30)) for n in range(3)]
    pairs += [(100, f"{filler[0]} {passage} {filler[1]} {passage} {filler[2]}"), (101, f"{passage[:-1]}x {filler[0][:40]}"), (102, "same " * 300)]
    removed = compared(spark, pairs)
    assert removed[100] == 20 and removed[101] == 0 and removed[102] == 299


def test_a_level_extends_only_what_repeats(spark):
    """Two texts share ten words and no more: they meet at the first two levels and are not extended to the full one."""
    import labelloom.llm.substring_dedup as S

    assert S.levels(20) == [5, 10] and S.levels(5) == [2] and S.levels(2) == [1]
    shared = " ".join(f"s{i}" for i in range(10))
    rows = [(i, " ".join(f"a{i}-{j}" for j in range(30)) + f" {shared} " + " ".join(f"b{i}-{j}" for j in range(30))) for i in range(2)]
    assert set(compared(spark, rows).values()) == {0}
    same = [(5, f"{shared} {shared} tail"), (6, f"x {shared} {shared}")]
    assert compared(spark, rows + same)[6] == 20
