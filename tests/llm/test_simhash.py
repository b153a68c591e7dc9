from collections import Counter

import numpy as np

from labelloom.llm.simhash import linked, near_duplicates, simhash
from tests.llm import brute


def test_fingerprints_and_components(docs):
    rows = near_duplicates(docs).collect()
    want = [(r["doc_id"], brute.simhash(r["text"])) for r in docs.select("doc_id", "text").collect()]
    roots = brute.components(want)
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in rows) == Counter((d, f, roots[f]) for d, f in want)


def test_trees_find_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 63, (30, 2))] + [base]))
    want = brute.components([(i, int(f)) for i, f in enumerate(fps)])
    label = linked(fps.reshape(-1, 1), np.zeros(len(fps), dtype=np.int64))
    assert label.tolist() == [want[int(f)] for f in fps]


def test_chain(spark):
    """Links reach across more than one step."""
    fps = [0b0, 0b11, 0b1111, 0b111111, 0xFFFF << 40]
    from labelloom.llm.simhash import components, fingerprint_links

    links = fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert {(r["node"], r["root"]) for r in components(links).collect()} == {(f, 0) for f in fps[:4]}


def test_crowded_shards_split(spark):
    """Fingerprints that agree on 32 bits and more, found through the smaller shards as well."""
    from labelloom.llm.simhash import components, fingerprint_links

    rng = np.random.default_rng(2)
    fps = sorted({int(x) for high in (5, 9) for x in (high << 40) + rng.integers(0, 1 << 12, 300)})
    want = brute.components([(f, f) for f in fps])
    got = {r["node"]: r["root"] for r in components(fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), shard_rows=20)).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_shingles_in_slices(monkeypatch):
    import labelloom.llm.simhash as S

    texts = ["", " ", "one", "A b", "A b  ", "a B c\n\n", "one two three four five six", "w " * 40 + "tail\n", "é ﬁ\u2003x y\x0bz " * 9]
    whole = [[h.tolist() for h in S.shingle_hashes(t, n)] for t in texts for n in (1, 3, 5)]
    for size in (1, 2, 5, 30):
        monkeypatch.setattr(S, "SLICE_BYTES", size)
        assert [sum((h.tolist() for h in S.shingle_hashes(t, n)), []) for t in texts for n in (1, 3, 5)] == [sum(x, []) for x in whole]
        assert [S.simhash(t) % 2**64 for t in texts] == [brute.simhash(t) for t in texts]


def test_empty(empty):
    assert near_duplicates(empty).count() == 0 and simhash("") == 0
