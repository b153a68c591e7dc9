from collections import Counter

import xxhash

from labelloom.llm import exact_digest as D
from tests.llm import brute


def signed(h):
    return h - 2**64 if h >= 2**63 else h


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)), (r[1] or "").encode()))
    texts = [t or "" for _, t in rows]
    out = []
    for (d, _), t, (n, sha, edited, following) in zip(rows, texts, brute.digested(texts)):
        canon = [D.canonical(x) for x in (t, edited, following)]
        out.append((d, n, sha, D.wide_hash(canon[0]), D.wide_hash(canon[1]), float(canon[0] == canon[1]), float(canon[0] == canon[2])))
    return Counter(out)


def test_against_neighbours_by_hand(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, D.edited_likeness(docs).collect())) == by_hand(rows)
    one = spark.createDataFrame([(5, "alone here")], "doc_id long, text string")
    assert Counter(map(tuple, D.edited_likeness(one).collect())) == by_hand([(5, "alone here")])


def test_canonical():
    assert D.canonical(" ﬁ\tＦＵＬＬ  Straße ") == "fi full strasse" == D.canonical("FI full STRASSE")


def test_byte_comparison_tells_clashes_apart(spark):
    """With a hash of the length alone: the same texts share a fingerprint, others of that length do not."""
    rows = spark.createDataFrame([(1, "aa"), (2, "AA"), (3, "bb"), (4, "c"), (5, "C ")], "doc_id long, text string").repartition(2)
    short = lambda c: f"h{len(c)}"
    found = D.fingerprints(rows, hashed=short)
    assert [r[0] for r in D.collisions(rows, found.select("fingerprint"), short).collect()] == ["h2"]
    prints = {r["doc_id"]: r["fingerprint"] for r in D.edited_likeness(rows, short).collect()}
    assert prints[1] == prints[2] == "h2" + D._suffix("aa") and prints[3] == "h2" + D._suffix("bb") and prints[4] == prints[5] == "h1"
    assert {(r["doc_id"], r["group_id"], r["copies"]) for r in D.digest_groups(rows, short).collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 4, 2), (5, 4, 2)}


def test_one_id_with_many_texts(spark):
    rows = [(None if i % 2 else 7, f"text {i % 150}") for i in range(300)]
    assert Counter(map(tuple, D.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == by_hand(rows)


def test_groups(docs):
    rows = [(r["doc_id"], D.canonical(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    ids = {c: [d for d, x in rows if x == c] for _, c in rows}
    want = Counter((d, min((i for i in ids[c] if i is not None), default=None), len(ids[c])) for d, c in rows)
    assert Counter((r["doc_id"], r["group_id"], r["copies"]) for r in D.digest_groups(docs).collect()) == want


def test_empty(empty):
    assert D.edited_likeness(empty).count() == 0 and D.digest_groups(empty).count() == 0
