import random
from collections import defaultdict

import numpy as np

from labelloom.llm import near_texts as N
from tests.llm.brute import SPACE


def shingles(text, words=5):
    w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(w[i : i + words]) for i in range(len(w) - words + 1)) or frozenset([" ".join(w)] * bool(w))


def components(rows, similarity=0.8):
    """The component of each position, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a | b and len(a & b) >= similarity * len(a | b)):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def groups(rows):
    """The doc_ids of each component."""
    ids = defaultdict(list)
    for (d, _), root in zip(rows, components(rows)):
        ids[root].append(d)
    return ids


def brute(rows):
    """For each position the smallest doc_id that links reach."""
    ids = groups(rows)
    return [min((d for d in ids[root] if d is not None), default=None) for root in components(rows)]


def matched(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, key string").repartition(4)
    got = sorted(map(tuple, N.near_texts(table).collect()), key=str)
    assert got == sorted(((d, c) for (d, _), c in zip(rows, brute(rows))), key=str)


def test_documents_and_edge_cases(spark, docs):
    matched(spark, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_edited_copies(spark):
    """Copies with a few words changed, near the bound on either side, of one large group and of small ones."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for group, size in ((0, 120), *((g, 4) for g in range(1, 25))):
        base = [word() for _ in range(rng.randint(8, 260))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(word() for _ in range(60))
    rows += [(len(rows) + i, f"{passage} {' '.join(word() for _ in range(30))}") for i in range(60)]
    rng.shuffle(rows)
    matched(spark, rows)


def test_trees_of_a_crowded_shard(spark, monkeypatch):
    monkeypatch.setattr(N, "TREE_NODES", 8)
    test_edited_copies(spark)


def test_pages_of_one_template(spark, monkeypatch):
    """Pages that share most words but are no copies: what is compared follows their number, not its square."""
    monkeypatch.setattr(N, "TREE_NODES", 16)
    real, made = N.cut, {}
    monkeypatch.setattr(N, "cut", lambda df, name: made.setdefault(name, real(df, name)) if name in ("shared", "pairs", "prefixes") else real(df, name))
    seen = {}
    template = " ".join(f"page{i}" for i in range(100))
    for size in (100, 200, 400):
        made.clear()
        rows = [(i, f"{' '.join(f'own{i}x{k}' for k in range(20))} {template}") for i in range(size)]
        rows += [(1000 + i, rows[i][1] + " more") for i in range(5)]
        monkeypatch.setattr(N, "drop", lambda *tables: None)
        matched(spark, rows)
        seen[size] = [made[n].count() for n in ("prefixes", "shared", "pairs")]
    assert seen[400][0] <= 4.3 * seen[100][0] and seen[400][2] <= 20 and seen[100][0] > 1000


def test_radius_keeps_pairs_at_the_bound():
    apart = []
    for n in (30, 90, 300, 900):
        for i in range(60):
            common = [f"{n}.{i}.{k}" for k in range(8 * n // 10)]
            texts = [" ".join([*common, *(f"{side}{k}" for k in range(n // 10))]) for side in "ab"]
            prints = [np.frombuffer(N.sketch(t, 1)[1], dtype="<u8") for t in texts]
            apart.append(int(np.bitwise_count(prints[0] ^ prints[1]).sum()))
    assert max(apart) <= N.radius() and np.mean(apart) < N.radius() - 20


def test_empty(empty):
    assert N.near_texts(empty).count() == 0
