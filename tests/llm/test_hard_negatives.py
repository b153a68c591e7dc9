import math

import numpy as np

from labelloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score string, anchor string, id string"


def run(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in H.hard_negatives(table).collect())


def brute(rows):
    usable = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in usable:
        if a[0] % 100:
            continue
        near = sorted((-score(a, r), r[0]) for r in usable if r[0] != a[0] and r[1] == a[1])[:5]
        for s, p in near:
            inside = sorted((-score(a, r), r[0]) for r in usable if r[1] != a[1] and 80 * -s <= 100 * score(a, r) <= 100 * -s)[:5]
            out += [(a[0], p, n + 1, r, -s, -m) for n, (m, r) in enumerate(inside)]
    return sorted(out)


def some(n=700, width=6, seed=4):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0.02, 0.05, width).tolist(), int(rng.integers(0, 4))) for i in range(n)]


BAD = [(800, None, 1), (900, [None] * 6, 1), (1000, [math.nan] * 6, 1), (1100, [math.inf] + [0.0] * 5, 1), (1200, [], 1), (1300, [0.1] * 6, None), (None, [0.1] * 6, 1)]


def test_against_brute_force(spark, monkeypatch):
    """Ties, copies, repeated ids (of anchors too), short vectors, unusable rows; several blocks and many tiles."""
    monkeypatch.setattr(H, "BLOCK_BYTES", 150)
    monkeypatch.setattr(H, "TILE", 64)
    rows = some() + BAD + [(1400 + i, [0.1] * 6, i % 3) for i in range(60)]
    rows += [(1400, [0.1] * 6, 0), (1405, [0.1] * 6, 0), (1405, [0.2, 0.1], 0), (300, [0.3] * 6, 2), (301, [0.3] * 6, 2), (301, [0.3] * 6, 2)]
    want = brute(rows)
    assert len(want) > 100
    assert run(spark, rows) == want


def test_one_block(spark):
    rows = some(seed=5)
    assert run(spark, rows) == brute(rows)


def test_products_beyond_doubles(spark):
    rows = [(i, [float(2**20 + i), -float(2**21 - i * i)], i % 2) for i in range(0, 210)]
    assert run(spark, rows) == brute(rows)


def test_few_and_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert run(spark, [(100, [1.0], 1), (2, [1.0], 1), (3, [0.9], 2)]) == [(100, 2, 1, 3, 65536, 256 * 230)]
