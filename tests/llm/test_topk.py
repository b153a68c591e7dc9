import math

import numpy as np

from labelloom.llm import topk as T
from tests.llm import brute


def run(spark, vectors, **kw):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, score string, block string").repartition(3)
    q = T.quantised(table)
    return sorted(tuple(r) for r in T.exact_topk(q, q.where("vec_id % 20 = 0"), 20).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 100)
    monkeypatch.setattr(T, "BLOCK_BYTES", 300)
    monkeypatch.setattr(T, "SCORES_AT_ONCE", 300)
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 0.05, 6).tolist()) for i in range(400)]
    vectors += [(1000, [0.0] * 6), (1020, [0.1] * 6), (1040, [0.1] * 6), (1041, [0.1] * 6)]
    bad = [(1060, None), (1080, [None] * 6), (1100, [math.nan] * 6), (1120, [math.inf] + [0.0] * 5), (None, [1.0] * 6), (1140, [])]
    assert run(spark, [(*v, "x", "y") for v in vectors + bad]) == brute.topk(vectors + bad)


def test_repeated_ids(spark):
    """Different rows of one id are all candidates, equal rows too, and every one of repeated queries is answered."""
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.0]), (1, [0.9, 0.0]), (2, [0.1, 0.1]), (2, [0.1, 0.1]), (20, [0.3, 0.3]), (20, [0.2, 0.3])]
    rows += [(40 + i % 3, [0.01 * (i % 7), 0.02]) for i in range(90)]
    assert run(spark, [(*r, "x", "y") for r in rows]) == brute.topk(rows)


def test_fewer_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0], "", ""), (1, [2.0], "", "")]) == [(0, 1, 1, 64 * 128)]
    assert run(spark, [(0, [1.0], "", "")]) == []
    assert run(spark, []) == []


def test_stops_before_all_rows_are_met():
    """Lists end the search where few rows are large, lengths where the largest rows come first."""
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 8, (4000, 8)))
    rows[::100] *= 12
    ids = np.arange(len(rows))
    query, row, score, met = T.threshold_topk(ids, rows, ids[::100], rows[::100], 5)
    assert np.median(met) < len(rows) / 3
    for q in range(40):
        want = np.lexsort((ids, -(rows[100 * q] @ rows.T)))
        assert sorted(row[query == q]) == sorted(want[want != 100 * q][:5])
