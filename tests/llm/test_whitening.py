import math

import numpy as np

from labelloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, n string, part string, component string, r string"


def run(spark, rows, parts=4, **kw):
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(parts)
    return W.whitened(table, **kw).collect()


def checked(found, rows, k=8):
    """Compares with the eigenvectors of the covariance; rows: usable ones with different ids."""
    width = max(len(v) for _, v in rows)
    x = np.array([[math.floor(1024 * c) + 100_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in rows], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    away = (x - sums / n)
    values, vectors = np.linalg.eigh(away.T @ away / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, width)
    want = away @ vectors[:, :k] / np.sqrt(values[:k])
    place = {i: at for at, (i, _) in enumerate(rows)}
    got = np.full((n, k), np.nan)
    for r in found:
        at = place[r["vec_id"]]
        got[at, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[at], sums))
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9
    assert len(found) == n * k
    assert np.abs(got * np.sign((got * want).sum(axis=0)) - want).max() < 1e-8


def test_against_eigenvectors(spark, monkeypatch):
    """Merged over several levels, with short vectors and rows that are left out."""
    monkeypatch.setattr(W, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    good = [(i, (rng.normal(0, 0.1, 12) * np.linspace(1, 3, 12)).tolist()) for i in range(300)] + [(1000, [0.5, 0.1])]
    bad = [(2000, None), (2001, [None] * 12), (2002, [math.nan] * 12), (2003, [math.inf] + [0.0] * 11), (2004, [])]
    checked(run(spark, good + bad, parts=11), good)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(7)
    good = [(i, rng.normal(0, 0.1, 3).tolist()) for i in range(50)]
    checked(run(spark, good), good)


def test_nearly_dependent_columns(spark):
    """The condition is not squared: a direction with a millionth of the spread keeps its digits."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 3000, (400, 2))
    rows = [(i, [float(a), float(b), float(a + b + e)]) for i, ((a, b), e) in enumerate(zip(base, rng.normal(0, 0.01, 400)))]
    found = run(spark, rows)
    assert max(r["identity_error"] for r in found) < 1e-9 and all(r["whitened"] is not None for r in found)


def test_repeated_and_null_ids_count(spark):
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.3, -0.2]), (2, [0.0, 0.4])]
    found = run(spark, rows)
    assert len(found) == 8 and {r["n"] for r in found} == {4}
    assert sum(r["vec_id"] is None for r in found) == 2


def test_rows_that_do_not_vary(spark):
    for rows in ([(1, [0.1, 0.2])], [(i, [0.1, 0.2]) for i in range(5)]):
        found = run(spark, rows)
        assert len(found) == 2 * len(rows)
        assert {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in found} == {(None, None, None, 0)}
    line = run(spark, [(i, [0.1 * i, 0.1 * i]) for i in range(5)])
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    assert max(r["identity_error"] for r in line) < 1e-9


def test_sums_beyond_a_long_stay_exact(spark):
    rows = [(i, [float(2**38 * i), 1.0]) for i in range(4)]
    found = {r["vec_id"]: int(r["deviation"]) for r in run(spark, rows)}
    x = [2**48 * i for i in range(4)]
    assert found == {i: (4 * v - sum(x)) ** 2 for i, v in enumerate(x)}


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
