"""Ordered scans against plain versions, with keys that are spread over several ranges."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from labelloom.operators import scans as S


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Ranges are not put together again, so that every key spans some."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def fold(marks):
    """Line of each (cross, size), in order."""
    out, first, largest, line = {}, None, None, -1
    for cross, size in sorted(set(marks), key=lambda m: (-m[0], -m[1])):
        if first is None or cross + size * 0.5 < first or cross + largest * 0.5 < first:
            line, first, largest = line + 1, cross, size
        largest = max(largest, size)
        out[cross, size] = line
    return out


def pages(seed, n=160):
    rng = random.Random(seed)
    hot = [(1, rng.randrange(0, 400) / 4, rng.choice([4.0, 6.0, 8.0, 8.0, 30.0])) for _ in range(n)]
    growing = [(2, 100.0 - i / 2, 1.0 + i / 3) for i in range(60)]
    shrinking = [(3, 100.0 - i / 2, 40.0 - i / 2) for i in range(60)]
    return hot + hot[:40] + growing + shrinking + [(4, 5.0, 1.0), (None, 1.0, 2.0), (None, 9.0, 2.0)]


@pytest.mark.parametrize("most", [2, 256])
def test_lines(spark, monkeypatch, most):
    """Long blocks by pointers, short ones by folds: the same lines; a null key is a page of its own."""
    monkeypatch.setattr(S, "BLOCK_MARKS", most)
    rows = pages(1)
    table = spark.createDataFrame(rows, "page int, c double, s double")
    got = {(r["page"], r["c"], r["s"], r["line"]) for r in S.line_numbers(table, ["page"], F.col("c"), F.col("s"), "line").collect()}
    want = set()
    for page in {r[0] for r in rows}:
        want |= {(page, c, s, line) for (c, s), line in fold([r[1:] for r in rows if r[0] == page]).items()}
    assert got == want


@pytest.mark.parametrize("most", [2, 256])
@pytest.mark.parametrize("rows_of_a_page", [0, 60, 8192])
def test_lines_of_small_and_large_keys(spark, monkeypatch, most, rows_of_a_page):
    """e_04, e_06, e_02: all keys by ranges, large ones by ranges and small ones within a row, all within a row in pieces."""
    monkeypatch.setattr(S, "BLOCK_MARKS", most)
    monkeypatch.setattr(S, "PAGE_ROWS", rows_of_a_page)
    monkeypatch.setattr(S, "PIECE", 7)
    rows = pages(5) + [(6, c, s) for c in (10.0, 9.0, 2.5) for s in (3.0, -3.0, 0.0) for _ in range(2)]
    table = spark.createDataFrame(rows, "page int, c double, s double")
    want = {(page, c, s): line for page in {r[0] for r in rows} for (c, s), line in fold([r[1:] for r in rows if r[0] == page]).items()}
    got = S.line_numbers(table, ["page"], F.col("c"), F.col("s"), "line")
    assert dict(got.dtypes)["line"] == "bigint"
    assert sorted(map(str, got.collect())) == sorted(f"Row(page={p}, c={c}, s={s}, line={want[p, c, s]})" for p, c, s in rows)
    whole = S.lined(table, ["page"], F.col("c"), F.col("s"), "line").collect()
    assert sorted((str(r["page"]), r["line"], sorted(map(tuple, r["rows"]))) for r in whole) == sorted((str(p), n, sorted(r[1:] for r in rows if r[0] == p and want[r] == n)) for p, n in {(r[0], want[r]) for r in rows})


def test_lines_of_small_keys_take_one_shuffle(spark):
    """e_04, e_06, e_02, w_08, t_07, w_10: rows of keys that are not large meet once, and are not dealt by ranges."""
    table = spark.createDataFrame(pages(6), "page int, c double, s double")
    for got in (S.line_numbers(table, ["page"], F.col("c"), F.col("s"), "line"), S.lined(table, ["page"], F.col("c"), F.col("s"), "line")):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_every_row_keeps_its_line(spark):
    table = spark.createDataFrame([(1, 5.0, 2.0, "a"), (1, 5.0, 2.0, "a"), (1, 4.5, 2.0, "b"), (1, None, 2.0, "c"), (1, 1.0, None, "d")], "page int, c double, s double, name string")
    assert sorted((r["name"], r["line"]) for r in S.line_numbers(table, ["page"], F.col("c"), F.col("s"), "line").collect()) == [("a", 0), ("a", 0), ("b", 0)]
    assert S.line_numbers(table.limit(0), ["page"], F.col("c"), F.col("s"), "line").collect() == []


def test_sessions(spark):
    rng = random.Random(2)
    rows = [(k, float(s := rng.randrange(0, 900)), float(s + rng.randrange(-2, 12)), i) for i, k in enumerate([1] * 150 + [2] * 20 + [None] * 5)]
    table = spark.createDataFrame(rows, "k int, s double, e double, i int")
    got = {(r["i"], r["band"]) for r in S.sessions_by_gap(table, ["k"], "s", "e", F.lit(3)).collect()}
    want = set()
    for key in (1, 2, None):
        band, reach = 0, None
        for s, e, i in sorted(r[1:] for r in rows if r[0] == key):
            if reach is None or s > reach + 3:
                band += 1
            reach = max(e, s) if reach is None else max(reach, e, s)
            want.add((i, band))
    assert got == want


def test_medians(spark):
    """Continuous values of one key, equal values, nulls, and keys without a value."""
    rng = random.Random(3)
    rows = [(1, rng.random()) for _ in range(301)] + [(2, float(rng.randrange(3))) for _ in range(40)] + [(3, None), (4, 1.0), (4, None), (5, 1.0), (5, 4.0), (None, 2.0)]
    got = {r["k"]: (r["median"], r["upper_median"]) for r in S.medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    for key in {r[0] for r in rows}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        assert got[key] == ((pytest.approx(statistics.median(values)), values[len(values) // 2]) if values else (None, None))
    assert set(got) == {1, 2, 3, 4, 5, None}


def test_previous(spark):
    rows = [(1, i, f"v{i}" if i % 3 else None) for i in range(50)] + [(2, 7, "x")]
    table = S.dealt(spark.createDataFrame(rows, "k int, o int, v string"), ["k"], ["o"])
    got = {(r["k"], r["o"]): r["p"] for r in S.previous(table, ["k"], ["o"], F.col("v"), "p").collect()}
    assert got == {(1, i): (f"v{i - 1}" if i and (i - 1) % 3 else None) for i in range(50)} | {(2, 7): None}
