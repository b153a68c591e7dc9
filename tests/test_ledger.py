"""Append-only logs: what is refused, what is repeated, and what readers see."""

import tempfile

import pytest
from pyspark.sql import functions as F

from labelloom.sources import ledger as L


@pytest.fixture
def log():
    return tempfile.mkdtemp(prefix="spark-") + "/log"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, note string")


def contents(spark, log):
    return sorted(tuple(r) for r in L.read(spark, log).collect())


def test_append_repeat_and_refuse(spark, log):
    first = table(spark, (1, "a"), (2, None))
    assert L.append(log, first, "one", ["id"]) is True
    assert L.append(log, first.orderBy(F.desc("id")), "one", ["id"]) is False
    assert L.append(log, table(spark, (3, "c")), "two", ["id"]) is True
    for batch, rows in (("one", table(spark, (1, "b"), (2, None))), ("one", table(spark, (1, "a"))), ("three", table(spark, (2, "x"))), ("four", table(spark, (4, "x"), (4, "y"))), ("five", table(spark, (None, "x")))):
        with pytest.raises(L.Refused):
            L.append(log, rows, batch, ["id"])
    assert contents(spark, log) == [(1, "a"), (2, None), (3, "c")]
    assert [c["batch"] for c in L.commits(spark, log)] == ["one", "two"] and L.changed(spark, log) == []


def test_an_empty_batch_counts_once(spark, log):
    none = spark.createDataFrame([], "id long, note string")
    assert L.append(log, none, "one", ["id"]) and not L.append(log, none, "one", ["id"])
    assert contents(spark, log) == []


def test_rows_without_a_commit_are_not_seen(spark, log):
    L.append(log, table(spark, (1, "a")), "one", ["id"])
    table(spark, (9, "torn")).write.parquet(f"{log}/batches/left-behind")
    assert contents(spark, log) == [(1, "a")]


def test_of_two_writers_one_wins(spark, log, monkeypatch):
    """Another writer commits between the look at the log and the commit: the key is found on the second look."""
    real, calls = L._committed, []

    def late(s, folder, commit):
        if not calls:
            calls.append(1)
            L.append(log, table(spark, (1, "other")), "other", ["id"])
        return real(s, folder, commit)

    monkeypatch.setattr(L, "_committed", late)
    with pytest.raises(L.Refused):
        L.append(log, table(spark, (1, "mine")), "mine", ["id"])
    assert contents(spark, log) == [(1, "other")]


def test_a_changed_file_is_found(spark, log):
    L.append(log, table(spark, (1, "a")), "one", ["id"])
    table(spark, (1, "b")).write.mode("overwrite").parquet(L.commits(spark, log)[0]["folder"])
    assert L.changed(spark, log) == ["one"]


def test_results(spark, log):
    rows = spark.createDataFrame([("b|c", 2, None), ("a", 1, 0.5)], "field string, cells long, share double")
    assert L.append_results(log, rows, "r1", "Run 1", ["field"]) and not L.append_results(log, rows, "r1", "Run 1", ["field"])
    assert L.append_results(log, rows.limit(0), "r2", "Run 2", ["field"])
    text = [r["line"] for r in L.results(spark, log).orderBy("seq", "place").collect()]
    assert text == ["## Run 1", "", "| field | cells | share |", "|---|---|---|", "| a | 1 | 0.5 |", "| b\\|c | 2 |  |", "## Run 2", "", "| field | cells | share |", "|---|---|---|"]
