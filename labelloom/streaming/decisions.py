"""Extension: streams over the append-only decision log. The log has no streams of its own to follow."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    """New files of a folder as a stream, ``files`` for each trigger."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(folder)


def tumbling_counts(log: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    window = F.window("ts", f"{minutes} minutes")
    return log.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", "event_type", "n", "value")


def activity_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    session = F.session_window("ts", gap)
    return log.withWatermark("ts", late).groupBy("user_id", session.alias("s")).agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")


def without_repeats(log: DataFrame, late: str = "2 hours") -> DataFrame:
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def latest_state(log: DataFrame) -> DataFrame:
    """(user_id, event_id, event_type) whenever a user's newest entry changes; state is one row a user."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest = state.get if state.exists else None
        before = newest
        for pdf in batches:
            top = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            found = (int(top["ts"].value), int(top["event_id"]), str(top["event_type"]))
            newest = found if newest is None or found[:2] > tuple(newest)[:2] else newest
        if newest != before:
            state.update(newest)
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [newest[1]], "event_type": [newest[2]]})

    rows = log.select("user_id", "event_id", "event_type", "ts").groupBy("user_id")
    return rows.applyInPandasWithState(update, "user_id long, event_id long, event_type string", "at long, event_id long, event_type string", "update", "NoTimeout")
