"""Latest versions, baselines, log entries and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

APPROVED = ["Approved", "Final Approved"]


def best_row(df: DataFrame, keys: list[str], order: Column, payload: list[str] | None = None) -> DataFrame:
    """The row of each key with the greatest ``order`` struct: an aggregate, so hot keys are combined before they move."""
    rest = payload or [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__b"))
    return best.select(*keys, "__b.*")


def latest_approved(artworks: DataFrame, keys: tuple[str, ...] = ("product_id", "artwork_type"), approved: list[str] | None = None) -> DataFrame:
    """The highest approved version of each line; a newer rejected or pending one never counts."""
    return best_row(artworks.where(F.col("status").isin(approved or APPROVED)), list(keys), F.struct("version_number", "id"))


def highest_version(artworks: DataFrame, keys: tuple[str, ...] = ("product_id", "artwork_type")) -> DataFrame:
    return best_row(artworks.where(F.col("status") != "Archived"), list(keys), F.struct("version_number", "id"))


def with_baseline(artworks: DataFrame, keys: tuple[str, ...] = ("product_id", "artwork_type"), approved: list[str] | None = None) -> DataFrame:
    """Each version with the latest approved version before it."""
    before = Window.partitionBy(*keys).orderBy("version_number", "id").rowsBetween(Window.unboundedPreceding, -1)
    usable = F.when(F.col("status").isin(approved or APPROVED), F.struct(F.col("id").alias("reference_id"), F.col("version_number").alias("reference_version")))
    return artworks.withColumn("__r", F.last(usable, ignorenulls=True).over(before)).select("*", "__r.*").drop("__r")


def last_entry(history: DataFrame, where: Column | None = None) -> DataFrame:
    """The newest log entry of each comparison, by time and then id."""
    rows = history if where is None else history.where(where)
    return best_row(rows, ["comparison_id"], F.struct("occurred_at", "id"))


def days_since(moment: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(moment)) / 86400)).cast("long")


def next_version(artworks: DataFrame, keys: tuple[str, ...] = ("product_id", "artwork_type")) -> DataFrame:
    return artworks.groupBy(*keys).agg((F.max("version_number") + 1).alias("next_version"))


def version_gaps(artworks: DataFrame, keys: tuple[str, ...] = ("product_id", "artwork_type")) -> DataFrame:
    """Versions whose predecessor is not one less."""
    line = Window.partitionBy(*keys).orderBy("version_number", "id")
    return artworks.withColumn("previous", F.lag("version_number").over(line)).where(F.col("version_number") != F.coalesce("previous", F.lit(0)) + 1)


def with_latest_flag(artworks: DataFrame, keys: list[str]) -> DataFrame:
    top = artworks.groupBy(*keys).agg(F.max("version_number").alias("__top"))
    return artworks.join(top, keys).withColumn("is_latest", F.col("version_number") == F.col("__top")).drop("__top")


def changed_only(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Rows whose value differs from the row before; of a run of equal ones the first stays."""
    line = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(line) == 1
    return df.withColumn("__new", first | ~value.eqNullSafe(F.lag(value).over(line))).where("__new").drop("__new")


def runs(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Islands of consecutive positions: first, last and size of each."""
    line = Window.partitionBy(*keys).orderBy(position)
    island = F.col(position) - F.row_number().over(line)
    return df.withColumn("island", island).groupBy(*keys, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("island")


def best_candidate(scored: DataFrame, keys: list[str], score: str, position: str) -> DataFrame:
    """The best-scored row of each key; ties go to the smaller position."""
    return best_row(scored, keys, F.struct(F.col(score), -F.col(position)))
