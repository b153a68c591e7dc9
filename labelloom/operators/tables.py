"""Reading, looking up, filtering, writing and versioning of record tables."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions.text import blank_to_null, folded, version_number
from labelloom.operators.shared import ranked


def key_ordered(df: DataFrame, key: str = "id", columns: list[str] | None = None) -> DataFrame:
    return df.select(*(columns or df.columns)).orderBy(key)


def lookup(df: DataFrame, value, key: str = "id", ignore_case: bool = False) -> DataFrame:
    """The record whose key is ``value``: one row or none."""
    match = folded(key) == str(value).strip().lower() if ignore_case else F.col(key) == value
    return df.where(match).limit(1)


def subset(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return df.join(names.select(key).distinct(), key, "left_semi")


def unknown_names(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Listed names that no record has, as often as they are listed."""
    return names.select(key).join(df.select(key), key, "left_anti")


def with_group_count(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each row with its group's size; sizes are counted before they meet the rows, so a large group stays spread."""
    return df.join(df.groupBy(key).agg(F.count("*").alias(name)), key)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` whole; among several new rows of a key the last by ``order`` wins."""
    latest = new
    if order is not None:
        latest = new.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")
    return old.join(latest.select(*keys), keys, "left_anti").unionByName(latest, allowMissingColumns=True)


def replaced_children(old: DataFrame, parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """All children of the given parents go; the listed ones take their place."""
    return old.join(parents.select(key).distinct(), key, "left_anti").unionByName(children)


def patched(df: DataFrame, condition: Column, values: dict) -> DataFrame:
    return df.withColumns({k: F.when(condition, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def next_code(df: DataFrame, prefix: str, key: str = "id", width: int = 4) -> DataFrame:
    """The next sequential code after those that are the prefix and digits."""
    number = F.regexp_extract(key, f"^{prefix}(\\d+)$", 1)
    top = df.agg(F.coalesce(F.max(F.nullif(number, F.lit("")).cast("long")), F.lit(0)).alias("n"))
    return top.select(F.concat(F.lit(prefix), F.lpad((F.col("n") + 1).cast("string"), width, "0")).alias("code"))


def numbered_codes(df: DataFrame, prefix: str, order: str, start: int = 0, width: int = 4) -> DataFrame:
    """Codes for many new rows at once, gapless by ``order`` after ``start``."""
    return ranked(df, [], [order], "__n").withColumn("code", F.concat(F.lit(prefix), F.lpad((F.col("__n") + start).cast("string"), width, "0"))).drop("__n")


def csv_lines(df: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """One column ``line``: values quoted where they hold a comma, a quote or a line end."""
    quoted = lambda c: F.when(c.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", *(quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))
    return df.select(*([key] if key else []), line.alias("line"))


def deduplicated_files(df: DataFrame, digest: str, name: str, preferred: str) -> DataFrame:
    """Of files with one digest the preferred one stays, else the first by name."""
    best = df.groupBy(digest).agg(F.min(F.struct(~F.col(preferred), F.col(name))).alias("__b"), F.count("*").alias("copies"))
    return best.select(digest, F.col("__b")[name].alias(name), "copies")


# predicates

def equals_all(filters: dict) -> Column:
    """Conjunction of the filters that are set."""
    return reduce(and_, [F.col(k) == v for k, v in filters.items() if v not in (None, "")], F.lit(True))


def within_dates(column: str, start: str | None, end: str | None) -> Column:
    """Inclusive range to the end of the last day; a row or bound without a date passes."""
    moment = F.col(column).try_cast("timestamp")  # nothing to do for a column of that type
    parts = [moment >= F.lit(start).cast("timestamp")] if start else []
    parts += [moment < F.lit(end).cast("timestamp") + F.expr("INTERVAL 1 DAY")] if end else []
    return F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(True))


def contains_any(columns: list[str], query: str | None) -> Column:
    """Any column holds the query, without regard to case; a blank query passes."""
    wanted = (query or "").strip().lower()
    if not wanted:
        return F.lit(True)
    return reduce(or_, [F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted), F.lit(False)) for c in columns])


def haystack_contains(columns: list[str], query: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns)).contains(query.strip().lower())


def same_folded(pairs: dict[str, str]) -> Column:
    return reduce(and_, [folded(c) == v.strip().lower() for c, v in pairs.items()])


def options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def version_options(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(version_number(column), column)


def violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Rows that break a check, once for each: (columns, check)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return df.withColumn("check", F.explode(broken))


def missing_fields(fields: dict[str, str]) -> Column:
    """Titles of the blank ones among required fields, in order."""
    return F.array_compact(F.array(*[F.when(blank_to_null(F.col(c).cast("string")).isNull(), F.lit(t)) for c, t in fields.items()]))


def valid_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    alive = sessions.where(F.col("revoked_at").isNull() & (F.col("expires_at") > now))
    return alive.join(users.where(F.col("status") == "Active").select("user_id"), "user_id", "left_semi")


def stale_sessions(now: Column, days: int) -> Column:
    ended = F.greatest("expires_at", F.coalesce("revoked_at", "expires_at"))
    finished = F.col("revoked_at").isNotNull() | (F.col("expires_at") <= now)
    return finished & (ended < now - F.make_dt_interval(F.lit(days)))


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)
