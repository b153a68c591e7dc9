"""Append-only logs: batches of rows, made visible by a ledger of commits, in any folder that Spark can write.

A commit is one small file whose number follows the last one. It is created only if it is not there, so of two writers
one wins and the other looks again. It holds the batch's name, its rows and a digest of them. A batch that comes twice
changes nothing; one that comes back with other rows, or that names a key that the log has, is refused. Rows are never
rewritten or removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "seq long, batch string, folder string, rows long, digest string"


class Refused(ValueError):
    """What was to be written would change the log."""


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def commits(spark: SparkSession, log: str) -> list[dict]:
    """The commits of a log in order: one small record a batch."""
    fs, path = _fs(spark, log)
    if not fs.exists(path(f"{log}/commits")):
        return []
    return [r.asDict() for r in spark.read.schema(COMMIT).json(f"{log}/commits").orderBy("seq").collect()]


def _digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest that does not depend on their order."""
    row = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    sums = [F.sum(F.xxhash64(row, F.lit(salt)).cast("decimal(38,0)")) for salt in (1, 2)]
    n, *found = rows.agg(F.count("*"), *sums).first()
    return n, ":".join(str(x or 0) for x in found)


def _written(spark: SparkSession, made: list[dict]) -> DataFrame | None:
    return spark.read.parquet(*[c["folder"] for c in made]) if made else None


def append(log: str, rows: DataFrame, batch: str, keys: list[str]) -> bool:
    """Append a batch; False if the log has it already. Raises ``Refused`` if the log has the batch with other rows, or
    has one of its keys, or if two of its rows share a key or one has none."""
    spark = rows.sparkSession
    fs, path = _fs(spark, log)
    folder = f"{log}/batches/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    n, digest = _digest(rows)
    try:
        if not rows.where(F.concat(*[F.col(k).cast("string") for k in keys]).isNull()).isEmpty():
            raise Refused(f"a row of {batch} has no key")
        if not rows.groupBy(*keys).count().where("count > 1").isEmpty():
            raise Refused(f"rows of {batch} share a key")
        while True:
            made = commits(spark, log)
            if same := [c for c in made if c["batch"] == batch]:
                if (same[0]["rows"], same[0]["digest"]) != (n, digest):
                    raise Refused(f"{batch} is in the log with other rows")
                fs.delete(path(folder), True)
                return False
            if made and not rows.join(_written(spark, made).select(*keys), keys, "left_semi").isEmpty():
                raise Refused(f"{batch} would change rows of the log")
            if _committed(spark, log, {"seq": len(made), "batch": batch, "folder": folder, "rows": n, "digest": digest}):
                return True
    except Refused:
        fs.delete(path(folder), True)
        raise


def _committed(spark: SparkSession, log: str, commit: dict) -> bool:
    """Create the commit's file; False if another writer was first."""
    fs, path = _fs(spark, log)
    target, draft = path(f"{log}/commits/{commit['seq']:020d}.json"), path(f"{log}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(commit).encode()))
    out.close()
    fs.mkdirs(target.getParent())
    done = not fs.exists(target) and fs.rename(draft, target)  # a rename does not replace a file
    if not done:
        fs.delete(draft, False)
    return bool(done)


def read(spark: SparkSession, log: str) -> DataFrame:
    """The rows of all commits; what was written without a commit is not seen."""
    found = _written(spark, commits(spark, log))
    if found is None:
        raise ValueError(f"{log} has no commits")
    return found


def changed(spark: SparkSession, log: str) -> list[str]:
    """Batches whose files no longer hold the rows that were committed."""
    return [c["batch"] for c in commits(spark, log) if _digest(spark.read.parquet(c["folder"])) != (c["rows"], c["digest"])]


# results as Markdown


def append_results(log: str, rows: DataFrame, run: str, heading: str, order: list[str]) -> bool:
    """Append a block to a results log: a heading and the rows as a Markdown table, by ``order``; once for each run."""
    from labelloom.operators.shared import ranked

    names = [c for c in rows.columns]
    cells = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    shown = lambda c: F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(""))
    body = ranked(rows, [], order, "__place").select(F.col("__place").alias("place"), cells([shown(c) for c in names]).alias("line"))
    top = [(-3, f"## {heading}"), (-2, ""), (-1, "| " + " | ".join(names) + " |"), (0, "|" + "---|" * len(names))]
    block = rows.sparkSession.createDataFrame(top, "place long, line string").unionByName(body)
    return append(log, block.select(F.lit(run).alias("run"), "place", "line"), run, ["run", "place"])


def results(spark: SparkSession, log: str) -> DataFrame:
    """(seq, run, place, line) of a results log; ordered by seq and place it is the Markdown file."""
    runs = spark.createDataFrame([(c["seq"], c["batch"]) for c in commits(spark, log)], "seq long, run string")
    return read(spark, log).join(F.broadcast(runs), "run").select("seq", "run", "place", "line")  # one row a run
