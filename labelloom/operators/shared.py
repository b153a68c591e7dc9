"""Tables that outlive executors, and ranks that no single task has to count."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_PATHS: dict[int, tuple[DataFrame, str]] = {}  # tables that may be dropped; the table is held so that its id stays its own


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none and runs locally."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="labelloom-")
    return _OWN[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = (table, path)
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing reads any more."""
    for table in tables:
        if (found := _PATHS.pop(id(table), None)) is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(found[1])
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that lets null keys meet; of the right side its other columns are added."""
    named = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    met = left.join(named, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], how)
    return met.drop(*[f"__k{i}" for i in range(len(keys))])


def by_size(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys of up to ``most`` rows, and those of larger keys, if there are any."""
    large = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most).drop("__n"), "large")
    if large.isEmpty():
        drop(large)
        return rows, None
    return joined(rows, large, keys, "left_anti"), joined(rows, large, keys, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to the shuffle's number of tasks, for work on a row that costs far more than to move it: a small
    file is one task or a few otherwise, however many rows it has."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Rank from 1 of each row within its keys by ``order`` (which should be unique there).

    Rows are dealt by ranges of keys and order, so a large key is spread over many tasks. Each task counts its own
    rows, and a table of its counts gives the offset.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id())
    local = cut(dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*order))), "ranks")
    sizes = local.groupBy("__p", *keys).agg(F.count("*").alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("__o", F.coalesce(before, F.lit(0))).drop("__c")
    return joined(local, offsets, ["__p", *keys]).withColumn(name, F.col("__o") + F.col("__r")).drop("__p", "__r", "__o")


def connected(links: DataFrame) -> DataFrame:
    """(a, l): for every end of the links (a, b) the smallest end that they reach. Labels run along the links, and every
    end jumps to the label of its label, until nothing changes."""
    links = cut(links.where("a <> b").distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("n"))
        step = label.join(near, "a").select("a", "l", F.least("l", "n").alias("m"))
        jumped = step.join(label.select(F.col("a").alias("m"), F.col("l").alias("j")), "m").select("a", "l", F.least("m", "j").alias("new"))
        new, last = cut(jumped, "labels"), label
        settled = new.where("new <> l").isEmpty()
        label = new.select("a", F.col("new").alias("l"))
        drop(last)
        if settled:
            drop(links)
            return label
