"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_PATHS: dict[int, tuple[DataFrame, str]] = {}  # tables that may be dropped; the table is held so that its id stays its own
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none and runs locally."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="labelloom-")
    return _OWN[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later stages start from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(table)] = (table, path)
    return table


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and that nothing reads any more, so that disk is held by what is still needed."""
    for table in tables:
        if (found := _PATHS.pop(id(table), None)) is not None:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(found[1])
            path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a query go once it has ended; its result is already in a table."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
