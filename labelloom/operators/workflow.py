"""The approval chain: transitions, queues, decisions and audits of the append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelloom.operators.windows import last_entry

# Stage, decision, role, resulting status, action, artwork status.
TRANSITIONS = [
    ("Label Final", "approve", "label_final", "Pending Technical", "Sent to Technical", None),
    ("Label Final", "revision", "label_final", "Revision Required", "Revision Requested", "Revision Required"),
    ("Technical", "approve", "technical", "Pending QA", "Sent to QA", None),
    ("Technical", "revision", "technical", "Revision Required", "Revision Requested", "Revision Required"),
    ("QA", "approve", "qa", "Pending Manager Approval", "Sent to Manager", None),
    ("QA", "revision", "qa", "Revision Required", "Revision Requested", "Revision Required"),
    ("Manager", "approve", "manager", "Final Approved", "Final Approved", "Final Approved"),
    ("Manager", "reject", "manager", "Rejected", "Rejected", "Rejected"),
    ("Manager", "revision", "manager", "Revision Required", "Revision Requested", "Revision Required"),
]
WAITING = {"Pending Label Final": "Label Final", "Pending Technical": "Technical", "Pending QA": "QA", "Pending Manager Approval": "Manager"}


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRANSITIONS, "stage string, decision string, role string, resulting_status string, action string, artwork_status string")


def submitted(comparisons: DataFrame, ids: DataFrame) -> DataFrame:
    """Submitting moves a draft to the first queue without a log entry."""
    chosen = ids.select("comparison_id").distinct().withColumn("__s", F.lit(True))
    status = F.when(F.col("__s") & F.col("status").isin("Draft", "In Progress", "Revision Required"), "Pending Label Final").otherwise(F.col("status"))
    return comparisons.join(chosen, "comparison_id", "left").withColumn("status", status).drop("__s")


def decided(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """The log with an entry for each decision that the role may take at its stage; the log only grows."""
    rules = F.broadcast(transitions(log.sparkSession))
    taken = decisions.join(rules, ["stage", "decision", "role"])
    return log.unionByName(taken.select(*[c for c in log.columns if c in taken.columns]), allowMissingColumns=True)


def refused(decisions: DataFrame) -> DataFrame:
    """Decisions that no transition allows: a wrong role or an unknown decision at that stage."""
    return decisions.join(F.broadcast(transitions(decisions.sparkSession)), ["stage", "decision", "role"], "left_anti")


def current_status(log: DataFrame, default: str = "Draft") -> DataFrame:
    return last_entry(log).select("comparison_id", F.coalesce("resulting_status", F.lit(default)).alias("status"))


def illegal_entries(log: DataFrame) -> DataFrame:
    """Entries whose stage is not the one that the entry before it leads to (the first stage at the beginning)."""
    line = Window.partitionBy("comparison_id").orderBy("occurred_at", "id")
    leads = F.create_map(*[F.lit(x) for kv in WAITING.items() for x in kv] + [F.lit("Revision Required"), F.lit("Label Final")])
    expected = F.coalesce(leads[F.coalesce(F.lag("resulting_status").over(line), F.lit("Pending Label Final"))], F.lit("none"))
    return log.withColumn("expected_stage", expected).where(F.col("stage") != F.col("expected_stage"))


def assigned(owners: DataFrame, changes: DataFrame) -> DataFrame:
    """One owner for each (comparison, stage); a change without an owner takes the assignment away."""
    keys = ["comparison_id", "stage"]
    kept = owners.join(changes.select(*keys), keys, "left_anti")
    return kept.unionByName(changes.where(F.col("owner").isNotNull()).select(*kept.columns))
