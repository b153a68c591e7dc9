"""The seven reports. Each honours its own filters, and those alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import or_dash
from labelloom.operators.tables import contains_any, equals_all, within_dates
from labelloom.operators.windows import days_since, last_entry, with_latest_flag
from labelloom.operators.workflow import WAITING


def _filtered(df: DataFrame, filters: dict, date: str, equal: list[str]) -> DataFrame:
    found = df.where(within_dates(date, filters.get("date_from"), filters.get("date_to")))
    return found.where(equals_all({c: filters.get(c) for c in equal}))


def label_comparison(comparisons: DataFrame, products: DataFrame, filters: dict | None = None) -> DataFrame:
    named = products.select(F.col("id").alias("product_id"), "product_name", "brand", "marketing_company", "manufacturing_company")
    rows = comparisons.join(named, "product_id", "left").withColumns({c: or_dash(c) for c in named.columns[1:]})
    rows = _filtered(rows, filters or {}, "updated_at", ["product_id", "brand", "marketing_company", "manufacturing_company", "status", "version_number"])
    return rows.orderBy(F.desc_nulls_last("updated_at"), "id")


def pending_verification(comparisons: DataFrame, log: DataFrame, as_of: Column, filters: dict | None = None) -> DataFrame:
    """Waiting comparisons by stage and days since the last entry (or, without one, the last update)."""
    stage = F.create_map(*[F.lit(x) for kv in WAITING.items() for x in kv])[F.col("status")]
    entered = last_entry(log).select("comparison_id", F.col("occurred_at").alias("__e"))
    rows = comparisons.where(F.col("status").isin(*WAITING)).join(entered, "comparison_id", "left")
    since = F.coalesce(F.col("__e"), F.col("updated_at"))
    rows = rows.withColumns({"stage": stage, "entered_at": since, "days_pending": days_since(since, as_of)}).drop("__e")
    return _filtered(rows, filters or {}, "submitted_at", ["product_id", "brand", "marketing_company", "status", "version_number"]).orderBy(F.desc("days_pending"), "comparison_id")


def approved_labels(comparisons: DataFrame, log: DataFrame, filters: dict | None = None) -> DataFrame:
    manager = last_entry(log, (F.col("stage") == "Manager") & (F.col("resulting_status") == "Final Approved"))
    approver = manager.select("comparison_id", F.col("actor_name").alias("approver"), F.col("occurred_at").alias("approved_at"))
    rows = comparisons.where(F.col("status") == "Final Approved").join(approver, "comparison_id", "left")
    rows = rows.withColumns({"approver": F.coalesce("approver", "updated_by"), "approved_at": F.coalesce("approved_at", "updated_at")})
    return _filtered(rows, filters or {}, "approved_at", ["product_id", "brand", "marketing_company", "manufacturing_company", "version_number"]).orderBy(F.desc_nulls_last("approved_at"), "comparison_id")


def rejected_or_revision(comparisons: DataFrame, log: DataFrame, scope: str = "both", filters: dict | None = None) -> DataFrame:
    wanted = {"both": ["Rejected", "Revision Required"], "rejected": ["Rejected"], "revision": ["Revision Required"]}[scope]
    last = last_entry(log).select("comparison_id", "stage", F.col("actor_name").alias("reviewer"), F.col("action").alias("decision"), "remarks", F.col("occurred_at").alias("date"))
    rows = comparisons.where(F.col("status").isin(wanted)).join(last, "comparison_id", "left")
    remarks = or_dash(F.coalesce(F.nullif(F.trim("remarks"), F.lit("")), F.col("qa_remarks")))
    return _filtered(rows.withColumn("remarks", remarks), filters or {}, "date", ["product_id", "marketing_company"]).orderBy(F.desc_nulls_last("date"), "comparison_id")


def artwork_history(artworks: DataFrame, group: list[str], filters: dict | None = None) -> DataFrame:
    rows = with_latest_flag(artworks, group).withColumn("archived_at", F.when(F.col("status") == "Archived", F.col("updated_at")))
    return _filtered(rows, filters or {}, "uploaded_at", ["product_id", "brand", "marketing_company", "manufacturing_company", "status", "version_number"]).orderBy(F.desc_nulls_last("uploaded_at"), "id")


def approval_history(log: DataFrame, filters: dict | None = None) -> DataFrame:
    f = filters or {}
    rows = log.withColumn("assignee", F.coalesce("assignee", F.lit("Unassigned")))
    rows = _filtered(rows, f, "occurred_at", ["product_id", "resulting_status"]).where(contains_any(["actor_name"], f.get("user")))
    return rows.orderBy(F.asc_nulls_last("occurred_at"), "id")


def user_activity(uploads: DataFrame, comparisons: DataFrame, log: DataFrame, roles: DataFrame, filters: dict | None = None) -> DataFrame:
    """Uploads, creations and decisions as one list (user, role, activity, reference_id, at)."""
    f = filters or {}
    event = lambda df, activity, user, at: df.select(F.col(user).alias("user"), F.lit(activity).alias("activity"), F.col("id").alias("reference_id"), F.col(at).alias("at"))
    rows = event(uploads, "Artwork uploaded", "uploaded_by", "uploaded_at").unionByName(event(comparisons, "Comparison created", "created_by", "created_at")).unionByName(event(log, "Decision recorded", "actor_name", "occurred_at"))
    rows = rows.join(roles.select(F.col("actor_name").alias("user"), "role"), "user", "left").withColumn("role", or_dash("role"))
    return rows.where(within_dates("at", f.get("date_from"), f.get("date_to")) & contains_any(["user"], f.get("user"))).orderBy(F.desc_nulls_last("at"), "activity", "reference_id")
