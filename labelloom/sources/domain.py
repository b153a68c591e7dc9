"""The label domain laid over general tables: products, artworks, comparisons, history, label records and masters.

``SQL`` has the same tables as common table expressions for other engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUS = {"F": "Final Approved", "O": "Under Review", "P": "Draft"}
APPROVED = ["Approved", "Final Approved"]

# Which step of the approval chain an event stands for: stage, action, resulting status, the stage's role.
STEPS = {
    "view": ("Label Final", "Sent to Technical", "Pending Technical", "label_final"),
    "click": ("Technical", "Sent to QA", "Pending QA", "technical"),
    "purchase": ("QA", "Sent to Manager", "Pending Manager Approval", "qa"),
    "signup": ("Manager", "Final Approved", "Final Approved", "manager"),
    "error": ("QA", "Revision Requested", "Revision Required", "qa"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(value: Column, options: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, answer in options.items():
        out = F.when(value == key, answer).otherwise(out)
    return out


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's marketing company is its first supplier, the maker is that supplier's nation."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_suppkey").alias("s_suppkey"))
    part, supplier, nation = (table(spark, sf_dir, n) for n in ("part", "supplier", "nation"))
    made = first.join(supplier, "s_suppkey").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return part.join(made, part["p_partkey"] == made["id"]).select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand"),
        F.nullif(F.col("p_type"), F.lit("PROMO")).alias("flavour"),
        F.nullif(F.col("p_size") % 10, F.lit(0)).cast("string").alias("package_size"),
        F.col("s_name").alias("marketing_company"),
        F.col("n_name").alias("manufacturing_company"),
        F.when(F.col("p_partkey") % 5 != 0, F.lpad((F.col("p_partkey") % 50).cast("string"), 14, "1")).alias("fssai_number"),
        F.when(F.col("p_size") > 45, "Inactive").otherwise("Active").alias("status"),
    )


def artworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version line for each (product, type); ties of a day go by id."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("product_id"),
        F.col("o_orderpriority").alias("artwork_type"),
        chosen(F.col("o_orderstatus"), STATUS).alias("status"),
        F.col("o_orderdate").alias("uploaded_at"),
        F.col("o_totalprice").alias("byte_size"),
    )
    line = Window.partitionBy("product_id", "artwork_type").orderBy("uploaded_at", "id")
    return rows.withColumn("version_number", F.row_number().over(line)).select("id", "product_id", "artwork_type", "version_number", "status", "uploaded_at", "byte_size")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only log: one entry for each event of a comparison (user)."""
    kind = F.col("event_type")
    part = lambda i: chosen(kind, {k: v[i] for k, v in STEPS.items()})
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("comparison_id"),
        F.col("ts").alias("occurred_at"),
        part(0).alias("stage"),
        part(1).alias("action"),
        part(2).alias("resulting_status"),
        part(3).alias("actor_role"),
        F.concat(F.lit("user "), (F.col("user_id") % 7).cast("string")).alias("actor_name"),
        F.when(F.col("value") > 20, F.concat(F.lit("value "), F.floor("value").cast("string"))).alias("remarks"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of compared values for each part; some are absent."""
    part = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        key.alias("id"),
        F.col("p_name").alias("product_name"),
        F.col("p_brand").alias("brand_name"),
        F.nullif(F.col("p_type"), F.lit("PROMO")).alias("flavour"),
        F.when(key % 4 != 0, F.concat_ws(" ", F.lit("Supports"), "p_name", F.lower("p_type"))).alias("claims"),
        F.when(key % 6 != 0, F.concat_ws(", ", F.split("p_name", " ")[0], F.split("p_name", " ")[1], F.lower("p_type"))).alias("ingredients"),
        F.when(key % 5 != 0, F.lpad((key % 50).cast("string"), 14, "1")).alias("fssai_number"),
        F.when(F.col("p_size") % 10 != 0, F.concat((F.col("p_size") % 10).cast("string"), F.lit(" gummies"))).alias("package_size"),
        F.concat(F.lit("Company "), (key % 9).cast("string"), F.lit(" Ltd.")).alias("marketing_company"),
        F.concat(F.lit("care"), (key % 9).cast("string"), F.lit("@example.com")).alias("customer_care_email"),
        F.concat_ws(" ", (F.col("p_size") * 3).cast("string"), F.lit("Main Street"), F.split("p_name", " ")[0]).alias("address"),
    )


FIELDS = ["product_name", "brand_name", "flavour", "claims", "ingredients", "fssai_number", "package_size", "marketing_company", "customer_care_email", "address"]

_STATUS_SQL = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"


def _step_sql(i: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in STEPS.items()) + " END"


SQL = {
    "product": """product AS (
 SELECT p_partkey AS id, p_name AS product_name, p_brand AS brand, nullif(p_type, 'PROMO') AS flavour,
        nullif(p_size % 10, 0)::VARCHAR AS package_size, s_name AS marketing_company, n_name AS manufacturing_company,
        CASE WHEN p_partkey % 5 <> 0 THEN lpad((p_partkey % 50)::VARCHAR, 14, '1') END AS fssai_number,
        CASE WHEN p_size > 45 THEN 'Inactive' ELSE 'Active' END AS status
 FROM part JOIN (SELECT l_partkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey
 JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey)""",
    "artwork": f"""artwork AS (
 SELECT o_orderkey AS id, o_custkey AS product_id, o_orderpriority AS artwork_type,
        (row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey))::INTEGER AS version_number,
        {_STATUS_SQL} AS status, o_orderdate AS uploaded_at, o_totalprice AS byte_size FROM orders)""",
    "history": f"""history AS (
 SELECT event_id AS id, user_id AS comparison_id, ts AS occurred_at, {_step_sql(0)} AS stage, {_step_sql(1)} AS action,
        {_step_sql(2)} AS resulting_status, {_step_sql(3)} AS actor_role, 'user ' || (user_id % 7) AS actor_name,
        CASE WHEN value > 20 THEN 'value ' || floor(value)::BIGINT END AS remarks FROM events)""",
    "label": """label AS (
 SELECT p_partkey AS id, p_name AS product_name, p_brand AS brand_name, nullif(p_type, 'PROMO') AS flavour,
        CASE WHEN p_partkey % 4 <> 0 THEN 'Supports ' || p_name || ' ' || lower(p_type) END AS claims,
        CASE WHEN p_partkey % 6 <> 0 THEN split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2) || ', ' || lower(p_type) END AS ingredients,
        CASE WHEN p_partkey % 5 <> 0 THEN lpad((p_partkey % 50)::VARCHAR, 14, '1') END AS fssai_number,
        CASE WHEN p_size % 10 <> 0 THEN (p_size % 10) || ' gummies' END AS package_size,
        'Company ' || (p_partkey % 9) || ' Ltd.' AS marketing_company,
        'care' || (p_partkey % 9) || '@example.com' AS customer_care_email,
        (p_size * 3) || ' Main Street ' || split_part(p_name, ' ', 1) AS address FROM part)""",
}


def with_sql(names: str, query: str) -> str:
    """``query`` after the named domain tables (comma-separated) as common table expressions."""
    parts = [SQL[n.strip()] for n in names.split(",")]
    query = query.strip()
    return "WITH " + ",\n".join(parts) + (",\n" + query[5:] if query[:5].upper() == "WITH " else "\n" + query)
