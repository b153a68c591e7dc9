"""File sources and sinks: annotation folders, manifests and training files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = (
    "brand_name string, product_name string, flavour string, marketing_company string, manufacturing_company string, address string, customer_care_number string, "
    "customer_care_email string, logo string, layout string, package_size string, fssai_number string, colour_theme array<string>, claims array<string>, ingredients array<string>, nutrition_table map<string,string>"
)
ANNOTATION = f"image_file string, sourceFile string, page int, reviewed boolean, reviewedAt long, isFront boolean, label struct<{LABEL.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map')}>"


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each JSON file of a folder; ``slug`` is the file's name without its ending."""
    rows = spark.read.schema(ANNOTATION).json(folder, multiLine=True, pathGlobFilter="*.json")
    return rows.withColumn("slug", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))


def manifest(spark: SparkSession, path: str, key: str = "sourceFile") -> DataFrame:
    """A tab-separated list with a header, and how many of its rows share the key."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.join(rows.groupBy(key).agg(F.count("*").alias("pages")), key)


def write_training(rows: DataFrame, folder: str, validation: str = "validation") -> None:
    """JSON lines in folder/split=train and folder/split=val."""
    split = F.when(F.col(validation), "val").otherwise("train")
    rows.withColumn("split", split).drop(validation).write.mode("overwrite").partitionBy("split").json(folder)


def write_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").csv(folder, header=True, quote='"', escape='"', emptyValue="")


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A table of a database, read in ``parts`` ranges of its key."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()
