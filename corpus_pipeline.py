"""A corpus from raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import secrets
from labelloom.llm.common import read, shared_dir
from labelloom.llm.language_id import identify, trained
from labelloom.llm.near_texts import one_of_each, text_key
from labelloom.llm.packing import pack
from labelloom.llm.substring_dedup import remove_repeats
from labelloom.sources.package import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of documents with a new text. Its length is taken one step later: inside one projection, a lambda
    that names ``text`` would see the new column of that name."""
    return docs.select("doc_id", text.alias("__text"), "lang", "source").select("doc_id", F.col("__text").alias("text"), "lang", "source", F.length("__text").cast("long").alias("n_chars"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those whose score is below the model's floor, so that the language is a guess."""
    model = trained(docs)
    named = identify(docs, model, COLUMNS[1:])
    return named.where((F.col("lang_pred") != "und") & (F.col("score") >= model.floor)).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join (five-word shingles, similarity 0.8 or more), the row with the smallest doc_id stays,
    a null id last; of rows with that id the one with the smallest text hash; of equal ones one."""
    keys = [F.coalesce("doc_id", F.lit(2**63 - 1)).alias("dk"), F.col("doc_id").isNull().alias("nameless")]
    kept = one_of_each(docs).select(*keys, "tk").distinct()  # components of texts that hash alike are one text
    joined = docs.select(*keys, text_key().alias("tk"), *COLUMNS).join(kept, ["dk", "nameless", "tk"], "left_semi")
    return joined.dropDuplicates(["dk", "nameless", "tk"]).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which nothing is left goes too."""
    found = remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept", F.col("dk"), F.col("tk"))
    changed = found.where((F.col("n_removed") > 0)).select("dk", "tk", "kept").dropDuplicates(["dk", "tk"])
    keyed = docs.withColumn("dk", F.coalesce("doc_id", F.lit(2**63 - 1))).withColumn("tk", F.xxhash64(F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))))
    joined = keyed.join(changed, ["dk", "tk"], "left").where(F.col("kept").isNull() | (F.col("kept") != ""))
    return _with_text(joined, F.coalesce("kept", "text"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; documents stay."""
    found = secrets.secret_spans(docs, COLUMNS[1:])
    return _with_text(found, secrets.redacted(F.col("text"), F.concat("base", "added")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left."""
    return pack(docs, added_tokens=True)


STAGES = [("language ID", language), ("SimHash near-dedup", one_of_each_group), ("substring dedup", without_repeats), ("secret scan", without_secrets), ("packing", packed)]

#: Language ID, the Markov models and tokenisation have no SQL; tests/llm/test_pipeline.py follows the stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
