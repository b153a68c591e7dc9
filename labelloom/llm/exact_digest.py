"""Canonical exact digests: Unicode normalisation, case and white space folding, then a wide xxHash.

Texts with one hash form a bucket. Buckets of two rows or more are compared byte by byte: the smallest and largest
canonical text of the bucket are equal if and only if all are, so no bucket is ever gathered. Where they differ, the
fingerprint gets a suffix that tells the texts apart.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut, text_or_empty

BROADCAST_FINGERPRINTS = 500_000  # 32 characters each: about 50 MB as a hash table
INNER, HEAD, TAIL = 0, 1, 2


def canonical(text: str) -> str:
    """Compatibility composition, full case folding, runs of white space as one space, none at the ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def wide_hash(canon: str) -> str:
    return xxhash.xxh3_128_hexdigest(canon.encode("utf-8", "surrogatepass"))


Hash = Callable[[str], str]


def fingerprints(docs: DataFrame, key: str = "doc_id", hashed: Hash = wide_hash) -> DataFrame:
    """(key, fingerprint, canon) of each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canon = [canonical(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(hashed, canon), type=pa.string()), pa.array(canon, type=pa.string())], [key, "fingerprint", "canon"])

    return docs.select(F.col(key).cast("long").alias(key), text_or_empty().alias("text")).mapInArrow(run, f"{key} long, fingerprint string, canon string")


def collisions(docs: DataFrame, counted: DataFrame, hashed: Hash = wide_hash) -> DataFrame:
    """Fingerprints that stand for different canonical texts. counted: (fingerprint) of every row of ``docs``."""
    shared = cut(counted.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "buckets")
    few = shared.limit(BROADCAST_FINGERPRINTS + 1).count() <= BROADCAST_FINGERPRINTS
    texts = fingerprints(docs, hashed=hashed).select("fingerprint", "canon")
    kept = texts.join(F.broadcast(shared) if few else shared.hint("merge"), "fingerprint", "left_semi")
    compared = kept.groupBy("fingerprint").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return compared.where("low <> high").select("fingerprint")


def _suffix(canon: str) -> str:
    return "-" + hashlib.sha256(canon.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def digest_groups(docs: DataFrame, hashed: Hash = wide_hash) -> DataFrame:
    """(doc_id, fingerprint, group_id, copies): rows with equal canonical texts share the smallest doc_id.

    A null text counts as empty; a null doc_id is kept and never names a group unless all its rows have none; repeated
    rows stay; an empty table gives an empty result; other columns are ignored.
    """
    table = cut(fingerprints(docs, hashed=hashed).select("doc_id", "fingerprint", F.xxhash64("canon").alias("second")), "digests")
    clash = collisions(docs, table.select("fingerprint"), hashed).withColumn("clash", F.lit(True))
    apart = table.join(clash, "fingerprint", "left").withColumn("fingerprint", F.when(F.col("clash"), F.concat_ws("-", "fingerprint", F.hex("second"))).otherwise(F.col("fingerprint")))
    groups = apart.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))
    return apart.select("doc_id", "fingerprint").join(groups, "fingerprint").select("doc_id", "fingerprint", "group_id", "copies")


def _compared(text: str, following: str, clash: frozenset[str], hashed: Hash) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of a text and its successor."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    canons = [canonical(text), canonical(edited), canonical(following)]
    prints = [hashed(c) for c in canons]
    prints = [p + _suffix(c) if p in clash else p for p, c in zip(prints, canons, strict=True)]
    near = [float(canons[0] == c) for c in canons[1:]]
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), prints[0], prints[1], *near


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [field.split()[0] for field in _RESULT.split(", ")]


def edited_likeness(docs: DataFrame, hashed: Hash = wide_hash) -> DataFrame:
    """See ``_likeness``; a second pass tells apart texts that share a hash, should there ever be any."""
    result = _likeness(docs, frozenset(), hashed)
    clash = frozenset(r["fingerprint"] for r in collisions(docs, result.select("fingerprint"), hashed).collect())
    return _likeness(docs, clash, hashed) if clash else result


def _likeness(docs: DataFrame, clash: frozenset[str], hashed: Hash) -> DataFrame:
    """Fingerprint of each text and of its edited version, whose second half is the next document's beginning.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The digest is
    exact, so a likeness is 1 for equal canonical texts and 0 otherwise. The next document is the one after it by
    doc_id, then by the text's hash and the text, null ids last, and the first one for the last; a single row follows itself. A null text counts
    as empty; repeated rows stay; an empty table gives an empty result; other columns are ignored.

    Rows are dealt by ranges of doc_id and hash, so that one id with many texts is more than one task. Each task pairs neighbours; the first and the last row of every range are
    handed on with their texts, and a second pass pairs a range's last row with the next range's first.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("h"))
    order = [F.asc_nulls_last("doc_id"), F.asc("h"), F.asc("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, before = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if before is None:
                    rows.append((*[None] * 7, pid, HEAD, text))
                else:
                    rows.append((before[0], *_compared(before[1], text, clash, hashed), pid, INNER, None))
                before = doc_id, text
            yield _batch(rows)
        if before is not None:
            yield _batch([(before[0], *[None] * 6, pid, TAIL, before[1])])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types, names = [*_TYPES, pa.int32(), pa.int32(), pa.string()], [*_NAMES, "pid", "role", "end_text"]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, types, strict=True)], names)

    dealt = ordered.repartitionByRange(*order[:2]).sortWithinPartitions(*order).drop("h")
    first = cut(dealt.mapInArrow(run, f"{_RESULT}, pid int, role int, end_text string"), "likeness")
    pids = sorted(r["pid"] for r in first.where(F.col("role") == HEAD).select("pid").collect())  # one number a task
    follows = spark.createDataFrame(list(zip(pids, pids[1:] + pids[:1], strict=True)), "pid int, next int")
    tails = first.where(F.col("role") == TAIL).select("pid", "doc_id", F.col("end_text").alias("text"))
    heads = first.where(F.col("role") == HEAD).select(F.col("pid").alias("next"), F.col("end_text").alias("following"))
    ends = tails.join(follows, "pid").join(heads, "next").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *_compared(t, f, clash, hashed)) for d, t, f in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _TYPES, strict=True)], _NAMES)

    return first.where(F.col("role") == INNER).select(*_NAMES).unionByName(ends.mapInArrow(finish, _RESULT))
