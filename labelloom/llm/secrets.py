"""Secret scan: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Both models are first-order chains over the 66 characters of tokens, counted from labelled samples: values that the
patterns find and digests of numbers as random strings, words of a sample of documents as ordinary ones. A token is
a secret if its log-likelihood ratio is high. Everything runs as column expressions.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut, text_or_empty
from labelloom.llm.spans import apart, find_spans, joined, none, of_kind, replaced

KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"  # of 20 characters or more; a shorter match holds no longer one
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
ALPHABET = string.ascii_letters + string.digits + "+/_-"
SAMPLE_DOCUMENTS = 2000
DIGESTS = 4096
LONG_WORD = 64
MIN_RATIO = 20.0  # natural logarithm: beyond the odds against a secret among all tokens of a large corpus


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, group 2 of an assignment having 6 characters or more."""
    assigned = F.filter(find_spans(text, ASSIGN, 0), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 1)) >= 6)
    access = F.when(F.contains(text, F.lit("AKIA")), find_spans(text, ACCESS, 1)).otherwise(none())
    return F.concat(assigned, access, find_spans(text, HEX, 2))


def _transitions(token: Column) -> Column:
    """Every two neighbouring characters, in one pass."""
    return F.regexp_extract_all(token, F.lit("(?s)(?=(..))"), F.lit(1))


def _pairs(tokens: DataFrame) -> DataFrame:
    """(label, pair, n) of tokens (label, token)."""
    long = tokens.where(F.length("token") > 1)
    pairs = long.select("label", F.explode(_transitions(F.col("token"))).alias("pair"))
    return pairs.groupBy("label", "pair").agg(F.count("*").alias("n"))


def _values(span: Column) -> Column:
    return F.when(span["k"] == 0, F.regexp_extract(span["m"], ASSIGN, 1)).otherwise(span["m"])


def train(docs: DataFrame, found: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> list[float]:
    """Log-likelihood ratios of the 66 * 66 transitions, random against ordinary.

    found: (base) spans of every document, all of which count. Ordinary words come from ``sample`` documents in the
    mean, whose hash of doc_id and text falls below that share; the random digests are of fixed number.
    """
    spark, size = docs.sparkSession, max(1, found.count())
    low = F.lit(min(1.0, sample / size) * 2.0**64 - 2.0**63)
    chosen = docs.where(F.xxhash64("doc_id", "text").cast("double") < low)
    cleared = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = chosen.select(F.lit(0).alias("label"), F.explode(F.regexp_extract_all(cleared, F.lit(r"[A-Za-z_][A-Za-z0-9_/-]+"), F.lit(0))).alias("token"))
    ordinary = ordinary.where(F.length("token") < LONG_WORD)  # one long blob must not outweigh the words
    valued = found.select(F.explode("base").alias("x")).select(F.lit(1).alias("label"), _values(F.col("x")).alias("token")).distinct()  # one value in many documents counts once
    digest = F.unhex(F.sha2(F.col("id").cast("string"), 256))
    random = spark.range(DIGESTS).select(F.lit(1).alias("label"), F.explode(F.array(F.translate(F.base64(digest), "=\r\n", ""), F.lower(F.hex(digest)))).alias("token"))
    counted = _pairs(ordinary).unionByName(_pairs(valued)).unionByName(_pairs(random)).groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    n = len(ALPHABET)
    counts = [[0.5] * n * n for _ in range(2)]
    for r in counted:
        if all(c in ALPHABET for c in r["pair"]):
            counts[r["label"]][ALPHABET.index(r["pair"][0]) * n + ALPHABET.index(r["pair"][1])] += r["n"]
    logs = [[math.log(c[i] / sum(c[i - i % n : i - i % n + n])) for i in range(n * n)] for c in counts]
    return [a - b for b, a in zip(*logs, strict=True)]


def ratio(token: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of the token's transitions."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    code = lambda pair, i: F.instr(F.lit(ALPHABET), F.substring(pair, i, 1)) - 1
    return F.aggregate(_transitions(token), F.lit(0.0), lambda acc, p: acc + F.coalesce(F.get(table, code(p, 1) * len(ALPHABET) + code(p, 2)), F.lit(0.0)))


def secret_spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and columns ``keep``), base and added: the spans of the patterns and those of the Markov models.

    A null or empty text has none; a null doc_id is kept; repeated rows stay; an empty table gives an empty result;
    columns not kept are ignored. Texts are searched whole.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    columns = ["doc_id", *(keep or [])]
    text = text_or_empty()
    found = cut(docs.select(*columns, base_spans(text).alias("base"), find_spans(text, TOKEN, 3).alias("tokens")), "secrets")
    ratios = train(texts, found.select("base"))
    added = F.filter(apart(F.col("tokens"), F.col("base")), lambda x: ratio(x["m"], ratios) >= MIN_RATIO)
    return found.select(*columns, "base", added.alias("added"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_spans of every document; see ``secret_spans``."""
    found = secret_spans(docs)
    counts = [of_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    every = F.concat("base", "added")
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(every, KINDS).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans are one."""
    return replaced(text, spans, mark)
