"""First non-blank value from a cascade of readers, with where it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import blank, blank_to_null
from labelloom.operators.extract import is_garbage, is_non_answer
from labelloom.operators.resolve import snapped

CORE = ["product_name", "brand_name", "flavour", "claims", "ingredients", "fssai_number", "package_size", "marketing_company"]
MODELS = ["vlm", "llm"]
# What single lines of a reader may not fill.
REFUSED = ["brand_name", "product_name", "address", "customer_care_number", "flavour", "marketing_company"]
FLAT, ORDERED, SNAPPED = "text-layer-flattened", "text-layer-reading-order", "master-snap"


def tagged(value: Column, source: str, confidence: Column | None = None) -> Column:
    """struct(value, source, confidence, needs_review), null for a blank value; model sources need review."""
    v = blank_to_null(value)
    meta = F.struct(v.alias("value"), F.lit(source).alias("source"), (confidence if confidence is not None else F.lit(None).cast("double")).alias("confidence"), F.lit(source in MODELS).alias("needs_review"))
    return F.when(~blank(value), meta)


def first_filled(*readings: Column) -> Column:
    """The first reading that has a value; what is known about it follows it."""
    return F.coalesce(*readings)


def merged(records: DataFrame, key: str, fields: list[str], sources: list[str], overridable: str | None = None) -> DataFrame:
    """(key, field, value, source, needs_review) from columns ``source_field`` in the order of ``sources``.

    A product name that only matches ``overridable`` (a bare form word) gives way to any later reading.
    """
    rows = []
    for f in fields:
        readings = [tagged(F.col(f"{s}_{f}"), s) for s in sources]
        if overridable and f == "product_name":
            strong = [F.when(~F.col(f"{s}_{f}").rlike(f"(?i)^\\s*(?:{overridable})\\s*$"), r) for s, r in zip(sources, readings, strict=True)]
            readings = strong + readings
        rows.append(F.struct(F.lit(f).alias("field"), first_filled(*readings).alias("r")))
    each = records.select(key, F.explode(F.array(*rows)).alias("x"))
    return each.select(key, "x.field", "x.r.value", "x.r.source", "x.r.needs_review").where(F.col("value").isNotNull())


def merged_layers(flat: DataFrame, ordered: DataFrame, key: str, fields: list[str], brands: DataFrame | None = None, master: str = "brand") -> DataFrame:
    """(key, field, value, source) of the same text read twice, flattened and in reading order; the first one wins.

    Garbage is no brand and no product name. With ``brands`` (a column ``master``) a brand that snaps to none of them is
    blank, and the source of one that does is the snap.
    """
    both = flat.select(key, F.struct(*fields).alias("f")).join(ordered.select(key, F.struct(*fields).alias("o")), key, "full")
    rows = []
    for field in fields:
        for rank, (side, source) in enumerate((("f", FLAT), ("o", ORDERED))):
            value = blank_to_null(F.col(side)[field])
            value = F.when(~is_garbage(value), value) if field in ("brand_name", "product_name") else value
            rows.append(F.struct(F.lit(field).alias("field"), F.lit(rank).alias("rank"), value.alias("value"), F.lit(source).alias("source")))
    each = both.select(key, F.explode(F.array(*rows)).alias("x")).select(key, "x.*").where("value IS NOT NULL")
    if brands is not None:
        named = each.where("field = 'brand_name'")
        found = snapped(named, "value", brands, master, master).select("value", "master")
        kept = named.join(found, "value").select(key, "field", "rank", F.col("master").alias("value"), F.lit(SNAPPED).alias("source"))
        each = each.where("field <> 'brand_name'").unionByName(kept)
    return each.groupBy(key, "field").agg(F.min(F.struct("rank", "value", "source")).alias("x")).select(key, "field", "x.value", "x.source")


def patched(records: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Blank fields filled from a reader's single lines, except those that such lines may not fill."""
    filled = [c if c in REFUSED else F.coalesce(F.when(~blank(F.col(f"r.{c}")), F.col(f"r.{c}")), F.col(f"p.{c}")).alias(c) for c in fields]
    joined = records.alias("r").join(patch.alias("p"), F.col(f"r.{key}") == F.col(f"p.{key}"), "left")
    return joined.select(F.col(f"r.{key}").alias(key), *[F.col(f"r.{c}") if isinstance(c, str) else c for c in filled])


def is_complete(fields: list[str] | None = None) -> Column:
    return F.forall(F.array(*[~blank(F.col(c)) for c in fields or CORE]), lambda x: x)


def filled_by_model(current: Column, answer: Column, triggered: Column, overwrite: bool = False) -> Column:
    """A model's answer where a trigger field is blank; it never replaces a value unless listed, and non-answers are refused."""
    usable = triggered & ~blank(answer) & ~F.coalesce(is_non_answer(answer), F.lit(False))
    return F.when(usable & (F.lit(overwrite) | blank(current)), answer).otherwise(current)


def kept_meta(meta: Column, record: Column) -> Column:
    """Provenance of fields that still have a value in a map field → value."""
    return F.map_filter(meta, lambda k, _: ~F.coalesce(F.trim(record[k]) == "", F.lit(True)))


def retry_targets(asked: Column, answered: Column) -> Column:
    """struct(omitted, hollow): fields that the answer lacks and fields that it leaves blank."""
    keys = F.map_keys(answered)
    hollow = F.filter(keys, lambda k: F.coalesce(F.trim(answered[k]) == "", F.lit(True)) & F.array_contains(asked, k))
    return F.struct(F.array_except(asked, keys).alias("omitted"), F.array_sort(hollow).alias("hollow"))


def merged_lists(primary: Column, secondary: Column) -> Column:
    """Union without regard to case; the primary spelling wins."""
    low = F.transform(primary, lambda x: F.lower(x))
    return F.concat(primary, F.filter(secondary, lambda x: ~F.array_contains(low, F.lower(x))))


def agreed(primary: Column, secondary: Column, cap: int = 12) -> Column:
    """Items in both reads, without regard to case, ``cap`` at most (part of the feature)."""
    low = F.transform(secondary, lambda x: F.lower(x))
    return F.slice(F.filter(primary, lambda x: F.array_contains(low, F.lower(x))), 1, cap)
