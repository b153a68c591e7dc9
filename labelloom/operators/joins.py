"""Joins between products, artworks, comparisons and their logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import folded, or_dash
from labelloom.operators.windows import best_row


def with_children(parents: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """Parents with arrays of their child rows; each child set is (rows, order) and is collected before it is joined."""
    out = parents
    for name, (rows, order) in children.items():
        rest = [c for c in rows.columns if c != key]
        struct = F.struct(*order, *[c for c in rest if c not in order])
        out = out.join(rows.groupBy(key).agg(F.array_sort(F.collect_list(struct)).alias(name)), key, "left")
    return out


def cross_company(products: DataFrame, baselines: DataFrame, ignore_case: bool = True) -> DataFrame:
    """(id, candidates, first): of each product, how many products of its name have an approved artwork at another
    company, and the smallest of them. Counts and minima of each (name, company) give both; no pairs are made."""
    fold = folded if ignore_case else (lambda c: F.trim(F.col(c)))
    own = products.select("id", folded("product_name").alias("name"), fold("marketing_company").alias("company"))
    usable = own.join(baselines.select(F.col("product_id").alias("id")).distinct(), "id", "left_semi")
    each = usable.groupBy("name", "company").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    first = each.groupBy("name").agg(F.sum("n").alias("all"), F.min(F.struct("least", "company")).alias("best"))
    second = each.join(first, "name").where(F.col("company") != F.col("best.company")).groupBy("name").agg(F.min("least").alias("next"))
    known = own.join(first, "name").join(second, "name", "left").join(each.select("name", "company", "n"), ["name", "company"], "left")
    other = F.when(F.col("best.company") != F.col("company"), F.col("best.least")).otherwise(F.col("next"))
    return known.select("id", (F.col("all") - F.coalesce("n", F.lit(0))).alias("candidates"), other.alias("first")).where("candidates > 0")


def cross_company_candidates(wanted: DataFrame, products: DataFrame, baselines: DataFrame) -> DataFrame:
    """(id, candidate) for a stated set of products: every candidate of each, by company."""
    other = products.join(baselines.select(F.col("product_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("candidate"), folded("product_name").alias("name"), folded("marketing_company").alias("other_company"))
    asked = wanted.select("id", folded("product_name").alias("name"), folded("marketing_company").alias("company"))
    return asked.join(other, "name").where(F.col("company") != F.col("other_company")).select("id", "candidate")


def cross_company_counts(products: DataFrame) -> DataFrame:
    """How many products of the same name other companies have, without making the pairs."""
    named = products.select("id", folded("product_name").alias("name"), folded("marketing_company").alias("company"))
    by_name = named.groupBy("name").agg(F.count("*").alias("all"))
    by_company = named.groupBy("name", "company").agg(F.count("*").alias("own"))
    both = by_company.join(by_name, "name").select("name", "company", (F.col("all") - F.col("own")).alias("others"))
    return named.join(both, ["name", "company"]).select("id", "others")


def possible_duplicates(records: DataFrame, products: DataFrame, with_brand: bool = True, order: str = "id") -> DataFrame:
    """Each record's first product of the same name (and brand) whose company or licence number is the same."""
    keys = ["product_name"] + ["brand"] * with_brand
    left = records.select(F.col("id").alias("record_id"), *[folded(k).alias(k) for k in keys], folded("marketing_company").alias("company"), F.nullif(F.trim("fssai_number"), F.lit("")).alias("licence"))
    sides = []
    for extra, column in (("company", folded("marketing_company")), ("licence", F.nullif(F.trim("fssai_number"), F.lit("")))):
        right = products.select(F.col("id"), *[folded(k).alias(k) for k in keys], column.alias(extra)).where(F.col(extra).isNotNull())
        firsts = right.groupBy(*keys, extra).agg(F.min(order).alias("product_id"))
        sides.append(left.join(firsts, [*keys, extra]).select("record_id", "product_id"))
    return sides[0].unionByName(sides[1]).groupBy("record_id").agg(F.min("product_id").alias("product_id"))


def identity_cascade(records: DataFrame, links: DataFrame, by_duplicate: DataFrame, by_identification: DataFrame) -> DataFrame:
    """An explicit link wins, then a duplicate, then an identification; else the record is new."""
    step = lambda df, name: df.select(F.col("record_id").alias("id"), F.col("product_id").alias(name))
    out = records.select("id")
    for df, name in ((links, "linked"), (by_duplicate, "duplicate"), (by_identification, "identified")):
        out = out.join(step(df, name), "id", "left")
    found = F.coalesce("linked", "duplicate", "identified")
    how = F.when(F.col("linked").isNotNull(), "linked").when(F.col("duplicate").isNotNull(), "duplicate").when(F.col("identified").isNotNull(), "identified").otherwise("new")
    return out.select("id", found.alias("product_id"), how.alias("how"))


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join with a dash where nothing is found."""
    return rows.join(lookup.select(key, *columns), key, "left").withColumns({c: or_dash(c) for c in columns})


def last_by_name(users: DataFrame, name: str, order: str) -> DataFrame:
    """One row a name; of equal names the last wins."""
    return best_row(users, [name], F.col(order))


def overrides_map(rows: DataFrame, key: str, name: str, value: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(name, value)))
    return rows.groupBy(key).agg(F.map_from_entries(entries).alias("overrides"))


def allowed(defaults: Column, overrides: Column) -> Column:
    """A role's policy overlaid by a user's stored overrides."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.coalesce(F.map_contains_key(overrides, k), F.lit(False))), F.coalesce(overrides, F.create_map().cast("map<string,boolean>")))


def nutrition_pairs(left: DataFrame, right: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Full outer join of two nutrition tables on (keys, folded nutrient); the left spelling is shown."""
    side = lambda df, v: df.select(*keys, F.lower(F.regexp_replace(F.trim(F.col(name)), r"\s+", " ")).alias("k"), F.col(name).alias(f"{v}_name"), F.col(value).alias(v))
    both = side(left, "a").join(side(right, "b"), [*keys, "k"], "full")
    return both.select(*keys, F.coalesce("a_name", "b_name").alias(name), "a", "b")


def box_overlaps(a: DataFrame, b: DataFrame, page: str, cell: float) -> DataFrame:
    """Overlap of boxes of two sets on a page: (a_id, b_id, area, iou). Boxes meet in grid cells, not all with all.

    Both sets have columns id, x0, y0, x1, y1 and the page. A pair is made in the cell that holds the corner of its
    overlap, so it is made once.
    """
    def cells(df: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))
        renamed = df.select(F.col(page), *[F.col(c).alias(f"{p}_{c}") for c in ("id", "x0", "y0", "x1", "y1")])
        return renamed.withColumn("cx", span(f"{p}_x0", f"{p}_x1")).withColumn("cy", span(f"{p}_y0", f"{p}_y1"))

    met = cells(a, "a").join(cells(b, "b"), [page, "cx", "cy"])
    left, top = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    width, height = F.least("a_x1", "b_x1") - left, F.least("a_y1", "b_y1") - top
    once = (F.floor(left / cell) == F.col("cx")) & (F.floor(top / cell) == F.col("cy"))
    area = lambda p: (F.col(f"{p}_x1") - F.col(f"{p}_x0")) * (F.col(f"{p}_y1") - F.col(f"{p}_y0"))
    kept = met.where((width > 0) & (height > 0) & once)
    return kept.select(page, "a_id", "b_id", (width * height).alias("area"), (width * height / (area("a") + area("b") - width * height)).alias("iou"))
