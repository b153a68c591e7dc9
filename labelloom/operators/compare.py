"""Record comparison: three text engines, nutrition tables, vectors and image fingerprints.

The engines differ on purpose: the weighted one (edit distance or shared words), the parameter one (Jaccard) and the
service one (embeddings) keep their own rules for absence, likeness and credit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.text import blank, comparable, folded, jaccard, shared_words
from labelloom.operators.aggregates import mean_of_points, verdict, weighted_score
from labelloom.operators.windows import best_row

EDIT_SHARE, OVERLAP, JACCARD = 0.25, 0.4, 0.6
MATCH_COSINE, SIMILAR_COSINE = 0.85, 0.65
HASH_BITS, MATCH_BITS, SIMILAR_BITS = 64, 4, 12
MATCH_COLOURS, SIMILAR_COLOURS = 0.85, 0.6
WEIGHTS = {
    "brand_name": 3, "product_name": 3, "marketing_company": 3, "fssai_number": 3, "flavour": 2, "package_size": 2, "claims": 2,
    "ingredients": 2, "address": 2, "customer_care_email": 2, "colour_theme": 2, "nutrition_table_format": 2, "customer_care_number": 2, "manufacturing_company": 1,
}
OWN_COMPANY_FIELDS = ["address", "customer_care_number", "customer_care_email"]


def is_similar(a: Column, b: Column) -> Column:
    return _alike(comparable(a), comparable(b))


def _alike(x: Column, y: Column) -> Column:
    """Likeness of two comparable forms. Shared words are looked at first, and the edit distance, which is the work,
    only where the lengths leave room for it."""
    longer = F.greatest(F.length(x), F.length(y), F.lit(1))
    close = (F.abs(F.length(x) - F.length(y)) / longer <= EDIT_SHARE) & (F.levenshtein(x, y) / longer <= EDIT_SHARE)
    return (x != "") & (y != "") & ((shared_words(x, y) >= OVERLAP) | close)


def five_state(a: Column, b: Column, x: Column | None = None, y: Column | None = None) -> Column:
    """NOT_COMPARED, MISSING, MATCH, SIMILAR or CONFLICT. x and y: columns that hold the comparable forms already."""
    x, y = comparable(a) if x is None else x, comparable(b) if y is None else y
    return F.when(blank(a) & blank(b), "NOT_COMPARED").when(blank(a) | blank(b), "MISSING").when(x == y, "MATCH").when(_alike(x, y), "SIMILAR").otherwise("CONFLICT")


def credit(status: Column) -> Column:
    return F.when(status == "MATCH", 1.0).when(status == "SIMILAR", 0.5).otherwise(0.0)


def parameter_state(a: Column, b: Column) -> Column:
    """MISSING before anything else, then equal, then Jaccard of alphanumeric words."""
    return F.when(blank(a) | blank(b), "MISSING").when(folded(a) == folded(b), "MATCH").when(jaccard(a, b) >= JACCARD, "SIMILAR").otherwise("CONFLICT")


def exact_state(a: Column, b: Column) -> Column:
    return F.when(blank(a) | blank(b), "MISSING").when(a == b, "MATCH").otherwise("CONFLICT")


def field_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(a_id, b_id, field, a, b): both records of each pair, unpivoted after the joins."""
    side = lambda df, p: df.select(F.col(key).alias(f"{p}_id"), F.struct(*fields).alias(f"{p}_r"))
    joined = pairs.select("a_id", "b_id").join(side(a, "a"), "a_id").join(side(b, "b"), "b_id")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_r.{f}").cast("string").alias("a"), F.col(f"b_r.{f}").cast("string").alias("b")) for f in fields])
    return joined.select("a_id", "b_id", F.explode(each).alias("x")).select("a_id", "b_id", "x.*")


def record_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """(a_id, b_id, a, b): both records of each pair as structs of texts."""
    side = lambda df, p: df.select(F.col(key).alias(f"{p}_id"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(p))
    return pairs.select("a_id", "b_id").join(side(a, "a"), "a_id").join(side(b, "b"), "b_id").select("a_id", "b_id", "a", "b")


def weighted_records(paired: DataFrame, fields: list[str], same_company: bool = False) -> DataFrame:
    """Score and counts of states of every pair of records, each pair within its own row."""
    kept = [f for f in fields if not (same_company and f in OWN_COMPANY_FIELDS)]
    sides = F.array(*[F.struct(F.lit(WEIGHTS[f]).alias("w"), F.col("a")[f].alias("a"), F.col("b")[f].alias("b")) for f in kept])
    forms = F.transform(sides, lambda f: F.struct(f["w"].alias("w"), f["a"].alias("a"), f["b"].alias("b"), comparable(f["a"]).alias("x"), comparable(f["b"]).alias("y")))
    states = F.transform(forms, lambda f: F.struct(f["w"].alias("w"), five_state(f["a"], f["b"], f["x"], f["y"]).alias("s")))
    judged = paired.select("a_id", "b_id", states.alias("__s"))
    compared = F.filter("__s", lambda f: f["s"] != "NOT_COMPARED")
    total = F.aggregate(compared, F.lit(0), lambda t, f: t + f["w"])
    points = F.aggregate(compared, F.lit(0.0), lambda t, f: t + credit(f["s"]) * f["w"])
    score = F.coalesce(F.round(points / F.nullif(total, F.lit(0)) * 100), F.lit(0.0)).cast("int")
    tally = lambda s: F.size(F.filter("__s", lambda f: f["s"] == s)).cast("long")
    return judged.select("a_id", "b_id", score.alias("score"), *[tally(s).alias(s.lower()) for s in ("MATCH", "SIMILAR", "CONFLICT", "MISSING", "NOT_COMPARED")])


def parameter_records(paired: DataFrame, fields: list[str]) -> DataFrame:
    """Overall similarity, verdict and coverage of every pair of records, each pair within its own row."""
    sides = F.array(*[F.struct(F.col("a")[f].alias("a"), F.col("b")[f].alias("b")) for f in fields])
    results = F.transform(sides, lambda f: parameter_state(f["a"], f["b"]))
    judged = paired.select("a_id", "b_id", results.alias("results"))
    covered = F.size(F.filter("results", lambda r: r != "MISSING")).cast("long")
    return parameter_summary(judged.withColumns({"comparable": covered, "total": F.lit(len(fields)).cast("long")}), "results")


def weighted_fields(rows: DataFrame, same_company: bool = False) -> DataFrame:
    """Field rows with status, similarity and weight; within one company its own contact fields are left out."""
    kept = rows.where(~F.col("field").isin(OWN_COMPANY_FIELDS)) if same_company else rows
    forms = kept.withColumns({"__x": comparable("a"), "__y": comparable("b")})  # once a row, not once a rule
    status = five_state(F.col("a"), F.col("b"), F.col("__x"), F.col("__y"))
    weight = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    return forms.withColumn("status", status).drop("__x", "__y").withColumns({"similarity": credit(F.col("status")), "weight": weight[F.col("field")]})


def weighted_comparison(rows: DataFrame, keys: tuple[str, ...] = ("a_id", "b_id")) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("MATCH", "SIMILAR", "CONFLICT", "MISSING", "NOT_COMPARED")]
    return rows.groupBy(*keys).agg(weighted_score().alias("score"), *counts)


def parameter_comparison(rows: DataFrame, keys: tuple[str, ...] = ("a_id", "b_id")) -> DataFrame:
    """Overall similarity, verdict and coverage of parameter rows (a, b)."""
    judged = rows.withColumn("result", parameter_state(F.col("a"), F.col("b")))
    coverage = F.count_if(F.col("result") != "MISSING")
    return judged.groupBy(*keys).agg(mean_of_points().alias("overall"), verdict().alias("verdict"), coverage.alias("comparable"), F.count("*").alias("total"))


def parameter_summary(rows: DataFrame, results: str) -> DataFrame:
    """Overall similarity and verdict of an array of parameter results, without leaving the row."""
    points = F.transform(F.filter(results, lambda r: r != "MISSING"), lambda r: F.when(r == "MATCH", 100).when(r == "SIMILAR", 65).otherwise(0))
    mean = F.aggregate(points, F.lit(0), lambda s, x: s + x) / F.nullif(F.size(points), F.lit(0))
    has = lambda *names: F.exists(results, lambda r: r.isin(*names))
    judged = F.when(has("CONFLICT"), "CONFLICT").when(has("SIMILAR", "MISSING") | (F.size(results) == 0), "REVIEW REQUIRED").otherwise("MATCH")
    return rows.withColumns({"overall": F.coalesce(F.round(mean), F.lit(0.0)).cast("int"), "verdict": judged}).drop(results)


def nutrition_state(a: Column, b: Column) -> Column:
    """Amounts of one nutrient: never NOT_COMPARED."""
    return F.when(blank(a) | blank(b), "MISSING").when(comparable(a) == comparable(b), "MATCH").when(is_similar(a, b), "SIMILAR").otherwise("CONFLICT")


def nutrition_comparison(rows: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Rows (key, nutrient, a, b, status) of two JSON texts; text that is no JSON object counts as no table."""
    parsed = lambda c: F.from_json(F.col(c), "map<string,string>")
    tidy = lambda k: F.lower(F.regexp_replace(F.trim(k), r"\s+", " "))
    entries = lambda c: F.coalesce(F.transform(F.map_entries(parsed(c)), lambda e: F.struct(tidy(e["key"]).alias("k"), e["key"].alias("name"), e["value"].alias("v"))), F.array().cast("array<struct<k:string,name:string,v:string>>"))
    sides = rows.select(key, entries(a).alias("__a"), entries(b).alias("__b"))
    first = lambda items, k: F.element_at(F.filter(items, lambda x: x["k"] == k), 1)
    names = F.array_sort(F.array_union(F.transform("__a", lambda x: x["k"]), F.transform("__b", lambda x: x["k"])))
    guard = lambda items, k: F.when(F.exists(items, lambda x: x["k"] == k), first(items, k))
    pairs = F.transform(names, lambda k: F.struct(F.coalesce(guard(F.col("__a"), k)["name"], guard(F.col("__b"), k)["name"]).alias("nutrient"), guard(F.col("__a"), k)["v"].alias("a"), guard(F.col("__b"), k)["v"].alias("b")))
    each = sides.select(key, F.explode(pairs).alias("x")).select(key, "x.*")
    return each.withColumn("status", nutrition_state(F.col("a"), F.col("b")))


# vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def cosine_state(value: Column) -> Column:
    return F.when(value.isNull(), "MISSING").when(value >= MATCH_COSINE, "MATCH").when(value >= SIMILAR_COSINE, "SIMILAR").otherwise("CONFLICT")


def list_likeness(a: Column, b: Column) -> Column:
    """Mean over a of the best cosine in b, averaged with the reverse; both are short arrays of vectors."""
    best = lambda x, others: F.array_max(F.transform(others, lambda y: cosine(x, y)))
    mean = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: best(x, ys)), F.lit(0.0), lambda s, v: s + v) / F.size(xs)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise((mean(a, b) + mean(b, a)) / 2)


def service_points(status: Column) -> Column:
    return F.when(status == "MATCH", 2).when(status == "SIMILAR", 1).otherwise(0)


# fingerprints


def hash_distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_state(distance: Column) -> Column:
    return F.when(distance.isNull(), "MISSING").when(distance <= MATCH_BITS, "MATCH").when(distance <= SIMILAR_BITS, "SIMILAR").otherwise("CONFLICT")


def hash_percent(distance: Column) -> Column:
    return F.round((HASH_BITS - distance) / HASH_BITS * 100).cast("int")


def shared_colours(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x)


def colour_state(share: Column) -> Column:
    return F.when(share.isNull(), "MISSING").when(share >= MATCH_COLOURS, "MATCH").when(share >= SIMILAR_COLOURS, "SIMILAR").otherwise("CONFLICT")


def fingerprint_rows(a: Column, b: Column) -> Column:
    """Rows (aspect, status) of two structs (hash, histogram, logo_ran, logo_hash); the logo counts if either ran."""
    row = lambda name, status: F.struct(F.lit(name).alias("aspect"), status.alias("status"))
    logo = F.when(a["logo_ran"] | b["logo_ran"], row("logo", hash_state(hash_distance(a["logo_hash"], b["logo_hash"]))))
    return F.array_compact(F.array(row("layout", hash_state(hash_distance(a["hash"], b["hash"]))), row("colour", colour_state(shared_colours(a["histogram"], b["histogram"]))), logo))


def difference_hash(pixels: Column, width: int = 9, height: int = 8) -> Column:
    """64 bits, row by row, most significant first: whether a grey value is above its right neighbour."""
    places = F.sequence(F.lit(0), F.lit((width - 1) * height - 1))
    at = lambda i: (F.floor(i / (width - 1)) * width + i % (width - 1) + 1).cast("int")
    bit = lambda i: (F.element_at(pixels, at(i)) > F.element_at(pixels, at(i) + 1)).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))


# choosing


def best_match(scored: DataFrame, key: str, score: str, position: str) -> DataFrame:
    """The candidate of each subject with the highest score; ties go to the earlier one, and a score of 0 still wins."""
    return best_row(scored, [key], F.struct(F.col(score), -F.col(position)))


def comparison_plan(highest: DataFrame, baseline: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """no_artwork, no_approved_baseline, up_to_date or ready for each line."""
    top = highest.select(*keys, F.col("version_number").alias("top"))
    base = baseline.select(*keys, F.col("version_number").alias("approved"))
    state = F.when(F.col("top").isNull(), "no_artwork").when(F.col("approved").isNull(), "no_approved_baseline").when(F.col("top") == F.col("approved"), "up_to_date").otherwise("ready")
    return lines.join(top, keys, "left").join(base, keys, "left").select(*keys, state.alias("plan"))
