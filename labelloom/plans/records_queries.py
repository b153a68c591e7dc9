"""Queries on record comparison, entity resolution, scoring, workflow and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as X
from labelloom.operators import compare as B
from labelloom.operators import joins as J
from labelloom.operators import reports as R
from labelloom.operators import resolve as C
from labelloom.operators import scoring as S
from labelloom.operators import windows as W
from labelloom.operators import workflow as L
from labelloom.plans.sets_queries import LAST, LATEST
from labelloom.sources.domain import FIELDS, artworks, history, labels, products, table, with_sql

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


# The same expressions in SQL, for two columns a and b.
NORM = "regexp_replace(lower(trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))), '[.,;:]+$', '')"
STOP = "['" + "','".join(X.STOP_WORDS) + "']"
WORDS = f"list_filter(list_distinct(string_split({NORM}, ' ')), lambda w: w <> '' AND NOT list_contains({STOP}, w))"
OVERLAP = "CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / greatest(len({0}), len({1})) END".format(WORDS.format("a"), WORDS.format("b"))
EDIT = "levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)".format(NORM.format("a"), NORM.format("b"))
LIKE = f"({NORM.format('a')} <> '' AND {NORM.format('b')} <> '' AND ({EDIT} <= 0.25 OR {OVERLAP} >= 0.4))"
FIVE = f"""CASE WHEN coalesce(trim(a), '') = '' AND coalesce(trim(b), '') = '' THEN 'NOT_COMPARED' WHEN coalesce(trim(a), '') = '' OR coalesce(trim(b), '') = '' THEN 'MISSING'
 WHEN {NORM.format('a')} = {NORM.format('b')} THEN 'MATCH' WHEN {LIKE} THEN 'SIMILAR' ELSE 'CONFLICT' END"""
ALNUM = "list_filter(list_distinct(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+')), lambda w: w <> '')"
UNION = f"len(list_distinct(list_concat({ALNUM.format('a')}, {ALNUM.format('b')})))"
JACCARD = f"CASE WHEN {UNION} = 0 THEN 0.0 ELSE len(list_intersect({ALNUM.format('a')}, {ALNUM.format('b')})) / {UNION} END"
PARAM = f"CASE WHEN coalesce(trim(a), '') = '' OR coalesce(trim(b), '') = '' THEN 'MISSING' WHEN lower(trim(a)) = lower(trim(b)) THEN 'MATCH' WHEN {JACCARD} >= 0.6 THEN 'SIMILAR' ELSE 'CONFLICT' END"
EXACT = "CASE WHEN coalesce(trim(a), '') = '' OR coalesce(trim(b), '') = '' THEN 'MISSING' WHEN a = b THEN 'MATCH' ELSE 'CONFLICT' END"
#: Each label with the next one of its brand.
PAIRS = "pairs AS (SELECT * FROM (SELECT id AS a_id, lead(id) OVER (PARTITION BY brand_name ORDER BY id) AS b_id FROM label) WHERE b_id IS NOT NULL)"
ROWS = PAIRS + ",\nf AS (" + " UNION ALL ".join(f"SELECT a_id, b_id, '{c}' AS field, x.{c} AS a, y.{c} AS b FROM pairs JOIN label x ON x.id = a_id JOIN label y ON y.id = b_id" for c in FIELDS) + ")"
WEIGHT = "CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in B.WEIGHTS.items()) + " END"


def pairs(spark, sf):
    rows = labels(spark, sf)
    line = W.Window.partitionBy("brand_name").orderBy("id")
    return rows.select(F.col("id").alias("a_id"), F.lead("id").over(line).alias("b_id")).where("b_id IS NOT NULL")


def rows(spark, sf):
    records = labels(spark, sf)
    return B.field_pairs(pairs(spark, sf), records, records, FIELDS)


def paired(spark, sf):
    records = labels(spark, sf)
    return B.record_pairs(pairs(spark, sf), records, records, FIELDS)


def field_query(name, expression, sql, alias):
    @query(name, with_sql("label", f"WITH {ROWS} SELECT a_id, field, {sql} AS {alias} FROM f"))
    def run(spark, sf):
        return rows(spark, sf).select("a_id", "field", expression().alias(alias))


field_query("b_01", lambda: X.comparable("a"), NORM.format("a"), "x")
field_query("b_02", lambda: F.levenshtein(X.comparable("a"), X.comparable("b")).cast("long"), f"levenshtein({NORM.format('a')}, {NORM.format('b')})", "distance")
field_query("b_03", lambda: X.overlap(F.col("a"), F.col("b")), f"({OVERLAP})::DOUBLE", "share")
field_query("b_04", lambda: B.is_similar(F.col("a"), F.col("b")), LIKE, "alike")
field_query("b_05", lambda: B.five_state(F.col("a"), F.col("b")), FIVE, "status")
field_query("b_09", lambda: B.parameter_state(F.col("a"), F.col("b")), PARAM, "result")
field_query("b_14", lambda: B.exact_state(F.col("a"), F.col("b")), EXACT, "result")


def _weighted(keep):
    return with_sql("label", f"""
WITH {ROWS}, s AS (SELECT *, {FIVE} AS status, {WEIGHT} AS w FROM f WHERE {keep}), c AS (SELECT *, CASE status WHEN 'MATCH' THEN 1.0 WHEN 'SIMILAR' THEN 0.5 ELSE 0.0 END AS p FROM s)
SELECT a_id, b_id, coalesce(round(sum(w * p) FILTER (status <> 'NOT_COMPARED') / sum(w) FILTER (status <> 'NOT_COMPARED') * 100), 0)::INTEGER AS score,
 count(*) FILTER (status = 'MATCH') AS match, count(*) FILTER (status = 'SIMILAR') AS similar, count(*) FILTER (status = 'CONFLICT') AS conflict,
 count(*) FILTER (status = 'MISSING') AS missing, count(*) FILTER (status = 'NOT_COMPARED') AS not_compared FROM c GROUP BY 1, 2""")  # fmt: skip


@query("b_06", _weighted("true"))
def b_06(spark, sf):
    return B.weighted_records(paired(spark, sf), FIELDS)


@query("b_07", _weighted("field NOT IN ('address', 'customer_care_number', 'customer_care_email')"))
def b_07(spark, sf):
    return B.weighted_records(paired(spark, sf), FIELDS, same_company=True)


_PARAMETERS = f"""p AS (SELECT *, {PARAM} AS result FROM f), o AS (SELECT a_id, b_id,
 coalesce(round(avg(CASE result WHEN 'MATCH' THEN 100 WHEN 'SIMILAR' THEN 65 WHEN 'CONFLICT' THEN 0 END)), 0)::INTEGER AS overall,
 CASE WHEN bool_or(result = 'CONFLICT') THEN 'CONFLICT' WHEN bool_or(result IN ('SIMILAR', 'MISSING')) THEN 'REVIEW REQUIRED' ELSE 'MATCH' END AS verdict,
 count(*) FILTER (result <> 'MISSING') AS comparable, count(*) AS total FROM p GROUP BY 1, 2)"""


@query("b_10", with_sql("label", f"WITH {ROWS}, {_PARAMETERS} SELECT * FROM o"))
def b_10(spark, sf):
    return B.parameter_records(paired(spark, sf), FIELDS)


@query("b_11", with_sql("label", f"WITH {ROWS}, {_PARAMETERS} SELECT (a_id % 50) AS subject, arg_max(a_id, (overall, -a_id)) AS a_id, max(overall) AS overall FROM o GROUP BY 1"))
def b_11(spark, sf):
    scored = B.parameter_records(paired(spark, sf), FIELDS).select((F.col("a_id") % 50).alias("subject"), "a_id", "overall")
    return B.best_match(scored, "subject", "overall", "a_id").select("subject", "a_id", "overall")


def nutrition_texts(spark, sf):
    """(pair, a, b): nutrition tables of two neighbouring orders as JSON; one in seven is broken."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    entry = F.struct(F.concat(F.lit("N "), F.col("l_linenumber").cast("string")), F.concat((F.col("q") % 9).cast("string"), F.lit(" mg")))
    text = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry))))
    made = lines.groupBy("l_orderkey").agg(text.alias("t")).withColumn("t", F.when(F.col("l_orderkey") % 7 == 0, "{broken").otherwise(F.col("t")))
    sides = [made.where(F.col("l_orderkey") % 2 == i).select(F.floor(F.col("l_orderkey") / 2).alias("pair"), F.col("t").alias(n)) for i, n in ((0, "a"), (1, "b"))]
    return sides[0].join(sides[1], "pair")


@query("b_08", f"""
WITH n AS (SELECT l_orderkey AS id, 'N ' || l_linenumber AS nutrient, (min(l_quantity)::INTEGER % 9) || ' mg' AS v FROM lineitem GROUP BY ALL),
duo AS (SELECT id // 2 AS pair FROM n GROUP BY 1 HAVING count(DISTINCT id % 2) = 2),
p AS (SELECT (id // 2)::BIGINT AS pair, nutrient, max(CASE WHEN id % 2 = 0 THEN v END) AS a, max(CASE WHEN id % 2 = 1 THEN v END) AS b FROM n WHERE id % 7 <> 0 GROUP BY 1, 2)
SELECT p.*, CASE WHEN a IS NULL OR b IS NULL THEN 'MISSING' WHEN a = b THEN 'MATCH' WHEN {LIKE} THEN 'SIMILAR' ELSE 'CONFLICT' END AS status FROM p JOIN duo USING (pair)""")  # fmt: skip
def b_08(spark, sf):
    return B.nutrition_comparison(nutrition_texts(spark, sf), "a", "b", "pair")


_VECTORS = "v AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def vector_pairs(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vectors.withColumnRenamed("embedding", "x").join(vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")


@query("b_12", f"WITH {_VECTORS}, c AS (SELECT vec_id, list_cosine_similarity(x::DOUBLE[], y::DOUBLE[]) AS c FROM v) SELECT vec_id, CASE WHEN c >= 0.85 THEN 'MATCH' WHEN c >= 0.65 THEN 'SIMILAR' ELSE 'CONFLICT' END AS status, round(c, 6) AS c FROM c")
def b_12(spark, sf):
    value = B.cosine(F.col("x"), F.col("y"))
    return vector_pairs(spark, sf).select("vec_id", value.alias("c")).select("vec_id", B.cosine_state(F.col("c")).alias("status"), F.round("c", 6).alias("c"))


@query("b_13", """
WITH g AS (SELECT vec_id // 4 AS g, (vec_id % 4) // 2 AS side, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.g, a.e AS x, b.e AS y FROM g a JOIN g b ON a.g = b.g AND a.side = 0 AND b.side = 1),
c AS (SELECT g, x, y, list_cosine_similarity(x, y) AS c FROM p), one AS (SELECT g, avg(m) AS m FROM (SELECT g, x, max(c) AS m FROM c GROUP BY 1, 2) GROUP BY 1), two AS (SELECT g, avg(m) AS m FROM (SELECT g, y, max(c) AS m FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT one.g, round((one.m + two.m) / 2, 6) AS likeness FROM one JOIN two USING (g)""")  # fmt: skip
def b_13(spark, sf):
    side = lambda i: F.collect_list(F.when(F.floor(F.col("vec_id") % 4 / 2) == i, F.col("embedding")))
    lists = table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("g")).agg(side(0).alias("a"), side(1).alias("b")).where("size(a) > 0 AND size(b) > 0")
    return lists.select("g", F.round(B.list_likeness(F.col("a"), F.col("b")), 6).alias("likeness"))


@query("b_16", f"WITH {_VECTORS}, c AS (SELECT vec_id, list_cosine_similarity(x::DOUBLE[], y::DOUBLE[]) AS c FROM v) SELECT vec_id // 10 AS subject, sum(CASE WHEN c >= 0.85 THEN 2 WHEN c >= 0.65 THEN 1 ELSE 0 END)::BIGINT AS points FROM c GROUP BY 1")
def b_16(spark, sf):
    status = B.cosine_state(B.cosine(F.col("x"), F.col("y")))
    return vector_pairs(spark, sf).groupBy(F.floor(F.col("vec_id") / 10).alias("subject")).agg(F.sum(B.service_points(status)).alias("points"))


@query("b_17", with_sql("product, artwork", """
SELECT p.marketing_company, min(a.id) AS id FROM artwork a JOIN product p ON p.id = a.product_id WHERE a.status = 'Final Approved' GROUP BY 1"""))  # fmt: skip
def b_17(spark, sf):
    company = products(spark, sf).select(F.col("id").alias("product_id"), "marketing_company")
    return artworks(spark, sf).where(F.col("status") == "Final Approved").join(company, "product_id").groupBy("marketing_company").agg(F.min("id").alias("id"))


@query("b_19", with_sql("artwork", f"""
WITH {LATEST}, high AS (SELECT product_id, artwork_type, max(version_number) AS v FROM artwork GROUP BY 1, 2), lines AS (SELECT c_custkey AS product_id, t AS artwork_type FROM customer, (SELECT DISTINCT o_orderpriority AS t FROM orders))
SELECT l.product_id, l.artwork_type, CASE WHEN v IS NULL THEN 'no_artwork' WHEN version_number IS NULL THEN 'no_approved_baseline' WHEN v = version_number THEN 'up_to_date' ELSE 'ready' END AS plan
FROM lines l LEFT JOIN high h USING (product_id, artwork_type) LEFT JOIN latest b USING (product_id, artwork_type)"""))  # fmt: skip
def b_19(spark, sf):
    art = artworks(spark, sf)
    kinds = F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))  # fixed values
    lines = table(spark, sf, "customer").select(F.col("c_custkey").alias("product_id"), F.explode(kinds).alias("artwork_type"))
    return B.comparison_plan(W.highest_version(art), W.latest_approved(art), lines, ["product_id", "artwork_type"])


_HASH = "h AS (SELECT vec_id, " + " + ".join(f"(embedding[{i + 1}] > embedding[{i + 2}])::BIGINT * {1 << (61 - i)}" for i in range(62)) + " AS h FROM embeddings)"


def hashes(spark, sf):
    bit = lambda i: (F.element_at("embedding", i + 1) > F.element_at("embedding", i + 2)).cast("long")
    value = F.aggregate(F.sequence(F.lit(0), F.lit(61)), F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))
    return table(spark, sf, "embeddings").select("vec_id", value.alias("h"))


@query("b_21", f"""
WITH {_HASH}, d AS (SELECT a.vec_id, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, distance, CASE WHEN distance <= 4 THEN 'MATCH' WHEN distance <= 12 THEN 'SIMILAR' ELSE 'CONFLICT' END AS status, round((64 - distance) / 64 * 100)::INTEGER AS percent FROM d""")  # fmt: skip
def b_21(spark, sf):
    h = hashes(spark, sf)
    both = h.join(h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("other")), "vec_id")
    d = both.select("vec_id", B.hash_distance(F.col("h"), F.col("other")).alias("distance"))
    return d.select("vec_id", "distance", B.hash_state(F.col("distance")).alias("status"), B.hash_percent(F.col("distance")).alias("percent"))


@query("b_22", f"""
WITH {_VECTORS}, n AS (SELECT vec_id, list_transform(x, lambda e: abs(e)::DOUBLE) AS x, list_transform(y, lambda e: abs(e)::DOUBLE) AS y FROM v),
s AS (SELECT vec_id, list_sum(list_transform(list_zip(x, y), lambda p: least(p[1] / list_sum(x), p[2] / list_sum(y)))) AS share FROM n)
SELECT vec_id, round(share, 6) AS share, CASE WHEN share >= 0.85 THEN 'MATCH' WHEN share >= 0.6 THEN 'SIMILAR' ELSE 'CONFLICT' END AS status FROM s""")  # fmt: skip
def b_22(spark, sf):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, e: s + F.abs(e.cast("double")))
    both = vector_pairs(spark, sf).withColumns({"tx": total(F.col("x")), "ty": total(F.col("y"))})
    share = lambda c, t: F.transform(c, lambda e: F.abs(e.cast("double")) / F.col(t))
    s = both.select("vec_id", B.shared_colours(share(F.col("x"), "tx"), share(F.col("y"), "ty")).alias("share"))
    return s.select("vec_id", F.round("share", 6).alias("share"), B.colour_state(F.col("share")).alias("status"))


# entity resolution

_MASTER = "regexp_replace(lower({0}), '[\\s-]+', ' ', 'g')"


@query("c_01", f"""
WITH masters AS (SELECT DISTINCT p_name AS m FROM part WHERE p_partkey % 3 = 0), vals AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', '') ELSE p_name || ' pack' END AS v FROM part),
n AS (SELECT v, m, {_MASTER.format('v')} AS a, {_MASTER.format('m')} AS b FROM vals, masters),
s AS (SELECT v, m, CASE WHEN a = b THEN 1.0 WHEN contains(' ' || a || ' ', ' ' || b || ' ') OR contains(' ' || b || ' ', ' ' || a || ' ') THEN 0.9 ELSE (length(a) + length(b) - levenshtein(a, b)) / (length(a) + length(b)) END AS score FROM n)
SELECT v AS value, arg_min(m, (-score, m)) AS master, max(score)::DOUBLE AS score FROM s WHERE score >= 0.85 GROUP BY 1""")  # fmt: skip
def c_01(spark, sf):
    part = table(spark, sf, "part")
    names = part.where("p_partkey % 3 = 0").select(F.col("p_name").alias("m")).distinct()  # the master list, in the order of names
    key = F.col("p_partkey") % 3
    values = part.select(F.when(key == 0, F.upper("p_name")).when(key == 1, F.replace("p_name", F.lit("e"), F.lit(""))).otherwise(F.concat("p_name", F.lit(" pack"))).alias("value"))
    return C.snapped(values, "value", names, "m", "m")


@query("c_02", with_sql("product", "SELECT a.id, min(b.id) AS other FROM product a JOIN product b ON lower(a.brand) = lower(b.brand) AND lower(a.product_name) = lower(b.product_name) AND lower(a.marketing_company) = lower(b.marketing_company) GROUP BY 1"))
def c_02(spark, sf):
    rows = products(spark, sf)
    keys = [X.folded(c).alias(c) for c in ("brand", "product_name", "marketing_company")]
    folded = rows.select("id", *keys)
    firsts = folded.groupBy("brand", "product_name", "marketing_company").agg(F.min("id").alias("other"))
    return folded.join(firsts, ["brand", "product_name", "marketing_company"]).select("id", "other")


@query("c_03", with_sql("product", """
SELECT id, first AS other FROM (SELECT id, min(id) OVER (PARTITION BY lower(product_name), lower(marketing_company)) AS first FROM product WHERE status = 'Active') WHERE id <> first"""))  # fmt: skip
def c_03(spark, sf):
    return C.duplicate_masters(products(spark, sf), "product_name", ["marketing_company"])


@query("c_05", """
WITH masters AS (SELECT n_nationkey AS id, n_name AS name FROM nation), names AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name || ' NEW' END AS name FROM nation)
SELECT id, name FROM masters UNION ALL SELECT NULL, name FROM names WHERE lower(name) NOT IN (SELECT lower(name) FROM masters)""")  # fmt: skip
def c_05(spark, sf):
    masters = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    names = masters.select(F.when(F.col("id") % 2 == 0, F.lower("name")).otherwise(F.concat("name", F.lit(" NEW"))).alias("name"))
    return C.get_or_created(names, masters, "name")


@query("c_06", """
WITH n AS (SELECT p_partkey, upper(CASE WHEN p_name LIKE '% %' THEN left(p_name, 1) || left(split_part(p_name, ' ', 2), 1) ELSE left(p_name, 3) END) AS b FROM part)
SELECT p_partkey, CASE WHEN row_number() OVER w = 1 THEN b ELSE b || row_number() OVER w END AS short_code FROM n WINDOW w AS (PARTITION BY b ORDER BY p_partkey)""")  # fmt: skip
def c_06(spark, sf):
    return C.short_codes(table(spark, sf, "part"), "p_name", "p_partkey").select("p_partkey", "short_code")


@query("c_07", with_sql("product", """
SELECT id, CASE WHEN id % 4 = 0 THEN ['fssai_number'] ELSE [] END AS changed FROM product WHERE id % 4 = 0"""))  # fmt: skip
def c_07(spark, sf):
    rows = products(spark, sf).select("id", "flavour", "fssai_number")
    found = rows.select("id", F.upper("flavour").alias("flavour"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("9"), F.coalesce("fssai_number", F.lit("")))).otherwise(F.col("fssai_number")).alias("fssai_number"))
    return C.backfill(rows, found, "id", ["fssai_number"], ["flavour"])


@query("c_08", with_sql("product", """
SELECT id, 'bp|' || lower(brand) || '|' || lower(product_name) AS signal FROM product
UNION ALL SELECT id, 'bpx|' || lower(brand) || '|' || lower(product_name) || '|' || fssai_number FROM product WHERE fssai_number IS NOT NULL"""))  # fmt: skip
def c_08(spark, sf):
    return C.signals(products(spark, sf), "id", "brand", "product_name", "fssai_number")


@query("c_09", with_sql("product", "SELECT id, min(id) OVER (PARTITION BY lower(brand), lower(product_name)) AS family FROM product"))
def c_09(spark, sf):
    rows = products(spark, sf).select("id", "brand", "product_name", "fssai_number")
    return C.families(rows, "id", C.signals(rows, "id", "brand", "product_name", "fssai_number"))


HELD_OUT = "('0x' || substring(md5({0}::VARCHAR), 1, 8))::BIGINT % 100 < {1}"


@query("c_10", SQL["c_09"] and f"SELECT *, {HELD_OUT.format('family', 20)} AS validation FROM ({SQL['c_09']})")
def c_10(spark, sf):
    return C.held_out_families(c_09(spark, sf), "family", 20)


# scoring

_VALUE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({0}, ''))), '\\s+', ' ', 'g'), '\\s*\\([^()]*\\)$', ''), '[.,;:]+$', ''))"


@query("q_01", with_sql("label", f"""
WITH {ROWS}, n AS (SELECT a_id, field, nullif({_VALUE.format('a')}, '') AS g, nullif({_VALUE.format('b')}, '') AS w FROM f WHERE field IN ('claims', 'flavour', 'product_name'))
SELECT a_id, field, (g IS NOT DISTINCT FROM w)::BIGINT AS correct, (g IS NOT NULL AND g IS DISTINCT FROM w)::BIGINT AS wrong, (g IS NULL AND w IS NOT NULL)::BIGINT AS missing FROM n"""))  # fmt: skip
def q_01(spark, sf):
    some = rows(spark, sf).where(F.col("field").isin("claims", "flavour", "product_name"))
    return some.select("a_id", "field", S.tri_state(F.col("a"), F.col("b")).alias("t")).select("a_id", "field", "t.*")


@query("q_02", with_sql("label", f"""
WITH {ROWS}, n AS (SELECT a_id, nullif({_VALUE.format('a')}, '') AS g, nullif({_VALUE.format('b')}, '') AS w FROM (SELECT a_id, product_name AS a, claims AS b FROM label JOIN pairs ON a_id = id)),
c AS (SELECT *, coalesce(contains(g, w) OR contains(w, g), g IS NULL AND w IS NULL) AS ok FROM n)
SELECT a_id, ok::BIGINT AS correct, (g IS NOT NULL AND NOT ok)::BIGINT AS wrong, (g IS NULL AND w IS NOT NULL)::BIGINT AS missing FROM c"""))  # fmt: skip
def q_02(spark, sf):
    chosen = labels(spark, sf).join(pairs(spark, sf).select(F.col("a_id").alias("id")), "id")
    return chosen.select(F.col("id").alias("a_id"), S.tri_state(F.col("product_name"), F.col("claims"), contained=True).alias("t")).select("a_id", "t.*")


_ITEMS = "i AS (SELECT id, list_distinct(string_split(lower(ingredients), ', ')) AS g, list_distinct(string_split(lower(claims), ' ')) AS w FROM label WHERE ingredients IS NOT NULL AND claims IS NOT NULL)"


def items(spark, sf):
    return labels(spark, sf).where("ingredients IS NOT NULL AND claims IS NOT NULL").select("id", F.split("ingredients", ", ").alias("g"), F.split("claims", " ").alias("w"))


@query("q_03", with_sql("label", f"WITH {_ITEMS} SELECT id, len(list_intersect(g, w)) AS correct, len(list_filter(g, lambda x: NOT list_contains(w, x))) AS wrong, len(list_filter(w, lambda x: NOT list_contains(g, x))) AS missing FROM i"))
def q_03(spark, sf):
    return items(spark, sf).select("id", S.list_score(F.col("g"), F.col("w")).alias("t")).select("id", "t.*")


@query("q_05", with_sql("label", f"""
WITH {_ITEMS}, u AS (SELECT id, unnest(list_distinct(list_concat(g, w))) AS item, g, w FROM i)
SELECT id, item, CASE WHEN list_contains(g, item) AND list_contains(w, item) THEN 'correct' WHEN list_contains(g, item) THEN 'wrong' ELSE 'missing' END AS result FROM u"""))  # fmt: skip
def q_05(spark, sf):
    return items(spark, sf).select("id", F.explode(S.list_detail(F.col("g"), F.col("w"))).alias("x")).select("id", "x.*")


@query("q_04", """
WITH n AS (SELECT l_orderkey AS id, 'n ' || l_linenumber AS k, (min(l_quantity)::INTEGER % 9) || 'mg' AS v FROM lineitem GROUP BY ALL), duo AS (SELECT DISTINCT x.id // 2 AS pair FROM n x JOIN n y ON y.id = x.id + 1 WHERE x.id % 2 = 0),
p AS (SELECT b.pair, x.k AS gk, y.k AS wk, x.v AS gv, y.v AS wv FROM duo b JOIN ((SELECT id // 2 AS pair, k, v FROM n WHERE id % 2 = 0 AND id % 7 <> 0) x FULL JOIN (SELECT id // 2 AS pair, k, v FROM n WHERE id % 2 = 1 AND id % 7 <> 0) y ON x.pair = y.pair AND x.k = y.k) ON b.pair = coalesce(x.pair, y.pair))
SELECT pair::BIGINT AS pair, count(*) FILTER (gv = wv) AS correct, count(*) FILTER (gk IS NOT NULL AND gv IS DISTINCT FROM wv) AS wrong, count(*) FILTER (gk IS NULL) AS missing FROM p GROUP BY 1""")  # fmt: skip
def q_04(spark, sf):
    parse = lambda c: F.from_json(c, "map<string,string>")
    return nutrition_texts(spark, sf).select("pair", S.map_score(parse("a"), parse("b")).alias("t")).select("pair", "t.*")


@query("q_06", None)
def q_06(spark, sf):
    return rows(spark, sf).select("a_id", "field", S.fuzzy_match(F.col("a"), F.col("b")).alias("alike"))


@query("q_07", None)
def q_07(spark, sf):
    return rows(spark, sf).select("a_id", "field", S.fuzzy_tri_state(F.col("a"), F.col("b")).alias("t")).select("a_id", "field", "t.*")


@query("q_08", None)
def q_08(spark, sf):
    return S.greedy_list_score(items(spark, sf), "id", "g", "w")


# workflow


@query("l_02", with_sql("history", """
SELECT id, comparison_id, resulting_status FROM history
UNION ALL SELECT id + 10000000, comparison_id, 'Final Approved' FROM history WHERE stage = 'Manager' AND id % 2 = 0"""))  # fmt: skip
def l_02(spark, sf):
    log = history(spark, sf)
    taken = log.where((F.col("stage") == "Manager") & (F.col("id") % 2 == 0)).select((F.col("id") + 10000000).alias("id"), "comparison_id", "stage", F.lit("approve").alias("decision"), F.lit("manager").alias("role"))
    return L.decided(log, taken).select("id", "comparison_id", "resulting_status")


@query("l_03", with_sql("history", "SELECT id FROM history WHERE stage = 'QA'"))
def l_03(spark, sf):
    tried = history(spark, sf).select("id", "stage", F.lit("approve").alias("decision"), F.when(F.col("stage") == "QA", "manager").otherwise(F.col("actor_role")).alias("role"))
    return L.refused(tried).select("id")


@query("l_01", with_sql("history", f"""
WITH {LAST} SELECT comparison_id, CASE WHEN comparison_id % 2 = 0 AND resulting_status = 'Revision Required' THEN 'Pending Label Final' ELSE resulting_status END AS status FROM last"""))  # fmt: skip
def l_01(spark, sf):
    now = L.current_status(history(spark, sf))
    return L.submitted(now, now.where("comparison_id % 2 = 0"))


@query("l_04", with_sql("history", """
WITH o AS (SELECT comparison_id, stage, arg_max(actor_name, id) AS owner FROM history GROUP BY 1, 2)
SELECT comparison_id, stage, CASE WHEN comparison_id % 3 = 1 THEN 'other' ELSE owner END AS owner FROM o WHERE comparison_id % 3 <> 2"""))  # fmt: skip
def l_04(spark, sf):
    owners = history(spark, sf).groupBy("comparison_id", "stage").agg(F.max_by("actor_name", "id").alias("owner"))
    changes = owners.where("comparison_id % 3 <> 0").withColumn("owner", F.when(F.col("comparison_id") % 3 == 1, "other"))
    return L.assigned(owners, changes)


@query("l_06", with_sql("history", """
WITH x AS (SELECT id, stage, coalesce(lag(resulting_status) OVER (PARTITION BY comparison_id ORDER BY occurred_at, id), 'Pending Label Final') AS p FROM history),
y AS (SELECT id, stage, CASE p WHEN 'Pending Label Final' THEN 'Label Final' WHEN 'Pending Technical' THEN 'Technical' WHEN 'Pending QA' THEN 'QA' WHEN 'Pending Manager Approval' THEN 'Manager' WHEN 'Revision Required' THEN 'Label Final' ELSE 'none' END AS expected_stage FROM x)
SELECT * FROM y WHERE stage <> expected_stage"""))  # fmt: skip
def l_06(spark, sf):
    return L.illegal_entries(history(spark, sf)).select("id", "stage", "expected_stage")


# reports


_COMPARED = """cmp AS (SELECT a.id, a.id AS comparison_id, a.product_id, a.version_number, a.status, a.uploaded_at AS updated_at, r.id AS reference_id FROM artwork a ASOF LEFT JOIN (SELECT * FROM artwork WHERE status = 'Final Approved') r
 ON a.product_id = r.product_id AND a.artwork_type = r.artwork_type AND a.version_number > r.version_number)"""


@query("r_01", with_sql("artwork, product, label", f"""
WITH {_COMPARED}, f AS (SELECT cmp.id, x.product_name AS a, y.product_name AS b FROM cmp JOIN label x ON x.id = cmp.id % (SELECT count(*) FROM part) JOIN label y ON y.id = reference_id % (SELECT count(*) FROM part)
 UNION ALL SELECT cmp.id, x.flavour, y.flavour FROM cmp JOIN label x ON x.id = cmp.id % (SELECT count(*) FROM part) JOIN label y ON y.id = reference_id % (SELECT count(*) FROM part)
 UNION ALL SELECT cmp.id, x.claims, y.claims FROM cmp JOIN label x ON x.id = cmp.id % (SELECT count(*) FROM part) JOIN label y ON y.id = reference_id % (SELECT count(*) FROM part)),
p AS (SELECT *, {PARAM} AS result FROM f), o AS (SELECT id, coalesce(round(avg(CASE result WHEN 'MATCH' THEN 100 WHEN 'SIMILAR' THEN 65 WHEN 'CONFLICT' THEN 0 END)), 0)::INTEGER AS overall,
 CASE WHEN bool_or(result = 'CONFLICT') THEN 'CONFLICT' WHEN bool_or(result IN ('SIMILAR', 'MISSING')) THEN 'REVIEW REQUIRED' ELSE 'MATCH' END AS verdict FROM p GROUP BY 1)
SELECT cmp.id, product_id, coalesce(brand, '—') AS brand, coalesce(product_name, '—') AS product_name, version_number, cmp.status, updated_at, reference_id, overall, verdict
FROM cmp JOIN o ON o.id = cmp.id LEFT JOIN product ON product.id = product_id WHERE updated_at::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""))  # fmt: skip
def r_01(spark, sf):
    """Flagship: every artwork with an approved baseline, their records compared, as the filtered comparison report."""
    based = W.with_baseline(artworks(spark, sf)).where("reference_id IS NOT NULL")
    records = labels(spark, sf).select("id", "product_name", "flavour", "claims")
    parts = table(spark, sf, "part").count()
    linked = based.withColumns({"a_id": F.col("id") % parts, "b_id": F.col("reference_id") % parts})
    side = lambda p: records.select(F.col("id").alias(f"{p}_id"), F.struct("product_name", "flavour", "claims").alias(f"{p}_r"))
    joined = linked.join(side("a"), "a_id").join(side("b"), "b_id")
    results = [B.parameter_state(F.col(f"a_r.{f}"), F.col(f"b_r.{f}")) for f in ("product_name", "flavour", "claims")]
    rows = joined.select("id", "product_id", "version_number", "status", F.col("uploaded_at").alias("updated_at"), "reference_id", F.array(*results).alias("results"))
    report = R.label_comparison(B.parameter_summary(rows, "results"), products(spark, sf), {"date_from": "1996-01-01", "date_to": "1999-12-31"})
    return report.select("id", "product_id", "brand", "product_name", "version_number", "status", "updated_at", "reference_id", "overall", "verdict")


def comparisons(spark, sf):
    """The current state of each comparison of the log."""
    last = W.last_entry(history(spark, sf))
    return last.select(
        "comparison_id", F.col("comparison_id").alias("id"), F.col("comparison_id").alias("product_id"), F.col("resulting_status").alias("status"), F.col("occurred_at").alias("updated_at"),
        F.col("occurred_at").alias("submitted_at"), F.lit("V1").alias("version_number"), F.col("actor_name").alias("updated_by"), F.lit("B").alias("brand"), F.lit("M").alias("marketing_company"), F.lit("F").alias("manufacturing_company"),
        F.concat(F.lit("qa "), F.col("comparison_id").cast("string")).alias("qa_remarks"), F.col("actor_name").alias("created_by"), F.col("occurred_at").alias("created_at"),
    )


@query("r_02", with_sql("history", f"""
WITH {LAST} SELECT comparison_id, CASE resulting_status WHEN 'Pending Technical' THEN 'Technical' WHEN 'Pending QA' THEN 'QA' ELSE 'Manager' END AS stage,
 greatest(0, floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(occurred_at))) / 86400))::BIGINT AS days_pending FROM last WHERE resulting_status LIKE 'Pending%'"""))  # fmt: skip
def r_02(spark, sf):
    rows = R.pending_verification(comparisons(spark, sf), history(spark, sf), F.lit("2024-02-01").cast("timestamp"))
    return rows.select("comparison_id", "stage", "days_pending")


@query("r_03", with_sql("history", f"WITH {LAST} SELECT comparison_id, actor_name AS approver FROM last WHERE resulting_status = 'Final Approved'"))
def r_03(spark, sf):
    return R.approved_labels(comparisons(spark, sf), history(spark, sf)).select("comparison_id", "approver")


@query("r_04", with_sql("history", f"WITH {LAST} SELECT comparison_id, stage, actor_name AS reviewer, action AS decision, coalesce(remarks, 'qa ' || comparison_id) AS remarks FROM last WHERE resulting_status = 'Revision Required'"))
def r_04(spark, sf):
    return R.rejected_or_revision(comparisons(spark, sf), history(spark, sf)).select("comparison_id", "stage", "reviewer", "decision", "remarks")


@query("r_05", with_sql("artwork", """
SELECT id, version_number = max(version_number) OVER (PARTITION BY product_id, artwork_type) AS is_latest, CASE WHEN status = 'Archived' THEN uploaded_at END AS archived_at FROM artwork WHERE status = 'Draft' OR true
QUALIFY status = 'Draft'"""))  # fmt: skip
def r_05(spark, sf):
    art = artworks(spark, sf).withColumn("updated_at", F.col("uploaded_at"))
    return R.artwork_history(art, ["product_id", "artwork_type"], {"status": "Draft"}).select("id", "is_latest", "archived_at")


@query("r_06", with_sql("history", "SELECT id, occurred_at, 'Unassigned' AS assignee FROM history WHERE actor_name LIKE '%user 3%' AND resulting_status = 'Pending QA'"))
def r_06(spark, sf):
    log = history(spark, sf).withColumn("assignee", F.lit(None).cast("string"))
    return R.approval_history(log, {"user": "USER 3", "resulting_status": "Pending QA"}).select("id", "occurred_at", "assignee")


@query("r_07", with_sql("history, artwork", f"""
WITH {LAST}, roles AS (SELECT actor_name, arg_max(actor_role, id) AS role FROM history GROUP BY 1),
e AS (SELECT 'user ' || (product_id % 7) AS "user", 'Artwork uploaded' AS activity, id AS reference_id, uploaded_at AS at FROM artwork
 UNION ALL SELECT actor_name, 'Comparison created', comparison_id, occurred_at FROM last UNION ALL SELECT actor_name, 'Decision recorded', id, occurred_at FROM history)
SELECT e.*, coalesce(role, '—') AS role FROM e LEFT JOIN roles ON actor_name = "user" WHERE "user" LIKE '%2%'"""))  # fmt: skip
def r_07(spark, sf):
    uploads = artworks(spark, sf).withColumn("uploaded_by", F.concat(F.lit("user "), (F.col("product_id") % 7).cast("string")))
    log = history(spark, sf)
    roles = J.last_by_name(log.select("actor_name", F.col("actor_role").alias("role"), "id"), "actor_name", "id")
    return R.user_activity(uploads, comparisons(spark, sf), log, roles, {"user": "2"})
