"""Queries on extraction from text, geometry, cascades and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators import cascade as K
from labelloom.operators import extract as X
from labelloom.operators import geometry as G
from labelloom.operators.label_text import label_fields
from labelloom.operators.shared import shared_folder
from labelloom.plans.sets_queries import _NAMED, pixels
from labelloom.sources.domain import labels, table, with_sql
from labelloom.streaming import decisions

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


def text_query(name, expression, sql, alias="x"):
    """A column expression over every whole text of documents."""

    @query(name, sql and f"SELECT doc_id, {sql} AS {alias} FROM documents")
    def run(spark, sf):
        return table(spark, sf, "documents").select("doc_id", expression(F.col("text")).alias(alias))


text_query("x_01", lambda t: F.size(X.lines(t)).cast("long"), "len(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda l: trim(l)), lambda l: l <> ''))")
text_query("x_02", lambda t: X.after_prefix(F.split(t, "\n")[0], "the|is"), r"nullif(regexp_extract(string_split(text, chr(10))[1], '(?i)^\s*(?:the|is)\s*[:\-]?\s*(.*)$', 1), '')")
text_query("x_03", lambda t: F.size(X.offsets(t, "tion")).cast("long"), "((length(text) - length(replace(text, 'tion', ''))) / 4)::BIGINT")
text_query("x_10", X.email, r"nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), '')")
text_query("x_35", T.version_number, r"TRY_CAST(nullif(regexp_extract(text, '(\d+)', 1), '') AS INTEGER)")
text_query("x_21", lambda t: F.size(X.badge_claims(t)).cast("long"), None)
text_query("x_08", X.licence, None)
text_query("x_11", X.care_number, None)
text_query("x_18", X.ingredients_text, None)
text_query("x_22", X.free_from_claims, None)
text_query("x_25", lambda t: X.table_format(t, ["protein", "sodium", "energy"]), None)
text_query("a_25", lambda t: F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("(tion|ing|ed)"), F.lit(1)))).cast("long"), "len(list_distinct(regexp_extract_all(text, '(tion|ing|ed)', 1)))")


@query("x_12", with_sql("label", "SELECT id, upper(left(product_name, 1)) || substring(split_part(product_name, ' ', 1), 2) || '-' || upper(left(split_part(product_name, ' ', 2), 1)) || substring(split_part(product_name, ' ', 2), 2) AS x FROM label"))
def x_12(spark, sf):
    return labels(spark, sf).select("id", T.title_case(F.replace(F.upper("product_name"), F.lit(" "), F.lit("-"))).alias("x"))


@query("x_16", with_sql("label", "SELECT id, product_name AS x FROM label"))
def x_16(spark, sf):
    doubled = F.split(F.concat_ws(" ", "product_name", "product_name"), " ")
    return labels(spark, sf).select("id", F.array_join(X.repeated_to_one(doubled), " ").alias("x"))


@query("x_19", with_sql("label", "SELECT id, string_split(ingredients, ', ') AS x FROM label WHERE ingredients IS NOT NULL"))
def x_19(spark, sf):
    return labels(spark, sf).where("ingredients IS NOT NULL").select("id", X.top_level_items(F.col("ingredients")).alias("x"))


@query("x_20", with_sql("label", "SELECT id, list_filter(['small', 'large bolt', 'ring'], lambda k: regexp_matches(lower(product_name), '(^|\\W)' || replace(k, ' ', '\\s+') || '(\\W|$)')) AS x FROM label"))
def x_20(spark, sf):
    return labels(spark, sf).select("id", X.known_claims(F.col("product_name"), ["small", "large bolt", "ring", "Health Supplement"]).alias("x"))


@query("x_23", with_sql("label", "SELECT id, CASE WHEN contains(lower(claims), 'small') THEN 1 ELSE 0 END AS matched, array_to_string(string_split(claims, ' '), ' | ') AS text FROM label WHERE claims IS NOT NULL"))
def x_23(spark, sf):
    r = X.claims_result(F.split("claims", " "), F.array(F.lit("SMALL")))
    return labels(spark, sf).where("claims IS NOT NULL").select("id", r.alias("r")).select("id", F.least(F.size("r.matched"), F.lit(1)).alias("matched"), "r.text")


@query("x_26", with_sql("label", "SELECT id, id % 3 = 0 AS x FROM label"))
def x_26(spark, sf):
    value = F.when(F.col("id") % 3 == 0, F.lit("[brand]")).otherwise(F.col("product_name"))
    return labels(spark, sf).select("id", X.is_placeholder(value).alias("x"))


@query("x_27", with_sql("label", "SELECT id, CASE WHEN id % 2 = 0 THEN NULL ELSE product_name END AS product_name, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS n FROM label"))
def x_27(spark, sf):
    rows = labels(spark, sf).select("id", F.when(F.col("id") % 2 == 0, "xxxx").otherwise(F.col("product_name")).alias("product_name"))
    return X.scrubbed(rows, ["product_name"]).select("id", "product_name", F.size("scrubbed").alias("n"))


@query("x_28", with_sql("label", "SELECT id, split_part(product_name, ' ', 1) = split_part(product_name, ' ', 2) OR (length(split_part(product_name, ' ', 1)) <= 3 AND length(split_part(product_name, ' ', 2)) <= 3) AS x FROM label"))
def x_28(spark, sf):
    return labels(spark, sf).select("id", X.is_garbage(F.col("product_name")).alias("x"))


@query("x_29", with_sql("label", "SELECT id, package_size IS NULL OR regexp_matches(package_size, '^\\d+ gummies$') AS x FROM label"))
def x_29(spark, sf):
    return labels(spark, sf).select("id", X.name_is_missing(F.col("package_size")).alias("x"))


@query("x_31", with_sql("label", "SELECT id, fssai_number AS x FROM label"))
def x_31(spark, sf):
    spaced = F.regexp_replace("fssai_number", r"^(\d{4})(\d{6})", "$1 $2-")
    return labels(spark, sf).select("id", X.valid_licence(spaced).alias("x"))


@query("x_32", "SELECT l_orderkey, l_linenumber, 'v' || min(l_quantity)::INTEGER AS x FROM lineitem GROUP BY ALL")
def x_32(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"))
    text = F.concat(F.lit('{"Protein": '), F.col("q").cast("string"), F.lit(' g, "k: v'), F.col("q").cast("string"), F.lit('"}'))
    return rows.select("l_orderkey", "l_linenumber", F.from_json(X.repaired_json(text), "map<string,string>")["k"].alias("x"))


@query("x_33", with_sql("label", "SELECT id, [product_name] AS x FROM label"))
def x_33(spark, sf):
    shape = F.when(F.col("id") % 3 == 0, F.to_json(F.array("product_name", F.lit("null")))).when(F.col("id") % 3 == 1, F.to_json(F.create_map(F.lit("a"), F.col("product_name")))).otherwise(F.col("product_name"))
    return labels(spark, sf).select("id", shape.alias("s")).select("id", X.as_list(F.col("s")).alias("x"))


@query("x_34", with_sql("label", "SELECT id, CASE WHEN id % 2 = 1 THEN marketing_company END AS x FROM label"))
def x_34(spark, sf):
    company = F.when(F.col("id") % 2 == 0, F.upper("brand_name")).otherwise(F.col("marketing_company"))
    return labels(spark, sf).select("id", X.other_company(company, F.col("brand_name"), F.col("product_name")).alias("x"))


@query("x_36", "SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS x FROM orders")
def x_36(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.presentable_date(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("x"))


@query("x_37", "SELECT l_orderkey, l_linenumber, min(l_quantity)::INTEGER || 'mcg' AS x FROM lineitem GROUP BY ALL")
def x_37(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").cast("string").alias("q"))
    return rows.select("l_orderkey", "l_linenumber", T.score_value(F.concat(F.lit(" "), "q", F.lit(" µg  (5% RDA)"))).alias("x"))


@query("x_38", with_sql("label", "SELECT id, list_sort(list_distinct(string_split(lower(product_name), ' '))) AS x FROM label"))
def x_38(spark, sf):
    return labels(spark, sf).select("id", T.key_tokens(F.concat(F.upper("product_name"), F.lit(": (of which)"))).alias("x"))


@query("x_39", with_sql("label", "SELECT id, coalesce(contains(lower(claims), lower(product_name)), false) AS x FROM label"))
def x_39(spark, sf):
    return labels(spark, sf).select("id", X.present_in(F.col("claims"), F.col("product_name")).alias("x"))


@query("x_40", with_sql("label", "SELECT id, replace(lower(product_name), ' ', '-') AS x FROM label"))
def x_40(spark, sf):
    return labels(spark, sf).select("id", T.slug(F.concat(F.lit("**"), F.upper("product_name"), F.lit("!"))).alias("x"))


@query("x_42", "SELECT n_nationkey, 'brand_name' AS x FROM nation")
def x_42(spark, sf):
    meta = X.renamed_keys(F.create_map(F.lit("brandName"), F.col("n_name")), {"brandName": "brand_name"})
    return table(spark, sf, "nation").select("n_nationkey", F.map_keys(meta)[0].alias("x"))


@query("x_17", None)
def x_17(spark, sf):
    return label_fields(table(spark, sf, "documents"), "doc_id", "text", ["Mango", "Orange"])


# geometry: order lines as spans on the page of their supplier


def spans(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("page"), ((F.col("l_partkey") * 13) % 500).cast("double").alias("x"), (F.floor(F.col("l_orderkey") / 10) * 17 % 700).cast("double").alias("y"),
        F.lit(30.0).alias("width"), (F.lit(8.0) + F.col("l_linenumber") % 3).alias("font_size"), F.when(F.col("l_suppkey") % 2 == 0, 0.0).otherwise(1.5707963).alias("rotation"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"),
    )


def titled(spark, sf):
    """The spans, some of them in display type."""
    return spans(spark, sf).withColumn("font_size", F.when(F.endswith("text", F.lit("77")), F.col("font_size") * 5).otherwise(F.col("font_size")))


SPANS = """spans AS (SELECT l_suppkey AS page, (l_partkey * 13 % 500)::DOUBLE AS x, (l_orderkey // 10 * 17 % 700)::DOUBLE AS y, 30.0::DOUBLE AS width, 8.0::DOUBLE + l_linenumber % 3 AS font_size,
 CASE WHEN l_suppkey % 2 = 0 THEN 0.0 ELSE 1.5707963 END::DOUBLE AS rotation, 'w' || l_partkey AS text FROM lineitem)"""


#: The same spans, some of them in display type.
TITLED = "titled AS (SELECT page, x, y, width, CASE WHEN ends_with(text, '77') THEN font_size * 5 ELSE font_size END AS font_size, rotation, text FROM spans)"


def line_sql(source: str) -> str:
    """Lines of the spans of ``source``, one position after the other (the common tables that follow WITH RECURSIVE)."""
    return f"""placed AS (SELECT page, round(rotation / 0.01)::BIGINT AS bucket, x * cos(rotation) + y * sin(rotation) AS along, -x * sin(rotation) + y * cos(rotation) AS c, font_size AS s, text FROM {source}),
marks AS (SELECT *, row_number() OVER (PARTITION BY page, bucket ORDER BY c DESC, s DESC) AS n FROM (SELECT DISTINCT page, bucket, c, s FROM placed)),
walk AS (SELECT page, bucket, n, c, s, c AS first, s AS largest, 0::BIGINT AS line FROM marks WHERE n = 1 UNION ALL
 SELECT page, bucket, n, c, s, CASE WHEN new THEN c ELSE first END, CASE WHEN new THEN s ELSE greatest(largest, s) END, line + new::BIGINT FROM (
  SELECT m.*, w.first, w.largest, w.line, m.c + m.s * 0.5 < w.first OR m.c + w.largest * 0.5 < w.first AS new FROM walk w JOIN marks m ON m.page = w.page AND m.bucket = w.bucket AND m.n = w.n + 1)),
lined AS (SELECT page, bucket, line, string_agg(text, ' ' ORDER BY along, text) AS text, max(c) AS cross_, max(s) AS font_size, count(*) AS n FROM placed JOIN walk USING (page, bucket, c, s) GROUP BY ALL)"""


CELL_SQL = f"""WITH {SPANS}, s AS (SELECT page, y AS row_y, x AS along, width, font_size, text FROM spans WHERE rotation = 0),
g AS (SELECT *, along - lag(along + width) OVER (PARTITION BY page, row_y ORDER BY along, text, width) AS gap, max(font_size) OVER (PARTITION BY page, row_y) AS f FROM s),
c AS (SELECT *, (sum(CASE WHEN gap IS NULL OR gap > 1.5 * f THEN 1 ELSE 0 END) OVER (PARTITION BY page, row_y ORDER BY along, text, width ROWS UNBOUNDED PRECEDING))::BIGINT AS cell FROM g)"""
DISPLAY_SQL = f"""WITH RECURSIVE {SPANS}, {TITLED}, {line_sql('titled')}, m AS (SELECT page, median(font_size) AS m FROM lined GROUP BY 1),
once AS (SELECT page, text, max(row(font_size, cross_)) AS b FROM lined JOIN m USING (page) WHERE font_size >= 2.5 * m AND regexp_matches(text, '\\p{{L}}') GROUP BY ALL),
ranked AS (SELECT page, text, b, row_number() OVER (PARTITION BY page ORDER BY b DESC, text) AS rank FROM once)
SELECT page, text, struct_extract(b, 1) AS font_size, rank::INTEGER AS rank FROM ranked WHERE rank <= 10"""


@query("e_01", f"WITH {SPANS} SELECT text, page, round(x * cos(rotation) + y * sin(rotation), 4) AS along, round(-x * sin(rotation) + y * cos(rotation), 4) AS cross_, round(rotation / 0.01)::BIGINT AS bucket FROM spans")
def e_01(spark, sf):
    return G.rotated(spans(spark, sf)).select("text", "page", F.round("along", 4).alias("along"), F.round("cross", 4).alias("cross_"), "bucket")


@query("e_02", f"WITH RECURSIVE {SPANS}, {line_sql('spans')} SELECT page, bucket, line, text, round(cross_, 4) AS cross_, font_size, n FROM lined")
def e_02(spark, sf):
    return G.lines(G.rotated(spans(spark, sf)), ["page", "bucket"]).withColumn("cross_", F.round("cross", 4)).drop("cross")


@query("e_03", f"""
WITH {SPANS}, m AS (SELECT page, median(font_size) AS m FROM spans WHERE rotation = 0 GROUP BY 1), s AS (SELECT spans.*, m FROM spans JOIN m USING (page) WHERE rotation = 0),
r AS (SELECT *, max(x + width) OVER (PARTITION BY page ORDER BY x, y, text, font_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s),
b AS (SELECT page, (sum(CASE WHEN e IS NULL OR x > e + m * 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x, y, text, font_size ROWS UNBOUNDED PRECEDING))::BIGINT AS band FROM r)
SELECT page, band, count(*) AS n FROM b GROUP BY ALL""")  # fmt: skip
def e_03(spark, sf):
    upright = G.rotated(spans(spark, sf).where("rotation = 0"))
    return G.panels(upright, ["page"]).groupBy("page", "band").agg(F.count("*").alias("n"))


@query("e_04", f"""WITH RECURSIVE {SPANS}, {line_sql('spans')}, panels AS (SELECT page, bucket, string_agg(text, chr(10) ORDER BY line) AS t FROM lined GROUP BY ALL)
SELECT page, string_agg(t, chr(10) || chr(10) ORDER BY bucket) AS text FROM panels GROUP BY 1""")
def e_04(spark, sf):
    return G.reading_text(G.lines(G.rotated(spans(spark, sf)), ["page", "bucket"]), "page", "bucket")


@query("e_05", CELL_SQL + "SELECT page, row_y, cell, string_agg(text, ' ' ORDER BY along, text) AS text FROM c GROUP BY ALL")
def e_05(spark, sf):
    return G.cells(G.rotated(spans(spark, sf).where("rotation = 0")).select("page", F.col("y").alias("row_y"), "along", "width", "font_size", "text"), ["page", "row_y"])


@query("e_06", DISPLAY_SQL)
def e_06(spark, sf):
    return G.display_lines(G.lines(G.rotated(titled(spark, sf)), ["page", "bucket"]), ["page"])


@query("e_09", f"WITH {SPANS} SELECT page, text, round(x * 300 / 72, 4) AS x0, round((800 - y - font_size) * 300 / 72, 4) AS y0 FROM spans")
def e_09(spark, sf):
    box = G.pixel_box(F.col("x"), F.col("y"), F.col("width"), F.col("font_size"), F.lit(800.0))
    return spans(spark, sf).select("page", "text", box.alias("b")).select("page", "text", F.round("b.x0", 4).alias("x0"), F.round("b.y0", 4).alias("y0"))


@query("e_11", with_sql("label", "SELECT id, true AS x FROM label"))
def e_11(spark, sf):
    return labels(spark, sf).select("id", G.is_display_text(F.col("product_name")).alias("x"))


@query("e_13", f"""
WITH {SPANS}, r AS (SELECT page, x AS s, x + width AS e, max(x + width) OVER (PARTITION BY page ORDER BY x, x + width ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM spans),
b AS (SELECT *, sum(CASE WHEN p IS NULL OR s > p + 4 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS band FROM r)
SELECT page, min(s) AS s, max(e) AS e FROM b GROUP BY page, band""")  # fmt: skip
def e_13(spark, sf):
    return G.strips(spans(spark, sf).select("page", F.col("x").alias("s"), (F.col("x") + F.col("width")).alias("e")), ["page"], "s", "e", 4.0)


@query("e_19", with_sql("label", "SELECT id, lower(claims) <> lower(product_name) AS x FROM label WHERE claims IS NOT NULL"))
def e_19(spark, sf):
    return labels(spark, sf).where("claims IS NOT NULL").select("id", G.is_trustworthy_addition(F.col("product_name"), F.col("claims")).alias("x"))


@query("e_14", None)
def e_14(spark, sf):
    from labelloom.plans.sets_queries import boxes

    rows = boxes(spark, sf).select("page", "x0", "y0", "x1", "y1", (F.col("id") % 100).cast("double").alias("confidence"), F.col("id").cast("string").alias("text"))
    return G.without_overlaps(rows, "page")


@query("w_10", f"""WITH RECURSIVE {SPANS}, marks AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y) AS n FROM (SELECT DISTINCT page, y FROM spans)),
walk AS (SELECT page, n, y, y AS first, 0::BIGINT AS line FROM marks WHERE n = 1 UNION ALL
 SELECT m.page, m.n, m.y, CASE WHEN m.y - w.first > 6 THEN m.y ELSE w.first END, w.line + (m.y - w.first > 6)::BIGINT FROM walk w JOIN marks m ON m.page = w.page AND m.n = w.n + 1)
SELECT page, x AS x0, y AS y0, text, line AS row FROM spans JOIN walk USING (page, y)""")
def w_10(spark, sf):
    words = spans(spark, sf).select("page", F.col("x").alias("x0"), F.col("y").alias("y0"), "text")
    return G.clustered_rows(words, ["page"], 6.0)


@query("e_07", "SELECT l_orderkey AS id, CASE WHEN l_linenumber = 2 THEN 'Vitamin B12' ELSE 'Vitamin ' || l_linenumber END AS nutrient, min(l_quantity)::INTEGER || ' mg' AS amount FROM lineitem GROUP BY l_orderkey, l_linenumber")
def e_07(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line")).agg(F.concat(F.min("l_quantity").cast("int").cast("string"), F.lit(" mg")).alias("amount"))
    name = F.concat(F.lit("Vitamin "), F.col("line").cast("string"))
    two = F.array(F.struct(F.lit(0).alias("cell"), name.alias("text")), F.struct(F.lit(1).alias("cell"), F.col("amount").alias("text")))
    one = F.array(F.struct(F.lit(0).alias("cell"), F.concat_ws(" ", F.lit("Vitamin B12"), "amount").alias("text")))  # a name that ends in a digit
    body = rows.select("id", "line", F.explode(F.when(F.col("line") == 2, one).otherwise(two)).alias("c")).select("id", "line", "c.*")
    head = rows.select("id").distinct().select("id", F.lit(-1).cast("long").alias("line"), F.lit(0).alias("cell"), F.lit("Nutritional Information").alias("text"))
    return G.nutrition_tables(head.unionByName(body), "id").select("id", F.explode("nutrition").alias("nutrient", "amount"))


@query("e_30", "SELECT vec_id, (" + " + ".join(f"(embedding[{i // 7 * 8 + i % 7 + 1}] > embedding[{i // 7 * 8 + i % 7 + 2}])::BIGINT * {1 << (55 - i)}" for i in range(56)) + ") AS h FROM embeddings")
def e_30(spark, sf):
    from labelloom.operators.compare import difference_hash

    return table(spark, sf, "embeddings").select("vec_id", difference_hash(F.col("embedding"), 8, 8).alias("h"))


@query("e_31", f"WITH {_NAMED} SELECT image, name, count(*) AS n FROM named GROUP BY ALL")
def e_31(spark, sf):
    from labelloom.operators.aggregates import hue_name

    named = pixels(spark, sf).select("image", hue_name(F.col("r"), F.col("g"), F.col("b")).alias("name"))
    return named.groupBy("image", "name").agg(F.count("*").alias("n"))


# cascades


@query("k_02", with_sql("label", """
WITH r AS (SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE product_name END AS a, CASE WHEN id % 2 = 0 THEN ' ' ELSE upper(product_name) END AS b, claims AS c FROM label)
SELECT id, coalesce(a, nullif(trim(b), ''), c) AS value, CASE WHEN a IS NOT NULL THEN 'text' WHEN trim(b) <> '' THEN 'ocr' ELSE 'vlm' END AS source, a IS NULL AND trim(b) = '' AS needs_review
FROM r WHERE coalesce(a, nullif(trim(b), ''), c) IS NOT NULL"""))  # fmt: skip
def k_02(spark, sf):
    rows = labels(spark, sf).select("id", F.when(F.col("id") % 3 != 0, F.col("product_name")).alias("text_name"), F.when(F.col("id") % 2 == 0, " ").otherwise(F.upper("product_name")).alias("ocr_name"), F.col("claims").alias("vlm_name"))
    return K.merged(rows, "id", ["name"], ["text", "ocr", "vlm"]).select("id", "value", "source", "needs_review")


@query("k_04", with_sql("label", "SELECT id, flavour IS NOT NULL AND claims IS NOT NULL AND ingredients IS NOT NULL AND fssai_number IS NOT NULL AND package_size IS NOT NULL AS complete FROM label"))
def k_04(spark, sf):
    return labels(spark, sf).select("id", K.is_complete().alias("complete"))


@query("k_06", with_sql("label", "SELECT id, coalesce(claims, CASE WHEN id % 8 = 4 THEN product_name END) AS value FROM label"))
def k_06(spark, sf):
    answer = F.when(F.col("id") % 8 == 4, F.col("product_name")).otherwise(F.lit("Not visible."))
    return labels(spark, sf).select("id", K.filled_by_model(F.col("claims"), answer, T.blank("claims")).alias("value"))


@query("k_07", with_sql("label", "SELECT id, CASE WHEN claims IS NULL THEN 0 ELSE 1 END AS n FROM label"))
def k_07(spark, sf):
    meta = F.create_map(F.lit("claims"), F.lit("ocr"))
    return labels(spark, sf).select("id", F.size(K.kept_meta(meta, F.create_map(F.lit("claims"), F.col("claims")))).alias("n"))


@query("k_08", with_sql("label", "SELECT id, ['flavour'] AS omitted, CASE WHEN claims IS NULL THEN ['claims'] ELSE [] END AS hollow FROM label"))
def k_08(spark, sf):
    r = K.retry_targets(F.array(F.lit("claims"), F.lit("flavour")), F.create_map(F.lit("claims"), F.col("claims")))
    return labels(spark, sf).select("id", r.alias("r")).select("id", "r.*")


@query("u_07", with_sql("label", "SELECT id, list_concat([product_name], CASE WHEN lower(claims) <> lower(product_name) THEN [claims] ELSE [] END) AS x FROM label WHERE claims IS NOT NULL"))
def u_07(spark, sf):
    return labels(spark, sf).where("claims IS NOT NULL").select("id", K.merged_lists(F.array("product_name"), F.array(F.upper("product_name"), F.col("claims"))).alias("x"))


# extension


def drained(spark, df, mode):
    """All that a stream gives until its input is read, with the number of the batch."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(rows, batch):
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/rows")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def log_stream(spark, sf):
    return spark.readStream.schema(decisions.LOG).parquet(f"{sf}/events.parquet*")


@query("ext_stream_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_stream_counts(spark, sf):
    """Tumbling counts of the log read as a stream; the newest update of each window."""
    rows = drained(spark, decisions.tumbling_counts(log_stream(spark, sf)), "update")
    return rows.groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))


@query("ext_stream_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def ext_stream_sessions(spark, sf):
    """Sessions of activity; the last batch has them all."""
    rows = drained(spark, decisions.activity_sessions(log_stream(spark, sf)), "complete")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).select("user_id", "start", F.col("end").alias("finish"), "n")


@query("ext_stream_once", "SELECT event_id, event_type FROM events")
def ext_stream_once(spark, sf):
    """The log sent twice, each entry once."""
    log = log_stream(spark, sf)
    return drained(spark, decisions.without_repeats(log.unionByName(log), "4000 days"), "append").select("event_id", "event_type")


@query("ext_stream_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def ext_stream_latest(spark, sf):
    """The newest entry of every user; the newest update counts."""
    rows = drained(spark, decisions.latest_state(log_stream(spark, sf)), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), "batch").alias("x")).select("user_id", "x.*")
