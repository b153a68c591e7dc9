"""Queries on the remaining sources, rollups, box decisions and record checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from labelloom.functions import text as T
from labelloom.operators import aggregates as A
from labelloom.operators import boxes as D
from labelloom.operators import cascade as K
from labelloom.operators import compare as B
from labelloom.operators import extract as X
from labelloom.operators import geometry as G
from labelloom.operators import label_text as L
from labelloom.operators import resolve as C
from labelloom.operators import scoring as S
from labelloom.operators import tables as O
from labelloom.operators import windows as W
from labelloom.operators.shared import cut, shared_folder
from labelloom.plans import records_queries as R
from labelloom.plans.sets_queries import _BOX, _SCORES, boxes, pixels, scores
from labelloom.plans.text_queries import CELL_SQL, DISPLAY_SQL, SPANS, line_sql, spans, titled
from labelloom.sources import ledger
from labelloom.sources.domain import artworks, history, labels, table, with_sql
from labelloom.sources.files import write_training

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


# sources and sinks


@query("s_05", with_sql("label", "SELECT id::VARCHAR AS image_file, brand_name, CASE WHEN claims IS NULL THEN 0 ELSE 1 END AS claims FROM label"))
def s_05(spark, sf):
    """Records written as JSON and read back with the annotation schema."""
    from labelloom.sources.files import ANNOTATION

    label = F.struct("brand_name", F.when(F.col("claims").isNotNull(), F.array("claims")).alias("claims"))
    made = labels(spark, sf).select(F.to_json(F.struct(F.col("id").cast("string").alias("image_file"), label.alias("label"))).alias("value"))
    rows = cut(made, "annotations").select(F.from_json("value", ANNOTATION).alias("r"))
    return rows.select("r.image_file", "r.label.brand_name", F.coalesce(F.size("r.label.claims"), F.lit(0)).alias("claims"))


@query("s_09", f"""WITH {SPANS}, g AS (SELECT page, y AS row_y, x, width, font_size, text, x - lag(x + width) OVER (PARTITION BY page, y ORDER BY x, text, width, font_size) AS gap FROM spans),
c AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 0.3 * font_size THEN 1 ELSE 0 END) OVER (PARTITION BY page, row_y ORDER BY x, text, width, font_size ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT page, row_y, string_agg(text, '' ORDER BY x, text) AS text, min(x) AS x, max(x + width) AS end_ FROM c GROUP BY page, row_y, k""")
def s_09(spark, sf):
    return D.merged_runs(spans(spark, sf).withColumn("row_y", F.col("y")), ["page", "row_y"]).withColumnRenamed("end", "end_")


@query("s_14", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region")
def s_14(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", "n_name").unionByName(table(spark, sf, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")))


@query("s_21", "SELECT 'LC-' || lpad((max(event_id) + 1)::VARCHAR, 9, '0') AS code FROM events")
def s_21(spark, sf):
    ids = table(spark, sf, "events").select(F.concat(F.lit("LC-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("id"))
    return O.next_code(ids.unionByName(ids.limit(1).select(F.lit("LC-x").alias("id"))), "LC-", width=9)


@query("s_26", f"WITH {_SCORES} SELECT field, count(*) AS cells, count(predicted) AS filled FROM scores GROUP BY 1")
def s_26(spark, sf):
    """A run's table appended to the results as Markdown; the same run again adds nothing. Read back from its lines."""
    found = scores(spark, sf).groupBy("field").agg(F.count("*").alias("cells"), F.count("predicted").alias("filled"))
    log = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}"
    for _ in range(2):
        ledger.append_results(log, found, "run-1", "Filled cells", ["field"])
    cell = F.split(F.regexp_replace("line", r"^\| | \|$", ""), r" \| ")
    lines = ledger.results(spark, log).where("place > 0").select(cell.alias("c"))
    return lines.select(F.get("c", F.lit(0)).alias("field"), F.get("c", F.lit(1)).cast("long").alias("cells"), F.get("c", F.lit(2)).cast("long").alias("filled"))


@query("s_27", f"SELECT conv_id, turn, CASE WHEN {R.HELD_OUT.format('conv_id', 10)} THEN 'val' ELSE 'train' END AS split FROM conversations")
def s_27(spark, sf):
    """Conversations written as JSON lines, a family whole to one side, and read back."""
    folder = f"{shared_folder(spark)}/training-{uuid.uuid4().hex}"
    write_training(C.held_out_families(table(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", 10), folder)
    return spark.read.schema("conv_id long, turn long, split string").json(folder)


@query("s_29", with_sql("artwork", """
SELECT a.id, a.version_number AS new_value, r.version_number AS reference_value FROM artwork a JOIN artwork r ON r.product_id = a.product_id AND r.artwork_type = a.artwork_type AND r.version_number = a.version_number - 1
WHERE a.status <> 'Draft' AND r.status <> 'Draft'"""))  # fmt: skip
def s_29(spark, sf):
    """Values of both sides are looked up; without one side there is no row."""
    read = artworks(spark, sf).where("status <> 'Draft'")
    before = read.select("product_id", "artwork_type", (F.col("version_number") + 1).alias("version_number"), F.col("version_number").alias("reference_value"))
    return read.join(before, ["product_id", "artwork_type", "version_number"]).select("id", F.col("version_number").alias("new_value"), "reference_value")


@query("p_11", "SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%7%' AND c_mktsegment = 'MACHINERY'")
def p_11(spark, sf):
    return table(spark, sf, "customer").where(O.contains_any(["c_name"], "7") & O.equals_all({"c_mktsegment": "MACHINERY"})).select("c_custkey")


@query("p_22", with_sql("history", "SELECT id, id % 4 = 1 AS server_allows, id % 4 IN (0, 1) AS client_allows FROM history"))
def p_22(spark, sf):
    """Own role at a stage, or the manager, whom only the client lets act everywhere."""
    role = F.when(F.col("id") % 4 == 1, F.col("actor_role")).when(F.col("id") % 4 == 0, F.lit("manager")).otherwise(F.lit("viewer"))
    rows = history(spark, sf).withColumn("role", role)
    own = F.col("role") == F.col("actor_role")
    server = F.when(F.col("id") % 4 == 0, own & (F.col("actor_role") != "manager")).otherwise(own)
    return rows.select("id", server.alias("server_allows"), (own | (F.col("role") == "manager")).alias("client_allows"))


# joins and rollups


@query("j_12", with_sql("label", "SELECT l.id, coalesce(p.product_name, '') AS predicted, l.product_name AS expected FROM label l LEFT JOIN (SELECT * FROM label WHERE claims IS NOT NULL) p ON p.id = l.id"))
def j_12(spark, sf):
    truth = labels(spark, sf)
    predicted = truth.where("claims IS NOT NULL").select("id", F.col("product_name").alias("predicted"))
    return truth.join(predicted, "id", "left").select("id", F.coalesce("predicted", F.lit("")).alias("predicted"), F.col("product_name").alias("expected"))


@query("j_13", with_sql("label", "SELECT id, 'claims' AS field, coalesce(claims, '—') AS value FROM label UNION ALL SELECT id, 'flavour', coalesce(flavour, '—') FROM label"))
def j_13(spark, sf):
    each = F.array(*[F.struct(F.lit(f).alias("field"), T.or_dash(f).alias("value")) for f in ("claims", "flavour")])
    return labels(spark, sf).select("id", F.explode(each).alias("x")).select("id", "x.*")


@query("j_15", """
WITH v AS (SELECT DISTINCT p_brand AS value FROM part), m AS (SELECT DISTINCT p_brand AS master FROM part WHERE p_size > 25),
s AS (SELECT value, master, CASE WHEN lower(value) = lower(master) THEN 1.0 ELSE (length(value) + length(master) - levenshtein(lower(value), lower(master))) / (length(value) + length(master)) END AS score FROM v, m)
SELECT value, arg_min(master, (-score, master)) AS master, max(score)::DOUBLE AS score FROM s WHERE score >= 0.85 GROUP BY 1""")  # fmt: skip
def j_15(spark, sf):
    part = table(spark, sf, "part")
    names = part.where("p_size > 25").select(F.col("p_brand").alias("m")).distinct()  # the brand list
    return C.snapped(part.select(F.col("p_brand").alias("value")), "value", names, "m", "m")


def _weighted(spark, sf):
    return B.weighted_fields(R.rows(spark, sf))


@query("a_05", R.SQL["b_06"].replace("SELECT a_id, b_id, coalesce(round(", "SELECT a_id, coalesce(round(").split(",\n count(*) FILTER (status = 'MATCH')")[0] + " FROM c GROUP BY a_id, b_id")
def a_05(spark, sf):
    return _weighted(spark, sf).groupBy("a_id", "b_id").agg(A.weighted_score().alias("score")).drop("b_id")


@query("a_06", R.SQL["b_10"].replace("SELECT * FROM o", "SELECT a_id, overall FROM o"))
def a_06(spark, sf):
    return B.parameter_records(R.paired(spark, sf), R.FIELDS).select("a_id", "overall")


@query("a_07", R.SQL["b_10"].replace("SELECT * FROM o", "SELECT a_id, comparable / total AS coverage FROM o"))
def a_07(spark, sf):
    return B.parameter_records(R.paired(spark, sf), R.FIELDS).select("a_id", (F.col("comparable") / F.col("total")).alias("coverage"))


@query("a_08", R.SQL["b_10"].replace("SELECT * FROM o", "SELECT a_id, verdict FROM o"))
def a_08(spark, sf):
    return B.parameter_records(R.paired(spark, sf), R.FIELDS).select("a_id", "verdict")


@query("a_09", with_sql("label", f"WITH {R.ROWS} SELECT a_id, {R.FIVE} AS status, count(*) AS n FROM f GROUP BY ALL"))
def a_09(spark, sf):
    return _weighted(spark, sf).groupBy("a_id", "status").agg(F.count("*").alias("n"))


@query("a_11", f"""
WITH {_SCORES}, t AS (SELECT CASE field WHEN 'quality' THEN 'text' ELSE 'visual' END AS block, field, (predicted IS NOT DISTINCT FROM expected)::BIGINT AS ok FROM scores)
SELECT block, field, sum(ok)::BIGINT AS correct, count(*) AS total FROM t GROUP BY GROUPING SETS ((block, field), (block))""")  # fmt: skip
def a_11(spark, sf):
    rows = scores(spark, sf).select(F.when(F.col("field") == "quality", "text").otherwise("visual").alias("block"), "field", F.col("predicted").eqNullSafe(F.col("expected")).cast("long").alias("ok"))
    grouped = rows.groupingSets([["block", "field"], ["block"]], "block", "field")
    return grouped.agg(F.sum("ok").alias("correct"), F.count("*").alias("total"))


_GAP = """g AS (SELECT field, a_id, a IS DISTINCT FROM b AS gap, coalesce(contains(lower(b), 'e'), false) AS r1, coalesce(contains(lower(b), 'o'), false) AS r2 FROM f)"""


def gaps(spark, sf):
    read = lambda c: F.coalesce(F.lower("b").contains(c), F.lit(False))
    return R.rows(spark, sf).select("field", "a_id", (~F.col("a").eqNullSafe(F.col("b"))).alias("gap"), read("e").alias("r1"), read("o").alias("r2"))


@query("a_14", with_sql("label", f"""
WITH {R.ROWS}, {_GAP} SELECT field, count(*) FILTER (gap) AS gap, count(*) FILTER (gap AND r1) AS in_one, count(*) FILTER (gap AND r2) AS in_two, count(*) FILTER (gap AND (r1 OR r2)) AS in_any, count(*) FILTER (gap AND NOT (r1 OR r2)) AS in_none FROM g GROUP BY 1"""))  # fmt: skip
def a_14(spark, sf):
    gap, r1, r2 = F.col("gap"), F.col("r1"), F.col("r2")
    return A.counters(gaps(spark, sf), {"gap": gap, "in_one": gap & r1, "in_two": gap & r2, "in_any": gap & (r1 | r2), "in_none": gap & ~(r1 | r2)}, ["field"])


@query("a_15", with_sql("label", f"""
WITH {R.ROWS}, {_GAP}, p AS (SELECT a_id, count(*) FILTER (gap) AS n, count(*) FILTER (gap AND (r1 OR r2)) AS found FROM g GROUP BY 1)
SELECT count(*) FILTER (n >= 3 AND found = 0) AS whole, count(*) FILTER (found > 0 AND found < n) AS partial FROM p"""))  # fmt: skip
def a_15(spark, sf):
    gap, any_of = F.col("gap"), F.col("r1") | F.col("r2")
    each = A.counters(gaps(spark, sf), {"n": gap, "found": gap & any_of}, ["a_id"])
    return A.counters(each, {"whole": (F.col("n") >= 3) & (F.col("found") == 0), "partial": (F.col("found") > 0) & (F.col("found") < F.col("n"))})


@query("a_26", "SELECT doc_id, count(*) OVER (PARTITION BY source) AS n FROM documents")
def a_26(spark, sf):
    return O.with_group_count(table(spark, sf, "documents").select("doc_id", "source"), "source", "n").select("doc_id", "n")


@query("w_08", f"WITH RECURSIVE {SPANS}, {line_sql('spans')} SELECT page, line, n FROM lined")
def w_08(spark, sf):
    return G.lines(G.rotated(spans(spark, sf)), ["page", "bucket"]).select("page", "line", "n")


@query("w_09", CELL_SQL + "SELECT DISTINCT page, row_y, cell FROM c")
def w_09(spark, sf):
    return G.cells(G.rotated(spans(spark, sf).where("rotation = 0")).select("page", F.col("y").alias("row_y"), "along", "width", "font_size", "text"), ["page", "row_y"]).select("page", "row_y", "cell")


@query("t_01", with_sql("artwork", "SELECT artwork_type, version_number, id FROM artwork"))
def t_01(spark, sf):
    return artworks(spark, sf).select("artwork_type", "version_number", "id").orderBy("artwork_type", F.desc("version_number"), "id")


@query("t_02", with_sql("artwork", "SELECT id, uploaded_at FROM artwork"))
def t_02(spark, sf):
    return artworks(spark, sf).select("id", "uploaded_at").orderBy(F.desc_nulls_last("uploaded_at"), "id")


@query("t_05", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def t_05(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.best_row(rows, ["l_suppkey"], F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber")), ["l_orderkey", "l_linenumber"])


@query("t_06", R.SQL["b_10"].replace("SELECT * FROM o", "SELECT a_id, overall FROM o"))
def t_06(spark, sf):
    return B.parameter_records(R.paired(spark, sf), R.FIELDS).select("a_id", "overall").orderBy(F.desc("overall"), "a_id")


@query("t_07", DISPLAY_SQL)
def t_07(spark, sf):
    return G.display_lines(G.lines(G.rotated(titled(spark, sf)), ["page", "bucket"]), ["page"], 10)


def ink_grids(spark, sf):
    """Pixels of an image as a 64-wide grid of counts."""
    place = (F.col("r") * 31 + F.col("g")) % 2048
    filled = pixels(spark, sf).groupBy("image", place.alias("p")).agg(F.count("*").alias("n"))
    listed = filled.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("p", (F.col("n") * 12).cast("int").alias("v")))).alias("at"))
    return listed.select("image", G.filled_grid(F.col("at"), 2048).alias("cells"))


@query("t_09", None)
def t_09(spark, sf):
    return G.ink_regions(ink_grids(spark, sf), "image", "cells")


@query("t_12", "SELECT p_brand, list_sort(list(DISTINCT p_name), 'DESC') AS x FROM part GROUP BY 1")
def t_12(spark, sf):
    names = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("n"))
    return names.select("p_brand", F.sort_array("n", asc=False).alias("x"))


@query("u_04", R.SQL["b_08"].split("SELECT p.*")[0] + "SELECT p.pair, count(DISTINCT nutrient) AS n FROM p JOIN duo USING (pair) GROUP BY 1")
def u_04(spark, sf):
    keys = lambda c: F.coalesce(F.map_keys(F.from_json(c, "map<string,string>")), F.array().cast("array<string>"))
    return R.nutrition_texts(spark, sf).select("pair", F.size(F.array_union(keys("a"), keys("b"))).cast("long").alias("n"))


@query("u_09", "SELECT conv_id, arg_min(role, turn) AS role, count(DISTINCT role) - 1 AS conflicts FROM conversations GROUP BY 1")
def u_09(spark, sf):
    pages = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    merged = A.map_conflicts(pages.withColumn("field", F.lit("role")), ["conv_id"], "field", "role", "turn")
    return merged.select("conv_id", F.col("kept").alias("role"), F.size("conflicts").cast("long").alias("conflicts"))


@query("u_10", None)
def u_10(spark, sf):
    rows = boxes(spark, sf).select("page", "x0", "y0", "x1", "y1", (F.col("id") % 100).cast("double").alias("confidence"), F.col("id").cast("string").alias("text"))
    return G.without_overlaps(rows, "page", 0.7).select("page", "text")


# comparison


@query("b_15", with_sql("label", f"WITH {R.ROWS} SELECT a_id, field, CASE WHEN field IN ('fssai_number', 'package_size') THEN {R.EXACT} ELSE {R.PARAM} END AS result FROM f"))
def b_15(spark, sf):
    a, b = F.col("a"), F.col("b")
    kind = F.when(F.col("field").isin("fssai_number", "package_size"), B.exact_state(a, b)).otherwise(B.parameter_state(a, b))
    return R.rows(spark, sf).select("a_id", "field", kind.alias("result"))


@query("b_18", R.SQL["b_10"].replace("SELECT * FROM o", "SELECT a_id % 20 AS subject, arg_max(a_id, (overall, -a_id)) AS a_id FROM o WHERE overall >= 20 GROUP BY 1"))
def b_18(spark, sf):
    scored = B.parameter_records(R.paired(spark, sf), R.FIELDS).where("overall >= 20").select((F.col("a_id") % 20).alias("subject"), "a_id", "overall")
    return B.best_match(scored, "subject", "overall", "a_id").select("subject", "a_id")


@query("b_20", R.SQL["b_10"].replace("SELECT * FROM o", "SELECT a_id, b_id, overall, verdict FROM o"))
def b_20(spark, sf):
    return cut(B.parameter_records(R.paired(spark, sf), R.FIELDS).select("a_id", "b_id", "overall", "verdict"), "verdicts")


_STATE = "CASE WHEN {0} IS NULL THEN 'MISSING' WHEN {0} <= 4 THEN 'MATCH' WHEN {0} <= 12 THEN 'SIMILAR' ELSE 'CONFLICT' END"


@query("b_23", f"""
WITH {R._HASH}, side AS (SELECT e.vec_id, h.h, list_transform(embedding, lambda x: abs(x)::DOUBLE) AS x, label % 3 = 0 AS ran, CASE WHEN label % 6 = 0 THEN h.h END AS logo FROM embeddings e JOIN h ON h.vec_id = e.vec_id),
two AS (SELECT a.vec_id, bit_count(xor(a.h, b.h)) AS d, a.ran OR b.ran AS ran, bit_count(xor(a.logo, b.logo)) AS l, list_sum(list_transform(list_zip(a.x, b.x), lambda p: least(p[1] / list_sum(a.x), p[2] / list_sum(b.x)))) AS share FROM side a JOIN side b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, 'layout' AS aspect, {_STATE.format('d')} AS status FROM two
UNION ALL SELECT vec_id, 'colour', CASE WHEN share >= 0.85 THEN 'MATCH' WHEN share >= 0.6 THEN 'SIMILAR' ELSE 'CONFLICT' END FROM two
UNION ALL SELECT vec_id, 'logo', {_STATE.format('l')} FROM two WHERE ran""")  # fmt: skip
def b_23(spark, sf):
    h = R.hashes(spark, sf).join(table(spark, sf, "embeddings"), "vec_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double")))
    prints = h.withColumn("t", total)
    side = prints.select("vec_id", F.struct(F.col("h").alias("hash"), F.transform("embedding", lambda x: F.abs(x.cast("double")) / F.col("t")).alias("histogram"), (F.col("label") % 3 == 0).alias("logo_ran"), F.when(F.col("label") % 6 == 0, F.col("h")).alias("logo_hash")).alias("p"))
    both = side.join(side.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("o")), "vec_id")
    return both.select("vec_id", F.explode(B.fingerprint_rows(F.col("p"), F.col("o"))).alias("x")).select("vec_id", "x.*")


@query("b_24", f"WITH {R._HASH} SELECT c.vec_id, bit_count(xor(c.h, s.h))::INTEGER AS distance FROM h c, h s WHERE s.vec_id = 7")
def b_24(spark, sf):
    h = R.hashes(spark, sf)
    subject = h.where("vec_id = 7").first()
    return h.select("vec_id", B.hash_distance(F.col("h"), F.lit(subject["h"] if subject else None).cast("long")).alias("distance"))


@query("c_04", with_sql("artwork", "SELECT id, first AS other FROM (SELECT id, min(id) OVER (PARTITION BY product_id, artwork_type, version_number % 3) AS first FROM artwork) WHERE id <> first"))
def c_04(spark, sf):
    rows = artworks(spark, sf).select("id", "product_id", "artwork_type", (F.col("version_number") % 3).alias("v"))
    first = rows.groupBy("product_id", "artwork_type", "v").agg(F.min("id").alias("other"))
    return rows.join(first, ["product_id", "artwork_type", "v"]).where("id <> other").select("id", "other")


# text


@query("x_04", "SELECT doc_id, CASE WHEN contains(text, 'the') AND contains(text, 'of') THEN length(text) - strpos(reverse(text), 'eht') - 2 > length(text) - strpos(reverse(text), 'fo') - 1 ELSE contains(text, 'the') END AS x FROM documents")
def x_04(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", X.governed_by_making(F.length(text), X.offsets(text, "the"), X.offsets(text, "of")).alias("x"))


def _fields(name, column):
    @query(name, None)
    def run(spark, sf):
        return L.label_fields(table(spark, sf, "documents"), "doc_id", "text", ["Mango", "Orange"], [column])


for _name, _column in (("x_06", "marketing_company"), ("x_07", "address"), ("x_09", "package_size"), ("x_13", "flavour"), ("x_14", "product"), ("x_15", "brand")):
    _fields(_name, _column)


@query("x_24", None)
def x_24(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.generic_claims(F.col("text")).alias("claims"))


@query("x_05", None)
def x_05(spark, sf):
    return labels(spark, sf).select("id", L.cut_noise(F.col("claims"), 200).alias("x"))


@query("x_30", with_sql("label", "SELECT id, id % 2 = 0 AS x FROM label"))
def x_30(spark, sf):
    return labels(spark, sf).select("id", X.is_non_answer(F.when(F.col("id") % 2 == 0, F.lit(" Not visible. ")).otherwise(F.col("product_name"))).alias("x"))


@query("x_41", with_sql("label", "SELECT id, string_split(product_name, ' ') AS x FROM label"))
def x_41(spark, sf):
    joined = F.array_join(F.split("product_name", " "), " | ")
    return labels(spark, sf).select("id", F.filter(F.transform(F.split(joined, r"\|"), lambda v: F.trim(v)), lambda v: v != "").alias("x"))


@query("x_43", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::DOUBLE ELSE 0 END AS x FROM events")
def x_43(spark, sf):
    value = F.when(F.col("event_id") % 2 == 0, F.get_json_object("props", "$.k")).otherwise(F.lit("n/a"))
    return table(spark, sf, "events").select("event_id", F.coalesce(value.try_cast("double"), F.lit(0.0)).alias("x"))


# boxes


def words(spark, sf):
    """Boxes with a text: numbers and form words."""
    text = F.when(F.col("id") % 5 == 0, "gummies").when(F.col("id") % 5 == 1, F.concat(F.lit("v"), (F.col("id") % 4).cast("string"))).otherwise((F.col("id") % 90).cast("string"))
    return boxes(spark, sf).withColumns({"text": text, "confidence": (F.col("id") % 100).cast("double")})


@query("e_08", f"WITH box AS ({_BOX}) SELECT page, x0 AS x, (-y1)::DOUBLE AS y, 40.0::DOUBLE AS width, 12.0::DOUBLE AS font_size FROM box")
def e_08(spark, sf):
    return D.as_spans(words(spark, sf)).select("page", "x", "y", "width", "font_size")


@query("e_10", f"""
WITH box AS ({_BOX}), o AS (SELECT a.page, a.id, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS s
 FROM box a JOIN box b ON a.page = b.page AND a.id % 2 = 0 AND b.id % 2 = 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 GROUP BY 1, 2)
SELECT box.page, box.id, least(1.0, coalesce(s / 480.0, 0))::DOUBLE AS coverage FROM box LEFT JOIN o ON o.page = box.page AND o.id = box.id WHERE box.id % 2 = 0""")  # fmt: skip
def e_10(spark, sf):
    rows = boxes(spark, sf)
    return D.coverage(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "page")


_WORD = "CASE WHEN id % 5 = 0 THEN 'gummies' WHEN id % 5 = 1 THEN 'v' || (id % 4) ELSE (id % 90)::VARCHAR END"


@query("e_12", f"""
WITH box AS ({_BOX}), w AS (SELECT page, id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, (y0 + 45)::DOUBLE AS y1, {_WORD} AS text, (id % 100)::DOUBLE / 100 AS confidence FROM box),
hidden AS (SELECT a.page, a.id, sum((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0))) AS area FROM w a JOIN w b ON a.page = b.page AND a.id % 2 = 0 AND b.id % 2 = 1
 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY ALL)
SELECT w.* FROM w LEFT JOIN hidden USING (page, id) WHERE id % 2 = 0 AND confidence >= 0.6 AND coalesce(area, 0) / ((x1 - x0) * 45) <= 0.3 QUALIFY row_number() OVER (PARTITION BY page, text ORDER BY y0, x0, id DESC) = 1""")
def e_12(spark, sf):
    rows = words(spark, sf).withColumns({"y1": F.col("y0") + 45, "confidence": F.col("confidence") / 100})
    return D.outlined_lines(rows, D.coverage(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "page"), ["page"])


@query("e_15", f"WITH box AS ({_BOX}) SELECT page, id, y0::DOUBLE AS x0, (1000 - x1)::DOUBLE AS y0 FROM box")
def e_15(spark, sf):
    b = G.quarter_turned(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.lit(800.0), F.lit(1000.0), 90)
    return boxes(spark, sf).select("page", "id", b.alias("b")).select("page", "id", "b.x0", "b.y0")


@query("e_16", f"""
WITH box AS ({_BOX}), w AS (SELECT page, id, CASE WHEN id % 11 = 0 THEN 30 ELSE 12 END AS h FROM box), m AS (SELECT page, median(h) AS m FROM w GROUP BY 1)
SELECT DISTINCT page, 'gummies' AS text FROM w JOIN m USING (page) WHERE id % 5 = 0 AND id % 100 >= 60 AND h >= 1.6 * m""")
def e_16(spark, sf):
    taller = words(spark, sf).withColumn("y1", F.when(F.col("id") % 11 == 0, F.col("y0") + 30).otherwise(F.col("y1")))
    return G.prominent_word(taller, ["page"], "gummies|capsules")


@query("e_17", f"""
WITH box AS ({_BOX}), w AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'gummies' WHEN id % 5 = 1 THEN 'v' ELSE (id % 90)::VARCHAR END AS t, x0 + 20 AS cx, y0 + 6 AS cy FROM box),
n AS (SELECT f.page, f.cx, f.cy, m.t AS number, sqrt((f.cx - m.cx) * (f.cx - m.cx) + (f.cy - m.cy) * (f.cy - m.cy)) AS far FROM w f JOIN w m ON f.page = m.page AND f.t = 'gummies' AND m.id % 5 > 1 AND abs(f.cx - m.cx) <= 36 AND abs(f.cy - m.cy) <= 36)
SELECT page, 'gummies' AS form, arg_min(number, (far, number)) AS number FROM n WHERE far <= 36 GROUP BY page, cx, cy""")  # fmt: skip
def e_17(spark, sf):
    return D.nearest_number(words(spark, sf), ["page"], "gummies")


@query("e_18", f"""
WITH box AS ({_BOX}), b AS (SELECT page, arg_min(x0, (y0, id)) AS bx, min(y0) + 12 AS low FROM box GROUP BY 1)
SELECT page, arg_min({_WORD}, (y0 - low, x0, {_WORD})) AS text FROM box JOIN b USING (page) WHERE y0 - low BETWEEN 0 AND 180 AND abs(x0 - bx) <= 120 GROUP BY 1""")
def e_18(spark, sf):
    rows = words(spark, sf)
    brand = W.best_row(rows.select("page", "x0", "y0", "y1", "id"), ["page"], F.struct(-F.col("y0"), -F.col("id")))
    return D.title_rows(brand, rows, "page")


@query("e_20", with_sql("label", "SELECT id, id % 100 >= 70 AS x FROM label"))
def e_20(spark, sf):
    return labels(spark, sf).select("id", D.cross_validated(F.col("product_name"), F.upper("product_name"), (F.col("id") % 100).cast("double")).alias("x"))


@query("e_21", with_sql("label", "SELECT id, 3 AS start, 2 AS size FROM label"))
def e_21(spark, sf):
    found = D.anchor_windows(F.array(F.lit("no"), F.lit("of"), F.lit("Serving"), F.lit("Size"), F.col("product_name")), "serving size")
    return labels(spark, sf).select("id", found.alias("f")).select("id", "f.*")


@query("e_22", f"""
WITH box AS ({_BOX}), w AS (SELECT * FROM box WHERE id % 5 = 1)
SELECT page, min(x0) - (max(x1) - min(x0)) * 0.1 AS x0, min(y0)::DOUBLE AS y0 FROM w GROUP BY page HAVING count(DISTINCT id % 4) >= 3""")  # fmt: skip
def e_22(spark, sf):
    return D.panel_boxes(words(spark, sf), ["page"], ["v0", "V1", "v2", "v3"]).select("page", "x0", "y0")


@query("e_23", None)
def e_23(spark, sf):
    """The ingredients panel of each page of boxes, some of which list something."""
    text = F.when(F.col("id") % 3 == 0, F.concat_ws(", ", "text", F.lit("b"))).otherwise(F.col("text"))
    return D.ingredients_panel(words(spark, sf).withColumn("text", text), ["page"])


@query("e_24", with_sql("label", "SELECT id, string_split(product_name, ' ') AS x FROM label WHERE split_part(product_name, ' ', 2) <> ''"))
def e_24(spark, sf):
    items = F.concat(F.split("product_name", " "), F.array(F.lit("absent")))
    return labels(spark, sf).select("id", D.corroborated(items, F.concat(F.lit("a. "), F.upper("product_name"))).alias("x")).where("x IS NOT NULL")


@query("e_25", None)
def e_25(spark, sf):
    """Names of a supplier's parts as lines of display type."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") % 100).alias("n")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select(F.col("l_suppkey").alias("page"), F.col("l_partkey").alias("position"), F.col("p_name").alias("text"), (F.col("n") / 100).alias("confidence"), F.lit(1).alias("occurrences"), (F.col("l_partkey") * 7 % 400).cast("double").alias("top"), F.lit(12.0).alias("height"))
    return D.role_options(rows.distinct(), "page")


@query("e_26", with_sql("label", "SELECT id, product_name AS value, 0.9::DOUBLE AS confidence FROM label"))
def e_26(spark, sf):
    options = F.array("product_name", "brand_name")
    r = D.resolved_role(F.col("product_name"), F.lit(0.9), F.concat(F.lit("the "), "product_name"), F.array("brand_name"), options)
    return labels(spark, sf).select("id", r.alias("r")).select("id", "r.value", "r.confidence")


@query("e_27", None)
def e_27(spark, sf):
    """Regions of the grids of t_09 outside of what words cover: every fourth block of eight columns."""
    read = F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: F.floor(i % 64 / 8) % 4 == 0)
    return G.ink_regions(ink_grids(spark, sf).withColumn("read", read), "image", "cells", covered="read")


@query("e_28", with_sql("label", "SELECT id, replace(product_name, ' ', '-') AS x FROM label"))
def e_28(spark, sf):
    return labels(spark, sf).select("id", D.clean_heading(F.replace("product_name", F.lit(" "), F.lit(" - "))).alias("x"))


@query("e_29", f"WITH box AS ({_BOX}) SELECT page, id, 480 / 500000 BETWEEN 0.0005 AND 0.12 AND 40 / 12 BETWEEN 0.2 AND 5 AS x FROM box")
def e_29(spark, sf):
    ok = D.logo_box_ok(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(500000.0), F.lit(0.1))
    return boxes(spark, sf).select("page", "id", ok.alias("x"))


# cascades, scoring and the log


@query("k_01", with_sql("label", "SELECT id, 'vlm' AS source, true AS needs_review FROM label WHERE claims IS NOT NULL"))
def k_01(spark, sf):
    return labels(spark, sf).select("id", K.tagged(F.col("claims"), "vlm").alias("r")).where("r IS NOT NULL").select("id", "r.source", "r.needs_review")


@query("k_03", with_sql("label", f"""
SELECT id, 'brand_name' AS field, brand_name AS value, '{K.SNAPPED}' AS source FROM label
UNION ALL SELECT id, 'product_name', CASE WHEN id % 4 = 0 THEN upper(product_name) ELSE product_name END, CASE WHEN id % 4 = 0 THEN '{K.ORDERED}' ELSE '{K.FLAT}' END FROM label
 WHERE NOT (split_part(product_name, ' ', 1) = split_part(product_name, ' ', 2) OR (length(split_part(product_name, ' ', 1)) <= 3 AND length(split_part(product_name, ' ', 2)) <= 3))
UNION ALL SELECT id, 'claims', coalesce(claims, 'read later'), CASE WHEN claims IS NULL THEN '{K.ORDERED}' ELSE '{K.FLAT}' END FROM label"""))  # fmt: skip
def k_03(spark, sf):
    """A label read twice: garbage is no name, brands are snapped to their list, the flattened text wins."""
    rows = labels(spark, sf)
    flat = rows.select("id", F.when(F.col("id") % 3 == 0, F.lit("a bc de")).otherwise(F.lower("brand_name")).alias("brand_name"), F.when(F.col("id") % 4 == 0, F.lit("Go go")).otherwise(F.col("product_name")).alias("product_name"), "claims")
    ordered = rows.select("id", F.upper("brand_name").alias("brand_name"), F.upper("product_name").alias("product_name"), F.lit("read later").alias("claims"))
    return K.merged_layers(flat, ordered, "id", ["brand_name", "product_name", "claims"], rows.select(F.col("brand_name").alias("brand")).distinct())


@query("k_05", with_sql("label", "SELECT id, CASE WHEN id % 2 = 0 THEN product_name END AS product_name, coalesce(claims, 'more') AS claims, CASE WHEN id % 3 = 0 THEN address END AS address, coalesce(fssai_number, '9') AS fssai_number FROM label"))
def k_05(spark, sf):
    rows = labels(spark, sf).select("id", F.when(F.col("id") % 2 == 0, F.col("product_name")).alias("product_name"), "claims", F.when(F.col("id") % 3 == 0, F.col("address")).alias("address"), "fssai_number")
    read = labels(spark, sf).select("id", F.lit("no").alias("product_name"), F.lit("more").alias("claims"), F.lit("no").alias("address"), F.lit("9").alias("fssai_number"))
    return K.patched(rows, read, "id", ["product_name", "claims", "address", "fssai_number"])


@query("q_09", R.SQL["q_04"])  # word order in a name makes no difference here
def q_09(spark, sf):
    parse = lambda c: F.from_json(c, "map<string,string>")
    keyed = lambda c: F.transform_keys(parse(c), lambda k, _: F.array_join(T.key_tokens(k), " "))
    return R.nutrition_texts(spark, sf).select("pair", S.map_score(keyed("a"), keyed("b")).alias("t")).select("pair", "t.*")


@query("q_10", with_sql("label", f"""
WITH {R.ROWS}, n AS (SELECT *, nullif({R._VALUE.format('a')}, '') AS g, nullif({R._VALUE.format('b')}, '') AS w, coalesce(list_distinct(string_split(lower(a), ', ')), []) AS gl, coalesce(list_distinct(string_split(lower(b), ', ')), []) AS wl FROM f),
c AS (SELECT *, CASE WHEN w IS NULL THEN g IS NULL WHEN field = 'address' THEN coalesce(contains(g, w) OR contains(w, g), false) ELSE coalesce(g = w, false) END AS ok FROM n)
SELECT a_id, field, CASE WHEN field = 'ingredients' THEN len(list_intersect(gl, wl)) + (len(gl) = 0 AND len(wl) = 0)::BIGINT ELSE ok::BIGINT END AS correct,
 CASE WHEN field = 'ingredients' THEN len(list_filter(gl, lambda x: NOT list_contains(wl, x))) ELSE (g IS NOT NULL AND NOT ok)::BIGINT END AS wrong,
 CASE WHEN field = 'ingredients' THEN len(list_filter(wl, lambda x: NOT list_contains(gl, x))) ELSE (w IS NOT NULL AND g IS NULL)::BIGINT END AS missing FROM c"""))
def q_10(spark, sf):
    """Scored by the kind of field: contained for addresses, as lists for ingredients, as values otherwise."""
    a, b, field = F.col("a"), F.col("b"), F.col("field")
    scored = F.when(field == "address", S.tri_state(a, b, contained=True)).when(field == "ingredients", S.list_score(F.split(a, ", "), F.split(b, ", "))).otherwise(S.tri_state(a, b))
    return R.rows(spark, sf).select("a_id", "field", scored.alias("t")).select("a_id", "field", "t.*")


@query("q_11", with_sql("label", f"WITH {R.ROWS} SELECT a_id, avg(CASE WHEN b IS NULL THEN (a IS NULL)::INTEGER WHEN a IS NULL THEN 0 ELSE (contains(lower(a), lower(b)) OR contains(lower(b), lower(a)))::INTEGER END) AS credit FROM f GROUP BY a_id, b_id"))
def q_11(spark, sf):
    a, b = F.lower("a"), F.lower("b")
    credit = F.when(b.isNull(), a.isNull().cast("int")).when(a.isNull(), 0).otherwise((F.contains(a, b) | F.contains(b, a)).cast("int"))
    return R.rows(spark, sf).groupBy("a_id", "b_id").agg(F.avg(credit).alias("credit")).drop("b_id")


@query("l_05", with_sql("history", "SELECT id, resulting_status FROM history UNION ALL SELECT max(id) + 1, 'Rejected' FROM history"))
def l_05(spark, sf):
    """The log grows by appending; a batch that comes again adds nothing, one that would change an entry is refused."""
    rows = history(spark, sf).select("id", "resulting_status")
    log = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    ledger.append(log, rows, "first", ["id"])
    entry = rows.agg((F.max("id") + 1).alias("id")).withColumn("resulting_status", F.lit("Rejected"))
    for _ in range(2):
        ledger.append(log, entry, "second", ["id"])
    for batch, change in (("second", entry.withColumn("resulting_status", F.lit("Draft"))), ("third", rows.withColumn("resulting_status", F.lit("Draft")))):
        try:
            ledger.append(log, change, batch, ["id"])
        except ledger.Refused:
            continue
        raise AssertionError(f"{batch} changed the log")
    return ledger.read(spark, log)

