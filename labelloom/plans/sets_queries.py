"""Queries on joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom.functions import text as X
from labelloom.operators import aggregates as A
from labelloom.operators import joins as J
from labelloom.operators import windows as W
from labelloom.operators.scans import medians, sessions_by_gap
from labelloom.sources.domain import APPROVED, artworks, history, labels, products, table, with_sql

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None):
    def keep(f):
        Q[name], SQL[name] = f, sql
        return f

    return keep


LATEST = """latest AS (SELECT * FROM artwork WHERE status IN ('Approved', 'Final Approved')
 QUALIFY row_number() OVER (PARTITION BY product_id, artwork_type ORDER BY version_number DESC, id DESC) = 1)"""
LAST = """last AS (SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY comparison_id ORDER BY occurred_at DESC, id DESC) = 1)"""


# windows


@query("w_01", with_sql("artwork", f"WITH {LATEST} SELECT * FROM latest"))
def w_01(spark, sf):
    return W.latest_approved(artworks(spark, sf))


@query("s_04", with_sql("artwork", f"WITH {LATEST} SELECT product_id, artwork_type, id FROM latest"))
def s_04(spark, sf):
    return W.latest_approved(artworks(spark, sf)).select("product_id", "artwork_type", "id")


@query("w_02", with_sql("artwork", "SELECT * FROM artwork WHERE status <> 'Archived' QUALIFY row_number() OVER (PARTITION BY product_id, artwork_type ORDER BY version_number DESC) = 1"))
def w_02(spark, sf):
    return W.highest_version(artworks(spark, sf))


@query("w_03", with_sql("history", f"WITH {LAST} SELECT comparison_id, id, resulting_status FROM last"))
def w_03(spark, sf):
    return W.last_entry(history(spark, sf)).select("comparison_id", "id", "resulting_status")


@query("w_04", with_sql("history", """
SELECT comparison_id, id FROM history WHERE stage = 'Manager' AND resulting_status = 'Final Approved'
QUALIFY row_number() OVER (PARTITION BY comparison_id ORDER BY occurred_at DESC, id DESC) = 1"""))  # fmt: skip
def w_04(spark, sf):
    return W.last_entry(history(spark, sf), (F.col("stage") == "Manager") & (F.col("resulting_status") == "Final Approved")).select("comparison_id", "id")


@query("w_05", with_sql("history", f"WITH {LAST} SELECT comparison_id, greatest(0, floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(occurred_at))) / 86400))::BIGINT AS days FROM last"))
def w_05(spark, sf):
    days = W.days_since(F.col("occurred_at").cast("timestamp"), F.lit("2024-02-01").cast("timestamp"))
    return W.last_entry(history(spark, sf)).select("comparison_id", days.alias("days"))


@query("w_06", with_sql("artwork", "SELECT product_id, artwork_type, max(version_number) + 1 AS next_version FROM artwork GROUP BY ALL"))
def w_06(spark, sf):
    return W.next_version(artworks(spark, sf))


@query("w_06b", with_sql("artwork", """
WITH kept AS (SELECT * FROM artwork WHERE status <> 'Draft'), lagged AS (SELECT id, version_number, lag(version_number) OVER (PARTITION BY product_id, artwork_type ORDER BY version_number) AS previous FROM kept)
SELECT * FROM lagged WHERE version_number <> coalesce(previous, 0) + 1"""))  # fmt: skip
def w_06b(spark, sf):
    return W.version_gaps(artworks(spark, sf).where("status <> 'Draft'")).select("id", "version_number", "previous")


@query("w_07", """
WITH spans AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS s, epoch_us(ts) / 1000000 + value AS e FROM events),
reach AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM spans)
SELECT event_id, (sum(CASE WHEN r IS NULL OR s > r + 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS band FROM reach""")  # fmt: skip
def w_07(spark, sf):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    spans = table(spark, sf, "events").select("user_id", "event_id", start.alias("s"), (start + F.col("value")).alias("e"))
    return sessions_by_gap(spans, ["user_id"], "s", "e", F.lit(3600)).select("event_id", "band")


@query("w_11", """
SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type""")  # fmt: skip
def w_11(spark, sf):
    return W.changed_only(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type")).select("event_id")


@query("w_12", """
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM p)
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM i GROUP BY l_orderkey, k""")  # fmt: skip
def w_12(spark, sf):
    return W.runs(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey"], "l_linenumber")


@query("w_13", with_sql("label", "SELECT id, coalesce(claims, ingredients, flavour, 'none') AS value FROM label"))
def w_13(spark, sf):
    return labels(spark, sf).select("id", F.coalesce(*[X.blank_to_null(c) for c in ("claims", "ingredients", "flavour")], F.lit("none")).alias("value"))


@query("w_14", """
SELECT conv_id, arg_min(role, turn) FILTER (role <> 'system') AS role, arg_min(text, turn) AS text FROM conversations GROUP BY 1""")  # fmt: skip
def w_14(spark, sf):
    pages = table(spark, sf, "conversations").withColumn("role", F.nullif(F.col("role"), F.lit("system")))
    one = pages.groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return one.groupBy("conv_id").agg(F.min_by("role", F.when(F.col("role").isNotNull(), F.col("turn"))).alias("role"), F.min_by("text", "turn").alias("text"))


@query("w_15", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1")
def w_15(spark, sf):
    return W.best_candidate(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey"], "l_extendedprice", "l_linenumber")


# joins


@query("j_01", with_sql("artwork, product", f"""
WITH {LATEST}, pairs AS (SELECT a.id, a.product_id, a.version_number, r.id AS reference_id, r.version_number AS reference_version
 FROM artwork a LEFT JOIN artwork r ON r.product_id = a.product_id AND r.artwork_type = a.artwork_type AND r.version_number = a.version_number - 1)
SELECT pairs.*, product_name, brand FROM pairs JOIN product p ON p.id = pairs.product_id"""))  # fmt: skip
def j_01(spark, sf):
    art = artworks(spark, sf)
    before = art.select("product_id", "artwork_type", (F.col("version_number") + 1).alias("version_number"), F.col("id").alias("reference_id"), F.col("version_number").alias("reference_version"))
    named = products(spark, sf).select(F.col("id").alias("product_id"), "product_name", "brand")
    joined = art.join(named, "product_id").join(before, ["product_id", "artwork_type", "version_number"], "left")
    return joined.select("id", "product_id", "version_number", "reference_id", "reference_version", "product_name", "brand")


@query("j_02", with_sql("history", """
SELECT comparison_id, list(id ORDER BY occurred_at, id) AS entries, list(DISTINCT stage ORDER BY stage) AS stages FROM history GROUP BY 1"""))  # fmt: skip
def j_02(spark, sf):
    log = history(spark, sf)
    parents = log.select("comparison_id").distinct()
    out = J.with_children(parents, {"entries": (log.select("comparison_id", "id", "occurred_at"), ["occurred_at", "id"]), "stages": (log.select("comparison_id", "stage").distinct(), ["stage"])}, "comparison_id")
    return out.select("comparison_id", F.transform("entries", lambda x: x["id"]).alias("entries"), F.transform("stages", lambda x: x["stage"]).alias("stages"))


@query("j_03", with_sql("artwork", f"WITH {LATEST} SELECT id FROM latest WHERE product_id = 11 AND artwork_type = '2-HIGH'"))
def j_03(spark, sf):
    art = artworks(spark, sf).where((F.col("product_id") == 11) & (F.col("artwork_type") == "2-HIGH"))
    return W.latest_approved(art).select("id")


_CROSS = """WITH {latest}, u AS (SELECT * FROM product WHERE id IN (SELECT product_id FROM latest))
SELECT a.id, count(*) AS candidates, min(b.id) AS first FROM product a JOIN u b ON lower(a.product_name) = lower(b.product_name) AND {differs} GROUP BY 1"""


@query("j_04", with_sql("product, artwork", _CROSS.format(latest=LATEST, differs="lower(a.marketing_company) <> lower(b.marketing_company)")))
def j_04(spark, sf):
    return J.cross_company(products(spark, sf), W.latest_approved(artworks(spark, sf)))


@query("j_05", with_sql("product, artwork", _CROSS.format(latest=LATEST, differs="a.marketing_company <> b.marketing_company")))
def j_05(spark, sf):
    return J.cross_company(products(spark, sf), W.latest_approved(artworks(spark, sf)), ignore_case=False)


@query("j_05b", with_sql("product, artwork", f"""
WITH {LATEST} SELECT a.id, b.id AS candidate FROM product a JOIN product b ON lower(a.product_name) = lower(b.product_name) AND a.marketing_company <> b.marketing_company
WHERE a.id IN (7, 42) AND b.id IN (SELECT product_id FROM latest)"""))  # fmt: skip
def j_05b(spark, sf):
    """All candidates of two requested products."""
    rows = products(spark, sf)
    return J.cross_company_candidates(rows.where(F.col("id").isin(7, 42)), rows, W.latest_approved(artworks(spark, sf)))


@query("j_04b", with_sql("product", "SELECT id, ((count(*) OVER (PARTITION BY lower(product_name))) - (count(*) OVER (PARTITION BY lower(product_name), marketing_company)))::BIGINT AS others FROM product"))
def j_04b(spark, sf):
    return J.cross_company_counts(products(spark, sf))


_DUP = """SELECT a.id AS record_id, min(b.id) AS product_id FROM product a JOIN product b
 ON lower(a.product_name) = lower(b.product_name) {brand} AND (a.marketing_company = b.marketing_company OR a.fssai_number = b.fssai_number) GROUP BY 1"""


@query("j_06", with_sql("product", _DUP.format(brand="AND lower(a.brand) = lower(b.brand)")))
def j_06(spark, sf):
    rows = products(spark, sf)
    return J.possible_duplicates(rows, rows)


@query("j_07", with_sql("product", _DUP.format(brand="")))
def j_07(spark, sf):
    rows = products(spark, sf)
    return J.possible_duplicates(rows, rows, with_brand=False)


@query("j_08", with_sql("product", """
WITH other AS (SELECT * FROM product WHERE id % 2 = 0), rec AS (SELECT * FROM product WHERE id % 2 = 1),
d AS (SELECT a.id, min(b.id) AS p FROM rec a JOIN other b ON lower(a.product_name) = lower(b.product_name) AND a.brand = b.brand AND (a.marketing_company = b.marketing_company OR a.fssai_number = b.fssai_number) GROUP BY 1),
i AS (SELECT a.id, min(b.id) AS p FROM rec a JOIN other b ON lower(a.product_name) = lower(b.product_name) AND (a.marketing_company = b.marketing_company OR a.fssai_number = b.fssai_number) GROUP BY 1)
SELECT rec.id, coalesce(CASE WHEN rec.id % 10 = 1 THEN rec.id - 1 END, d.p, i.p) AS product_id,
 CASE WHEN rec.id % 10 = 1 THEN 'linked' WHEN d.p IS NOT NULL THEN 'duplicate' WHEN i.p IS NOT NULL THEN 'identified' ELSE 'new' END AS how
FROM rec LEFT JOIN d ON d.id = rec.id LEFT JOIN i ON i.id = rec.id"""))  # fmt: skip
def j_08(spark, sf):
    rows = products(spark, sf)
    records, known = rows.where("id % 2 = 1"), rows.where("id % 2 = 0")
    links = records.where("id % 10 = 1").select(F.col("id").alias("record_id"), (F.col("id") - 1).alias("product_id"))
    return J.identity_cascade(records, links, J.possible_duplicates(records, known), J.possible_duplicates(records, known, with_brand=False))


@query("j_09", with_sql("artwork, product", "SELECT a.id, coalesce(p.flavour, '—') AS flavour FROM artwork a LEFT JOIN product p ON p.id = a.product_id"))
def j_09(spark, sf):
    lookup = products(spark, sf).select(F.col("id").alias("product_id"), "flavour")
    return J.looked_up(artworks(spark, sf).select("id", "product_id"), lookup, "product_id", ["flavour"]).select("id", "flavour")


@query("j_10", with_sql("history", "SELECT actor_name, arg_max(actor_role, id) AS role FROM history GROUP BY 1"))
def j_10(spark, sf):
    return J.last_by_name(history(spark, sf).select("actor_name", F.col("actor_role").alias("role"), "id"), "actor_name", "id").select("actor_name", "role")


@query("j_11", "SELECT n_regionkey, list(n_name || '=' || (n_nationkey % 2 = 0) ORDER BY n_name) AS x FROM nation GROUP BY 1")
def j_11(spark, sf):
    rows = table(spark, sf, "nation").withColumn("allowed", F.col("n_nationkey") % 2 == 0)
    out = J.overrides_map(rows, "n_regionkey", "n_name", "allowed")
    return out.select("n_regionkey", F.transform(F.array_sort(F.map_entries("overrides")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))).alias("x"))


@query("p_23", "SELECT n_nationkey, (CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 2 = 0 ELSE true END) AS reports FROM nation")
def p_23(spark, sf):
    own = F.when(F.col("n_nationkey") % 3 == 0, F.create_map(F.lit("reports"), F.col("n_nationkey") % 2 == 0))
    policy = J.allowed(F.create_map(F.lit("reports"), F.lit(True), F.lit("users"), F.lit(False)), own)
    return table(spark, sf, "nation").select("n_nationkey", F.element_at(policy, "reports").alias("reports"))


_NUTRIENTS = "SELECT l_orderkey AS id, 'N ' || l_linenumber AS nutrient, min(l_quantity)::INTEGER || ' mg' AS amount FROM lineitem GROUP BY ALL"


def nutrients(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.concat(F.lit("N "), F.col("l_linenumber").cast("string")).alias("nutrient")).agg(F.concat(F.min("l_quantity").cast("int").cast("string"), F.lit(" mg")).alias("amount"))


@query("j_14", f"""
SELECT (id // 2)::BIGINT AS pair, nutrient, max(CASE WHEN id % 2 = 0 THEN amount END) AS a, max(CASE WHEN id % 2 = 1 THEN amount END) AS b FROM ({_NUTRIENTS}) GROUP BY 1, 2""")
def j_14(spark, sf):
    rows = nutrients(spark, sf).withColumn("pair", F.floor(F.col("id") / 2))
    return J.nutrition_pairs(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), ["pair"], "nutrient", "amount")


_BOX = "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, min(l_quantity) * 10 AS x0, min(l_partkey % 97) * 5.0 AS y0, min(l_quantity) * 10 + 40 AS x1, min(l_partkey % 97) * 5.0 + 12 AS y1 FROM lineitem GROUP BY 1, 2"


def boxes(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    at = rows.agg((F.min("l_quantity") * 10).alias("x0"), (F.min(F.col("l_partkey") % 97) * 5.0).cast("double").alias("y0"))
    return at.withColumn("x1", F.col("x0") + 40).withColumn("y1", F.col("y0") + 12)


@query("j_16", f"""
WITH box AS ({_BOX}), p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, least(a.x1, b.x1) - greatest(a.x0, b.x0) AS w, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS h
 FROM box a JOIN box b ON a.page = b.page AND a.id % 2 = 0 AND b.id % 2 = 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT page, a_id, b_id, (w * h)::DOUBLE AS area, (w * h / (960 - w * h))::DOUBLE AS iou FROM p""")  # fmt: skip
def j_16(spark, sf):
    rows = boxes(spark, sf)
    return J.box_overlaps(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "page", 64.0)


@query("j_17", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j_17(spark, sf):
    done = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti")


# aggregates


@query("a_01", with_sql("artwork", "SELECT count(*) FILTER (status = 'Draft') AS draft, count(*) FILTER (status = 'Under Review') AS review, count(*) FILTER (status = 'Final Approved') AS approved, count(*) AS total FROM artwork"))
def a_01(spark, sf):
    status = F.col("status")
    return A.counters(artworks(spark, sf), {"draft": status == "Draft", "review": status == "Under Review", "approved": status == "Final Approved", "total": F.lit(True)})


@query("a_02", with_sql("artwork, product, history", """
SELECT (SELECT count(*) FROM product WHERE status = 'Active') AS products, (SELECT count(*) FROM artwork) AS artworks, (SELECT count(DISTINCT comparison_id) FROM history) AS comparisons"""))  # fmt: skip
def a_02(spark, sf):
    one = A.counters(products(spark, sf), {"products": F.col("status") == "Active"})
    two = artworks(spark, sf).agg(F.count("*").alias("artworks"))
    three = history(spark, sf).agg(F.countDistinct("comparison_id").alias("comparisons"))
    both = one.unionByName(two, allowMissingColumns=True).unionByName(three, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


@query("a_03", with_sql("history", """
SELECT count(*) AS total, count(*) FILTER (resulting_status LIKE 'Pending%') AS pending, count(*) FILTER (strftime(occurred_at, '%Y-%m') = '2024-01') AS this_month, count(DISTINCT actor_name) AS users FROM history"""))  # fmt: skip
def a_03(spark, sf):
    rows = history(spark, sf)
    month = F.date_format("occurred_at", "yyyy-MM") == "2024-01"
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("resulting_status").startswith("Pending")).alias("pending"), F.count_if(month).alias("this_month"), F.countDistinct("actor_name").alias("users"))


@query("a_04", with_sql("history", """
SELECT actor_role, count(DISTINCT comparison_id) AS seen, count(DISTINCT comparison_id) FILTER (resulting_status = 'Revision Required') AS returned FROM history GROUP BY 1"""))  # fmt: skip
def a_04(spark, sf):
    rows = history(spark, sf)
    return rows.groupBy("actor_role").agg(F.countDistinct("comparison_id").alias("seen"), F.countDistinct(F.when(F.col("resulting_status") == "Revision Required", F.col("comparison_id"))).alias("returned"))


_SCORES = """scores AS (SELECT l.doc_id, 'quality' AS field, l.quality AS expected, (d.n_chars > 1500)::INTEGER AS predicted FROM labels l JOIN documents d USING (doc_id)
 UNION ALL SELECT l.doc_id, 'toxic', nullif(l.toxic, 0), CASE WHEN d.n_chars % 7 = 0 THEN 1 END FROM labels l JOIN documents d USING (doc_id))"""


def scores(spark, sf):
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    quality = both.select("doc_id", F.lit("quality").alias("field"), F.col("quality").alias("expected"), (F.col("n_chars") > 1500).cast("int").alias("predicted"))
    toxic = both.select("doc_id", F.lit("toxic").alias("field"), F.nullif(F.col("toxic"), F.lit(0)).alias("expected"), F.when(F.col("n_chars") % 7 == 0, 1).alias("predicted"))
    return quality.unionByName(toxic)


@query("a_10", f"""
WITH {_SCORES}, t AS (SELECT field, (predicted IS NOT DISTINCT FROM expected)::BIGINT AS correct, (predicted IS NOT NULL AND predicted IS DISTINCT FROM expected)::BIGINT AS wrong, (predicted IS NULL AND expected IS NOT NULL)::BIGINT AS missing FROM scores)
SELECT field, sum(correct)::BIGINT AS correct, sum(wrong)::BIGINT AS wrong, sum(missing)::BIGINT AS missing, sum(correct) / sum(correct + wrong + missing) AS accuracy FROM t GROUP BY ROLLUP (field)""")  # fmt: skip
def a_10(spark, sf):
    from labelloom.operators.scoring import tri_state

    rows = scores(spark, sf).select("field", tri_state(F.col("predicted").cast("string"), F.col("expected").cast("string")).alias("t")).select("field", "t.*")
    return A.accuracy_rollup(rows, "field")


@query("a_12", f"WITH {_SCORES} SELECT field, doc_id % 3 AS source, count(*) AS n, count(*) FILTER (predicted = expected) AS correct FROM scores WHERE predicted IS NOT NULL GROUP BY ALL")
def a_12(spark, sf):
    rows = scores(spark, sf).where(F.col("predicted").isNotNull()).withColumn("source", F.col("doc_id") % 3)
    return A.counters(rows, {"n": F.lit(True), "correct": F.col("predicted") == F.col("expected")}, ["field", "source"])


@query("a_13", f"""
WITH {_SCORES} SELECT field, count(*) FILTER (predicted IS NOT NULL) AS fabricated, count(*) AS opportunities, count(*) FILTER (predicted IS NOT NULL) / count(*) AS rate FROM scores WHERE expected IS NULL GROUP BY 1""")  # fmt: skip
def a_13(spark, sf):
    return A.fabrication(scores(spark, sf), ["field"])


@query("a_16", f"WITH {_SCORES} SELECT doc_id, avg(CASE WHEN predicted IS NOT DISTINCT FROM expected THEN 1.0 ELSE 0.0 END)::DOUBLE AS credit, count(predicted) = 0 AS blank FROM scores GROUP BY 1")
def a_16(spark, sf):
    rows = scores(spark, sf)
    return rows.groupBy("doc_id").agg(F.avg(F.col("predicted").eqNullSafe(F.col("expected")).cast("double")).alias("credit"), (F.count("predicted") == 0).alias("blank"))


@query("a_17", with_sql("artwork", "SELECT product_id, coalesce(max(version_number), 0) + 1 AS n FROM artwork GROUP BY 1"))
def a_17(spark, sf):
    return artworks(spark, sf).groupBy("product_id").agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("n"))


@query("a_18", with_sql("artwork", "SELECT id, version_number = max(version_number) OVER (PARTITION BY product_id, artwork_type) AS is_latest FROM artwork"))
def a_18(spark, sf):
    return W.with_latest_flag(artworks(spark, sf), ["product_id", "artwork_type"]).select("id", "is_latest")


_PIXELS = "pixels AS (SELECT l_suppkey AS image, (l_partkey * 7 % 256)::INTEGER AS r, (l_orderkey * 13 % 256)::INTEGER AS g, (l_linenumber * 37 % 256)::INTEGER AS b FROM lineitem)"


def pixels(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") * 7 % 256).cast("int").alias("r"), (F.col("l_orderkey") * 13 % 256).cast("int").alias("g"), (F.col("l_linenumber") * 37 % 256).cast("int").alias("b"))


@query("a_19", f"WITH {_PIXELS} SELECT image, bin, n / sum(n) OVER (PARTITION BY image) AS share FROM (SELECT image, (r * 6 // 256) * 36 + (g * 6 // 256) * 6 + (b * 6 // 256) AS bin, count(*) AS n FROM pixels GROUP BY 1, 2)")
def a_19(spark, sf):
    return A.colour_histogram(pixels(spark, sf), "image")


_NAMED = f"""{_PIXELS}, unit AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM pixels),
hsl AS (SELECT *, (hi + lo) / 510.0::DOUBLE AS l, CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (255.0::DOUBLE - abs(hi + lo - 255)) END AS s,
        CASE WHEN hi = lo THEN 0 WHEN hi = r THEN 60.0::DOUBLE * (g - b) / (hi - lo) WHEN hi = g THEN 60.0::DOUBLE * (b - r) / (hi - lo) + 120 ELSE 60.0::DOUBLE * (r - g) / (hi - lo) + 240 END AS turn FROM unit),
hued AS (SELECT *, CASE WHEN turn < 0 THEN turn + 360 ELSE turn END AS h FROM hsl),
named AS (SELECT *, CASE WHEN l >= 0.9 AND s < 0.2 THEN 'White' WHEN l <= 0.12 THEN 'Black' WHEN s < 0.12 THEN 'Grey' WHEN l >= 0.8 AND s < 0.35 AND h >= 20 AND h < 70 THEN 'Cream' WHEN l < 0.42 AND h >= 10 AND h < 50 THEN 'Brown'
        WHEN h < 15 OR h >= 345 THEN 'Red' WHEN h < 45 THEN 'Orange' WHEN h < 70 THEN 'Yellow' WHEN h < 165 THEN 'Green' WHEN h < 195 THEN 'Teal' WHEN h < 255 THEN 'Blue' WHEN h < 290 THEN 'Purple' ELSE 'Pink' END AS name FROM hued),
palette AS (SELECT image, name, count(*) AS n, round(avg(r))::INTEGER AS r, round(avg(g))::INTEGER AS g, round(avg(b))::INTEGER AS b, count(*) / sum(count(*)) OVER (PARTITION BY image) AS coverage FROM named GROUP BY image, name)"""


@query("a_20", f"WITH {_NAMED} SELECT * FROM palette")
def a_20(spark, sf):
    return A.palette(pixels(spark, sf), "image")


@query("t_08", f"""WITH {_NAMED}, best AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY coverage DESC, name) AS k FROM palette WHERE name NOT IN ('White', 'Black', 'Grey', 'Cream') AND coverage >= 0.04)
SELECT image, string_agg(name, ' & ' ORDER BY k) AS theme FROM best WHERE k <= 2 GROUP BY image""")  # fmt: skip
def t_08(spark, sf):
    from pyspark.sql import Window

    colours = A.palette(pixels(spark, sf), "image").where(~F.col("name").isin(A.NEUTRAL) & (F.col("coverage") >= 0.04))
    order = Window.partitionBy("image").orderBy(F.desc("coverage"), "name")
    top = colours.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    return top.groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), " & ").alias("theme"))


@query("a_21", "SELECT l_orderkey, median(l_quantity) AS median, list_sort(list(l_quantity))[(count(*) // 2) + 1] AS upper_median FROM lineitem GROUP BY 1")
def a_21(spark, sf):
    return medians(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity")


@query("a_22", with_sql("label", "SELECT lower(regexp_replace(trim(product_name), '\\s+', ' ', 'g')) AS norm, count(*) AS n FROM label GROUP BY 1"))
def a_22(spark, sf):
    return labels(spark, sf).groupBy(F.lower(F.regexp_replace(F.trim("product_name"), r"\s+", " ")).alias("norm")).agg(F.count("*").alias("n"))


@query("a_23", f"WITH box AS ({_BOX}) SELECT page, min(x0) AS x0, min(y0)::DOUBLE AS y0, max(x1) AS x1, max(y1)::DOUBLE AS y1 FROM box GROUP BY 1")
def a_23(spark, sf):
    return boxes(spark, sf).groupBy("page").agg(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("a_24", with_sql("product", """SELECT DISTINCT 'brand' AS "column", brand AS value FROM product UNION ALL SELECT DISTINCT 'flavour', flavour FROM product WHERE flavour IS NOT NULL"""))
def a_24(spark, sf):
    return A.distinct_values(products(spark, sf), ["brand", "flavour"])


# sets


@query("u_01", with_sql("artwork, history", "SELECT id, uploaded_at AS at, 'upload' AS kind, NULL AS actor_name FROM artwork UNION ALL SELECT id, occurred_at, 'decision', actor_name FROM history"))
def u_01(spark, sf):
    uploads = artworks(spark, sf).select("id", F.col("uploaded_at").alias("at"), F.lit("upload").alias("kind"))
    return uploads.unionByName(history(spark, sf).select("id", F.col("occurred_at").alias("at"), F.lit("decision").alias("kind"), "actor_name"), allowMissingColumns=True)


@query("u_02", with_sql("history", "SELECT comparison_id, id FROM history"))
def u_02(spark, sf):
    nested = J.with_children(history(spark, sf).select("comparison_id").distinct(), {"entries": (history(spark, sf).select("comparison_id", "id"), ["id"])}, "comparison_id")
    return nested.select("comparison_id", F.explode("entries.id").alias("id"))


_WORDS = "words AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents)"


@query("u_03", with_sql("label", """
SELECT id, len(list_intersect(g, w)) AS correct, len(list_filter(g, lambda x: NOT list_contains(w, x))) AS wrong, len(list_filter(w, lambda x: NOT list_contains(g, x))) AS missing
FROM (SELECT id, string_split(ingredients, ', ') AS g, list_distinct(string_split(lower(claims), ' ')) AS w FROM label WHERE ingredients IS NOT NULL AND claims IS NOT NULL)"""))  # fmt: skip
def u_03(spark, sf):
    both = labels(spark, sf).where("ingredients IS NOT NULL AND claims IS NOT NULL").select("id", F.split("ingredients", ", ").alias("g"), F.split(F.lower("claims"), " ").alias("w"))
    size = lambda c: F.size(c).cast("long")
    return both.select("id", size(F.array_intersect("g", "w")).alias("correct"), size(F.array_except("g", "w")).alias("wrong"), size(F.array_except("w", "g")).alias("missing"))


@query("u_05", """
SELECT conv_id, list(role ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1""")  # fmt: skip
def u_05(spark, sf):
    pages = table(spark, sf, "conversations").select("conv_id", "turn", F.array("role").alias("roles"))
    return A.ordered_union(pages, "conv_id", "turn", "roles")


@query("u_06", """
WITH e AS (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS v, l_shipdate FROM lineitem), k AS (SELECT l_orderkey, l_linenumber, arg_min(v, (l_shipdate, v)) AS kept, list_sort(list(DISTINCT v)) AS a FROM e GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, kept, list_filter(a, lambda x: x <> kept) AS conflicts FROM k""")  # fmt: skip
def u_06(spark, sf):
    entries = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("v"), "l_shipdate")
    return A.map_conflicts(entries.withColumn("o", F.struct("l_shipdate", "v")), ["l_orderkey"], "l_linenumber", "v", "o")


@query("u_08", with_sql("label", "SELECT id, CASE WHEN len(string_split(coalesce(claims, ''), ' ')) > len(string_split(coalesce(ingredients, ''), ' ')) THEN claims ELSE ingredients END AS value FROM label"))
def u_08(spark, sf):
    n = lambda c: F.size(F.split(F.coalesce(F.col(c), F.lit("")), " "))
    return labels(spark, sf).select("id", F.when(n("claims") > n("ingredients"), F.col("claims")).otherwise(F.col("ingredients")).alias("value"))


assert APPROVED == W.APPROVED
