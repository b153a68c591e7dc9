"""Decisions over word boxes: nearest numbers, title rows, anchors, panels, candidates and their grounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.functions import vocabulary as V
from labelloom.functions.text import blank
from labelloom.operators.extract import has_whole_phrase
from labelloom.operators.joins import box_overlaps
from labelloom.operators.scans import dealt, previous, running
from labelloom.operators.shared import cut
from labelloom.operators.windows import best_row


def as_spans(words: DataFrame) -> DataFrame:
    """Reader words as spans: y upwards, the height as font size, no rotation."""
    return words.select("page", "text", F.col("x0").alias("x"), (-F.col("y1")).alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("font_size"), F.lit(0.0).alias("rotation"))


def merged_runs(spans: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """Neighbouring glyph runs whose gap is at most ``share`` of the font size become one span."""
    order = ["x", "text", "width", "font_size"]
    behind = previous(dealt(spans, keys, order), keys, order, F.col("x") + F.col("width"), "__q")
    opens = F.when(F.col("__q").isNull() | (F.col("x") - F.col("__q") > share * F.col("font_size")), 1).otherwise(0)
    numbered = running(cut(behind.withColumn("__new", opens), "runs"), keys, order, "__new", F.sum, "__g", inclusive=True)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda s: s["text"]), "")
    return numbered.groupBy(*keys, "__g").agg(text.alias("text"), F.min("x").alias("x"), F.max(F.col("x") + F.col("width")).alias("end")).drop("__g")


def coverage(boxes: DataFrame, others: DataFrame, page: str, cell: float = 64.0) -> DataFrame:
    """(page, id, coverage): share of each box under the other boxes, at most 1."""
    sums = box_overlaps(boxes, others, page, cell).groupBy(page, F.col("a_id").alias("id")).agg(F.sum("area").alias("__a"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return boxes.join(sums, [page, "id"], "left").select(page, "id", F.least(F.lit(1.0), F.coalesce(F.col("__a") / area, F.lit(0.0))).alias("coverage"))


def outlined_lines(lines: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """Confident tall lines that the text layer does not cover, each text once (the highest)."""
    kept = lines.join(covered, [*keys, "id"]).where((F.col("confidence") >= 0.6) & (F.col("y1") - F.col("y0") >= 40) & (F.col("coverage") <= 0.3))
    return best_row(kept.drop("coverage"), [*keys, "text"], F.struct(-F.col("y0"), -F.col("x0"), "id"))


def nearest_number(words: DataFrame, keys: list[str], forms: str, reach: float = 3.0) -> DataFrame:
    """(keys, form, number): the number of one to four digits nearest to each form word, within ``reach`` heights.

    Words meet in cells of their page as large as the reach of the tallest form word allows (its height is rounded up
    to a power of two), so a pair is found in one of the nine cells around.
    """
    centre = [(F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2]
    placed = words.select(*keys, "text", centre[0].alias("cx"), centre[1].alias("cy"), (F.col("y1") - F.col("y0")).alias("h"))
    formed = placed.where(F.lower("text").rlike(f"^(?:{forms})$")).withColumn("size", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("h") * reach))))
    sizes = formed.select(*keys, "size").distinct()
    numbers = placed.where(F.col("text").rlike(r"^\d{1,4}$")).join(sizes, keys).select(*keys, "size", F.col("text").alias("number"), F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    cell = lambda df, x, y: df.withColumns({"gx": F.floor(F.col(x) / F.col("size")), "gy": F.floor(F.col(y) / F.col("size"))})
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = cell(formed, "cx", "cy").withColumn("d", around).withColumns({"gx": F.col("gx") + F.col("d.i"), "gy": F.col("gy") + F.col("d.j")})
    met = spread.join(cell(numbers, "nx", "ny"), [*keys, "size", "gx", "gy"])
    far = F.hypot(F.col("cx") - F.col("nx"), F.col("cy") - F.col("ny"))
    near = met.withColumn("far", far).where(F.col("far") <= reach * F.col("h"))
    return near.groupBy(*keys, F.col("text").alias("form"), "cx", "cy").agg(F.min_by("number", F.struct("far", "number")).alias("number")).drop("cx", "cy")


def title_rows(brand: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """(key, text): the nearest line under the brand line of like size, 15 heights down and 10 sideways at most."""
    b = brand.select(key, F.col("x0").alias("bx"), F.col("y1").alias("by"), (F.col("y1") - F.col("y0")).alias("bh"))
    h = F.col("y1") - F.col("y0")
    met = lines.join(b, key).withColumn("down", F.col("y0") - F.col("by"))
    near = met.where((F.col("down") >= 0) & (F.col("down") <= 15 * F.col("bh")) & (F.abs(F.col("x0") - F.col("bx")) <= 10 * F.col("bh")) & (h / F.col("bh")).between(0.5, 4.0))
    return near.groupBy(key).agg(F.min_by("text", F.struct("down", "x0", "text")).alias("text"))


def cross_validated(word: Column, other: Column, confidence: Column) -> Column:
    a, b = F.lower(F.regexp_replace(word, r"[^\p{L}]", "")), F.lower(F.regexp_replace(other, r"[^\p{L}]", ""))
    return (F.least(F.length(a), F.length(b)) >= 4) & (confidence >= 70) & (F.contains(a, b) | F.contains(b, a))


def anchor_windows(words: Column, anchor: str, longest: int = 6) -> Column:
    """(start, size) of the first window of one to ``longest`` words that is the anchor, or null."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    sizes = F.sequence(F.lit(1), F.lit(longest))
    found = F.flatten(F.transform(starts, lambda s: F.transform(sizes, lambda n: F.when(F.lower(F.array_join(F.slice(words, s, n), " ")) == anchor.lower(), F.struct(s.alias("start"), n.alias("size"))))))
    return F.when(F.size(words) > 0, F.try_element_at(F.array_compact(found), F.lit(1)))


def panel_boxes(words: DataFrame, keys: list[str], anchors: list[str], least: int = 3, widen: float = 1.2) -> DataFrame:
    """Box around the anchor words of a page with ``least`` different ones, widened around its centre."""
    hit = words.where(F.lower("text").isin([a.lower() for a in anchors]))
    box = hit.groupBy(*keys).agg(*[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in ("x0", "y0", "x1", "y1")], F.countDistinct(F.lower("text")).alias("n")).where(F.col("n") >= least)
    half = (F.col("x1") - F.col("x0")) * (widen - 1) / 2
    return box.withColumns({"x0": F.col("x0") - half, "x1": F.col("x1") + half}).drop("n")


def corroborated(items: Column, reading: Column) -> Column:
    """Items that stand as whole phrases in an independent reading; kept if there are 2 to 60 of them."""
    kept = F.filter(items, lambda x: has_whole_phrase(reading, x))
    return F.when(F.size(kept).between(2, 60), kept)


AMOUNT = rf"(?i)\d\s*(?:{V.any_of(V.UNITS)}(?!\w)|%)|\(\s*\d+\s*\p{{L}}+\s*\)"  # a measure, or a count in brackets


def plain_words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def is_role_candidate(text: Column, confidence: Column, occurrences: Column) -> Column:
    """A confident reading that could be a name; a single word of three characters or less only if it occurs three times."""
    odd = F.contains(text, F.lit("₹")) | text.rlike(f"(?i){V.whole(V.NO_NAME)}") | text.rlike(AMOUNT)
    words = plain_words(text)
    short = ~F.contains(words, F.lit(" ")) & (F.length(words) < 4) & (F.coalesce(occurrences, F.lit(0)) <= 2)
    return (confidence >= 0.7) & ~odd & ~short


def role_options(candidates: DataFrame, key: str, cap: int = 24) -> DataFrame:
    """(key, options) of candidates (position, text, confidence, occurrences, top, height): each name once, in the first
    spelling, then neighbours from the top down that stand close (a gap below 1.2 heights), are of like size and differ;
    ``cap`` at most (part of the feature)."""
    kept = candidates.where(is_role_candidate(F.col("text"), F.col("confidence"), F.col("occurrences"))).withColumn("plain", plain_words(F.col("text")))
    singles = kept.groupBy(key, "plain").agg(F.min(F.struct("position", "text")).alias("x")).select(key, "plain", F.lit(0).alias("kind"), "x.position", "x.text")
    order = ["top", "position"]
    listed = dealt(kept.where("top IS NOT NULL").select(key, *order, "text", "plain", "height", F.lit(1).alias("one")), [key], order)
    above = cut(previous(listed, [key], order, F.struct("text", "plain", "top", "height"), "up"), "neighbours")
    placed = running(above, [key], order, "one", F.sum, "place")  # of the upper one
    large, small = F.greatest("height", "up.height"), F.least("height", "up.height")
    close = placed.where((F.col("top") - F.col("up.top") - F.col("up.height") < 1.2 * large) & (large <= 2 * small) & (F.col("plain") != F.col("up.plain")))
    pairs = close.select(key, F.concat_ws(" ", "up.plain", "plain").alias("plain"), F.lit(1).alias("kind"), F.col("place").alias("position"), F.concat_ws(" ", "up.text", "text").alias("text"))
    once = singles.unionByName(pairs).groupBy(key, "plain").agg(F.min(F.struct("kind", "position", "text")).alias("x"))
    order = Window.partitionBy(key).orderBy("x")
    first = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]).alias("options"))


def ingredients_panel(lines: DataFrame, keys: list[str], small: float = 32.0, least: int = 3, commas: int = 2) -> DataFrame:
    """Box and text of the longest run of small lines of a column that holds two commas and three lines at least.

    Lines that overlap along x are one column. In a column a line of large print or a gap of more than three heights
    ends a run. Of runs of one length the first from the left, then from the top, counts.
    """
    across, down = ["x0", "x1", "y0"], ["y0", "x0", "text"]
    reach = running(dealt(lines, keys, across), keys, across, "x1", F.max, "__r")
    opens = cut(reach.withColumn("__new", F.when(F.col("__r").isNull() | (F.col("x0") >= F.col("__r")), 1).otherwise(0)).drop("__r"), "columns")
    columns = running(opens, keys, across, "__new", F.sum, "column", inclusive=True).drop("__p", "__new")
    height = F.col("y1") - F.col("y0")
    little = (height > 0) & (height <= small)
    own = [*keys, "column"]
    above = previous(dealt(columns.withColumn("little", little), own, down), own, down, F.struct("little", "y1"), "__up")
    broken = ~F.coalesce(F.col("__up.little"), F.lit(False)) | (F.col("y0") - F.col("__up.y1") > 3 * height)
    marked = cut(above.withColumn("__first", F.when(broken, 1).otherwise(0)).drop("__up"), "runs")
    numbered = running(marked, own, down, "__first", F.sum, "run", inclusive=True).where("little")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), " ")
    found = numbered.groupBy(*keys, "column", "run").agg(F.count("*").alias("n"), text.alias("text"), *[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in ("x0", "y0", "x1", "y1")])
    listed = found.where((F.col("n") >= least) & (F.length(F.regexp_replace("text", "[^,]", "")) >= commas))
    return best_row(listed, keys, F.struct("n", -F.col("column"), -F.col("run"))).select(*keys, "n", "text", "x0", "y0", "x1", "y1")


def grounded(answer: Column, options: Column) -> Column:
    """Whether every word of an answer is a word of the options."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    known = F.flatten(F.transform(options, words))
    return ~blank(answer) & (F.size(F.array_except(words(answer), known)) == 0)


def resolved_role(answer: Column, confidence: Column, transcript: Column, repeated: Column, options: Column) -> Column:
    """struct(value, confidence): a grounded answer that the transcript holds, else the sole text repeated three times."""
    ok = grounded(answer, options) & has_whole_phrase(transcript, answer)
    return F.when(ok, F.struct(answer.alias("value"), F.least(confidence, F.lit(1.0)).alias("confidence"))).when(F.size(repeated) == 1, F.struct(F.try_element_at(repeated, F.lit(1)).alias("value"), F.lit(0.5).alias("confidence")))


def clean_heading(text: Column) -> Column:
    """A heading whose words are all clean, four letters in all, with tight hyphens; null otherwise."""
    tight = F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*-\s*", "-"), r"\s+", " "))
    fine = F.forall(F.split(tight, " "), lambda w: w.rlike(r"^[\p{L}\p{N}&'.,-]+$")) & (F.length(F.regexp_replace(tight, r"[^\p{L}]", "")) >= 4)
    return F.when(fine, tight)


def logo_box_ok(width: Column, height: Column, page_area: Column, body: Column) -> Column:
    share, aspect = width * height / page_area, width / F.nullif(height, F.lit(0.0))
    return F.coalesce(share.between(0.0005, 0.12) & aspect.between(0.2, 5.0) & (body < 0.5), F.lit(False))
