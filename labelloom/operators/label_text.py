"""Label fields whose rules look at neighbouring lines, as column expressions.

A text is an array of lines. What a rule needs of the lines around is taken by position, or carried along in one fold;
every field is a function of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import vocabulary as V
from labelloom.functions.arrays import let
from labelloom.operators import extract as X
from labelloom.operators.extract import CONTACT, MAKING, MARKETING

SUFFIX = rf"(?i){V.whole([*V.COMPANY_ENDINGS, 'lid'])}"
STOP_LINE = rf"(?i)^\s*(?:{V.any_of(V.ADDRESS_ENDS)}|{CONTACT}|(?:e-?mail|website|www)\b)|{MARKETING}"
SKIPPED = r"(?i)^\(.*\)$|\bdivision\b"
FORMS = V.any_of(V.FORMS)
SERVING = rf"(?i){V.any_of(V.SERVING_CUES)}"
DOSE = rf"(?i){V.whole(V.DOSE_CUES)}"
BOILERPLATE = rf"(?i)^\s*(?:{MARKETING}|{MAKING}|{CONTACT}|{V.any_of([*V.SECTIONS, *V.ADDRESS_ENDS, *V.CLAIM_VERBS])}|exp|price|contains|facility|free\s+of|per\s+(?:gummy|serving)|net|nutrition)"
NEGATED = r"(?is)(?:free\s+of|without|contains\s+no)[^.]{0,250}$"
BACK = 250  # characters in front of a flavour that may negate it


WHITE = " \t\n\x0b\f\r"


def _stripped(c: Column, marks: str = WHITE) -> Column:
    return F.trim(c, F.lit(marks))


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: _stripped(x)), lambda x: x != "")


def _first(values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def _last_of(values: Column) -> Column:
    return F.get(values, F.size(values) - 1)


def _title(name: Column) -> Column:
    parts = F.regexp_extract_all(_stripped(name), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), "")


def cut_noise(value: Column, longest: int = 60) -> Column:
    """Cut at a noise character or an off-topic word; blank if too short, too long or if more than three in ten tokens
    are too short for a word and neither a number nor a token of names."""
    noise = "".join("\\" + c for c in V.NOISE)
    kept = F.regexp_extract(F.coalesce(value, F.lit("")), f"^[^{noise}]*", 0)
    topical = F.regexp_extract(kept, rf"(?is)^(.*?)(?:{V.whole(V.OFF_TOPIC)}|$)", 1)
    tidy = _stripped(F.regexp_replace(topical, r"(?i)\blid\.", "Ltd."), " ,;:-")

    def odd(token: Column) -> Column:
        bare = F.regexp_replace(token, "[^A-Za-z0-9]", "")
        known = F.regexp_replace(F.lower(token), "[.,]", "").isin(V.SHORT_TOKENS)
        return (bare == "") | ((F.length(bare) <= 2) & ~bare.rlike("^[0-9]+$") & ~known)

    def judged(v: Column) -> Column:
        tokens = F.filter(F.split(v, r"\s+"), lambda t: t != "")
        return F.when(F.length(v).between(3, longest) & (F.size(F.filter(tokens, odd)) <= 0.3 * F.size(tokens)), v).otherwise("")

    return let(tidy, judged)


def _marketed(lines: Column) -> Column:
    def of_line(line: Column, i: Column) -> Column:
        rest = cut_noise(F.regexp_replace(F.regexp_extract(line, f"(?i)(?:{MARKETING})(.*)", 1), "^[ :-]+", ""))
        below = F.get(lines, i + 1)
        above = F.slice(lines, F.greatest(i - 7, F.lit(1)), F.least(i, F.lit(8)))
        company = _last_of(F.filter(F.transform(F.filter(above, lambda x: x.rlike(SUFFIX)), lambda x: cut_noise(x)), lambda v: v != ""))
        other = F.when(below.rlike(r"(?i)^\s*(?:fssai|lic)"), company).otherwise(cut_noise(below))
        return F.when(line.rlike(f"(?i){MARKETING}"), F.coalesce(F.nullif(rest, F.lit("")), F.when(below.isNotNull(), other)))

    named = _first(F.transform(lines, of_line))
    sold_for = F.get(F.filter(lines, lambda x: x.rlike(r"(?i)^\s*for\s") & x.rlike(SUFFIX)), F.lit(0))
    return F.coalesce(named, F.when(sold_for.isNotNull(), cut_noise(F.regexp_extract(sold_for, r"(?i)^\s*for\s+(.*)$", 1))), F.lit(""))


def _company(lines: Column) -> Column:
    """As ``marketing_company``; most texts have no line that it looks for."""
    return F.when(F.exists(lines, lambda x: x.rlike(rf"(?i){MARKETING}|^\s*for\s")), _marketed(lines)).otherwise("")


def marketing_company(text: Column) -> Column:
    """The rest of a marketing line; a licence line there means the last company line before it; else the next line."""
    return let(text_lines(text), _company)


def _below(lines: Column, company: Column) -> Column:
    """Up to four lines after one with the company, until a line that begins something else: one fold over the lines."""
    strings = F.array().cast("array<string>")
    zero = F.struct(F.lit(False).alias("open"), strings.alias("out"), F.lit(None).cast("string").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        full = F.size(acc["out"]) == 4
        ends = acc["open"] & (full | line.rlike(STOP_LINE))
        found = F.coalesce(acc["found"], F.when(ends & (F.size(acc["out"]) > 0), F.array_join(acc["out"], ", ")))
        reads = acc["open"] & ~ends & ~line.rlike(SKIPPED)
        opens = (acc["open"] & ~ends) | F.contains(F.lower(line), F.lower(company))
        out = F.when(ends, strings).when(reads, F.concat(acc["out"], F.array(_stripped(line, " ,")))).otherwise(acc["out"])
        return F.when(acc["found"].isNotNull(), acc).otherwise(F.struct(opens.alias("open"), out.alias("out"), found.alias("found")))

    last = F.aggregate(lines, zero, step)
    return F.when(company != "", let(last, lambda x: F.coalesce(x["found"], F.array_join(x["out"], ", "))))


def address(text: Column, company: Column) -> Column:
    """A labelled address, a registered office, or up to four lines after the company, until a line that begins something else."""
    return let(text_lines(text), lambda lines: _address(lines, company))


def _address(lines: Column, company: Column) -> Column:

    def told(lines: Column, pattern: str) -> Column:
        return _first(F.transform(lines, lambda x: _stripped(F.regexp_extract(x, pattern, 1), " ,")))

    labelled = [told(lines, p) for p in (r"(?i)\baddress\s*:\s*(.+)$", r"(?i)\b(?:registered|regd\.?)\s+office\s*:?\s*(.+)$")]
    return F.regexp_replace(F.coalesce(*labelled, _below(lines, company), F.lit("")), r"([A-Za-z])-\s*(\d{6})\b", "$1 - $2")


def _counts(text: Column, pattern: str, joined: str, loose: str) -> Column:
    """All matches of a count with a form word that are neither a serving nor a dose: no serving cue stands in front of
    them on their line or anywhere on the line above, and no dose cue behind them on their line. ``joined``: what a line
    end between the count and its form word is matched by. ``loose``: what every match holds; lines without it are not
    looked at further."""
    rows = F.split(F.regexp_replace(text, joined, "$1 $2"), r"\r?\n")

    def part(lines: Column) -> Column:
        def of_line(line: Column, i: Column) -> Column:
            before = F.regexp_extract(line, rf"(?s)^(.*){DOSE}", 1)  # up to the last dose cue
            behind = F.when(line.rlike(DOSE), F.when(before.rlike(SERVING), "").otherwise(F.regexp_replace(line, rf"(?s)^.*{DOSE}", ""))).otherwise(line)
            above = (i > 0) & F.coalesce(F.get(lines, i - 1), F.lit("")).rlike(SERVING)
            return F.when(~line.rlike(loose) | above, none).otherwise(F.regexp_extract_all(F.regexp_extract(behind, rf"(?s)^(.*?)(?:{SERVING}|$)", 1), F.lit(pattern), F.lit(0)))

        return F.flatten(F.transform(lines, of_line))

    none = F.array().cast("array<string>")
    return F.when(text.rlike(loose), let(rows, part)).otherwise(none)


def package_size(text: Column) -> Column:
    """The pack's count and unit.

    A number with its form word comes first, unless the net content and servings times serving size agree on another
    number. A form word with its number behind it counts if the net content does not say otherwise. Net content is last.
    """
    return let(F.coalesce(text, F.lit("")), _package_size)


def _package_size(text: Column) -> Column:
    net = rf"(?i)net\s+(?:content|quantity|qty|wt|weight)s?\.?\s*:?\s*(\d{{1,4}})\s*({FORMS}|n(?:os?)?)\b"
    number = lambda pattern, group=1: F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))
    servings = number(r"(?i)serving\s+size\W*(\d{1,3})\b").cast("int") * number(r"(?i)(?:no\.?\s+of\s+)?servings?\W*per\s+(?:container|pack)\W*(\d{1,3})\b").cast("int")
    first, second = rf"(?i)(?<![\d.])\d{{1,4}}\s*{FORMS}\b", rf"(?i)\b{FORMS}\s+\d{{1,4}}(?![\d.])"
    digits = lambda c: F.regexp_extract(c, r"\d+", 0)
    unit = lambda c: F.regexp_extract(c, "[A-Za-z]+", 0)

    def of(net_: Column) -> Column:
        net_count, net_unit = net_["count"], net_["unit"]

        def badged(badge: Column) -> Column:
            agreed = F.coalesce((servings == net_count.cast("int")) & (servings != digits(badge).cast("int")), F.lit(False))
            return F.when(badge.isNotNull(), F.concat_ws(" ", F.when(agreed, net_count).otherwise(digits(badge)), unit(badge)))

        def listed(found: Column) -> Column:
            turned = F.get(F.filter(found, lambda m: net_count.isNull() | (digits(m) == net_count)), F.lit(0))
            return let(turned, lambda m: F.when(m.isNotNull(), F.concat_ws(" ", digits(m), unit(m))))

        badge = F.get(_counts(text, first, rf"(?i)(?<![\d.])(\d{{1,4}})\s*\n\s*({FORMS})\b", rf"(?i)\d\s*{FORMS}"), F.lit(0))
        others = _counts(text, second, rf"(?i)\b({FORMS})\s*\n\s*(\d{{1,4}})(?![\d.])", rf"(?i){FORMS}\s+\d")
        return F.coalesce(let(badge, badged), let(others, listed), F.when(net_count.isNotNull(), F.concat_ws(" ", net_count, net_unit)), F.lit(""))

    return let(F.struct(number(net).alias("count"), number(net, 2).alias("unit")), of)


_JOIN = r"(?:\s*,\s*|\s*[&+/]\s*|\s+(?i:and)\s+|-|[^\S\n]+)"
_NAMED = rf"\b([A-Z][A-Za-z]*(?:{_JOIN}[A-Z][A-Za-z]*){{0,3}})\s+(?i:flavou?r(?:ed)?)\b"
_CHEMICAL = rf"(?i)^[A-Za-z ]*\b{V.any_of(V.SALTS)}s?\s*,\s*"


def _named_flavour(text: Column) -> Column:
    """The name in front of "Flavour" on the shortest line."""

    def of(lines: Column) -> Column:
        def on_line(line: Column, i: Column) -> Column:
            def one(name: Column, at: Column) -> Column:
                back = F.concat(above(i), F.substring(line, F.lit(1), at))
                before = F.substring(back, F.greatest(F.length(back) - BACK + 1, F.lit(1)), F.lit(BACK))
                fine = ~before.rlike(NEGATED) & ~before.rlike(r"(?i)free\s+from\s+$") & ~F.lower(name).isin("natural", "artificial", "added", "no")
                return F.when(fine, F.struct(F.length(line).alias("n"), i.alias("i"), at.alias("at"), name.alias("name")))

            return F.when(line.rlike(_NAMED), F.zip_with(F.regexp_extract_all(line, F.lit(_NAMED), F.lit(1)), X.offsets(line, _NAMED), one))

        # the BACK characters in front of a line lie on the BACK lines above it, each with its line end
        above = lambda i: F.concat(F.array_join(F.slice(lines, F.greatest(i - BACK, F.lit(0)) + 1, F.least(i, F.lit(BACK))), "\n"), F.when(i > 0, "\n").otherwise(""))
        placed = F.transform(lines, lambda x, i: on_line(x, i))
        return F.array_min(F.array_compact(F.flatten(F.array_compact(placed))))["name"]

    return F.when(text.rlike("(?i)flavo") & text.rlike(_NAMED), let(F.split(text, "\n"), of))


def _known_flavour(text: Column, known: list[str]) -> Column:
    """Listed names in front of the ingredients, joined ones first."""
    names = "|".join(rf"\Q{k}\E" for k in sorted(known, key=lambda k: (-len(k), k)))

    def of(head: Column, pattern: str) -> Column:
        def one(name: Column, at: Column) -> Column:
            before = F.substring(head, F.greatest(at - BACK - 19, F.lit(1)), F.least(at, F.lit(BACK + 20)))
            behind = F.substring(head, at + F.length(name) + 1, F.lit(40))
            return F.when(~before.rlike(NEGATED) & ~behind.rlike("(?is)^.{0,20}flavouring"), name)

        return F.when(head.rlike(pattern), F.get(F.array_compact(F.zip_with(F.regexp_extract_all(head, F.lit(pattern), F.lit(0)), X.offsets(head, pattern), one)), F.lit(0)))

    patterns = (rf"(?i)(?<!\w)(?:{names})(?:\s*(?:,|&|\+|/|\band\b)\s*(?:{names}))+(?!\w)", rf"(?i)(?<!\w)(?:{names})(?!\w)")
    head = F.regexp_extract(text, r"(?is)^(.*?)(?:\bingredients?\b|$)", 1)
    return F.when(text.rlike(f"(?i){names}"), let(head, lambda head: F.when(head.rlike(f"(?i){names}"), F.coalesce(*[of(head, p) for p in patterns]))))


def flavour(text: Column, known: list[str]) -> Column:
    """"<Name> Flavour" on the shortest line, then "Flavour: <Name>", then known names, joined ones first, in front of
    the ingredients. Negated ones never count, and a chemical name in front of a comma is cut off. A name stands on one
    line, but for a line end behind a joining mark or in front of "Flavour"."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"([&+/,])[^\S\n]*\n\s*", "$1 ")
    joined = F.regexp_replace(joined, r"\s*\n\s*(?=(?i:flavou?r))", " ")

    def of(t: Column) -> Column:
        told = F.nullif(F.regexp_extract(t, r"(?i)\bflavou?r\s*+:\s*([A-Za-z]+(?:(?: & |[ -])[A-Za-z]+){0,3})", 1), F.lit(""))
        found = [F.regexp_replace(_named_flavour(t), _CHEMICAL, ""), told, *([_known_flavour(t, known)] if known else [])]
        return let(F.coalesce(*found), lambda name: F.coalesce(_title(name), F.lit("")))

    return let(joined, of)


def _once(run: Column) -> Column:
    """A list that is n times one shorter list, without regard to case, becomes that list."""
    low = F.transform(run, lambda x: F.lower(x))
    return let(low, lambda values: F.slice(run, F.lit(1), F.size(X.repeated_to_one(values))))


def title(text: Column) -> Column:
    """struct(brand, product) from the longest run of all-capital lines, of equal ones the first; a first line of a word
    or two is the brand."""
    return let(text_lines(text), _title_of)


def _title_of(lines_: Column) -> Column:

    def good(x: Column) -> Column:
        return F.length(x).between(2, 40) & x.rlike("[A-Z]{2}") & (x == F.upper(x)) & ~x.rlike(r"\d{3}|@|^\(.*\)$|:$") & ~x.rlike(BOILERPLATE)

    def runs(lines: Column) -> Column:
        cut = F.array_join(F.transform(lines, lambda x: F.when(good(x), x).otherwise("\u0001")), "\n")
        every = F.filter(F.transform(F.split(cut, "\u0001"), lambda r: F.filter(F.split(r, "\n"), lambda x: x != "")), lambda r: F.size(r) > 0)
        differing = lambda r: F.filter(r, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(r, F.greatest(i - 1, F.lit(0))))))
        return F.transform(F.transform(every, differing), _once)

    def split(best: Column) -> Column:
        head = F.get(best, F.lit(0))
        short = (F.size(best) > 1) & (F.size(F.split(head, r"\s+")) <= 2) & (F.length(head) <= 20) & ~head.rlike(rf"(?i)\b{FORMS}\b")
        brand = F.coalesce(F.when(short, head), F.lit(""))
        return F.struct(brand.alias("brand"), F.array_join(F.when(brand != "", F.slice(best, F.lit(2), F.size(best))).otherwise(best), " ").alias("product"))

    longest = F.aggregate(runs(lines_), F.array().cast("array<string>"), lambda acc, r: F.when(F.size(r) > F.size(acc), r).otherwise(acc))
    return let(longest, split)


def fallback_brand(text: Column) -> Column:
    """The first line of one to three capitalised words, if no boilerplate comes before."""
    return let(text_lines(text), _fallback_brand)


def _fallback_brand(lines: Column) -> Column:
    named = lambda x: x.rlike(r"^[A-Z][A-Za-z'&-]*(?: [A-Z][A-Za-z'&-]*){0,2}$") & (F.length(x) <= 30)
    first = F.get(F.filter(lines, lambda x: x.rlike(BOILERPLATE) | named(x)), F.lit(0))
    return let(first, lambda x: F.when(x.isNull() | x.rlike(BOILERPLATE), "").otherwise(x))


FIELDS = ["brand", "product", "flavour", "marketing_company", "address", "package_size"]


def label_fields(docs: DataFrame, key: str, text: str, flavours: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """(key, the nine fields of a label, claims) of every text, or those named in ``only``; a null text counts as empty,
    and what is not found is blank."""
    known, names = flavours or [], only or [*FIELDS, "fssai_number", "customer_care_email", "customer_care_number", "claims"]
    of_title, company, t, lines = F.col("__title"), F.col("__company"), F.col("__text"), F.col("__lines")
    found = docs.select(key, F.coalesce(text, F.lit("")).alias("__text"))
    if {"brand", "product", "marketing_company", "address"} & {*names}:
        found = found.withColumn("__lines", text_lines(t))
    if {"brand", "product"} & {*names}:
        found = found.withColumn("__title", _title_of(lines))
    if {"marketing_company", "address"} & {*names}:
        found = found.withColumn("__company", _company(lines))
    blank = F.lit("")
    fields = {
        "brand": lambda: F.when((of_title["brand"] != "") | (of_title["product"] != ""), of_title["brand"]).otherwise(_fallback_brand(lines)),
        "product": lambda: of_title["product"], "flavour": lambda: flavour(t, known), "marketing_company": lambda: company, "address": lambda: _address(lines, company), "package_size": lambda: package_size(t),
        "fssai_number": lambda: F.coalesce(X.licence(t), blank), "customer_care_email": lambda: F.coalesce(X.email(t), blank), "customer_care_number": lambda: F.coalesce(X.care_number(t), blank),
        "claims": lambda: F.coalesce(X.generic_claims(t), F.array().cast("array<string>")),
    }
    return found.select(key, *[fields[n]().alias(n) for n in names])
