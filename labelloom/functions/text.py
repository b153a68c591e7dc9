"""Column expressions on text that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.arrays import let

# Connectors and units, which never make two values alike.
STOP_WORDS = ["free", "with", "and", "the", "for", "of", "a", "an", "to", "in", "on", "g", "mg", "mcg", "kg", "ml", "l", "kcal", "cal", "iu", "oz", "lb"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: str | Column) -> Column:
    """Absent: null, empty or white space alone (a no-break space included)."""
    return F.coalesce(F.trim(F.translate(col(c), " ", " ")) == "", F.lit(True))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def or_dash(c: str | Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("—"))


def folded(c: str | Column) -> Column:
    return F.lower(F.trim(col(c)))


def comparable(c: str | Column) -> Column:
    """Trimmed, lower case, single spaces, without closing punctuation."""
    spaced = F.regexp_replace(F.translate(F.coalesce(col(c), F.lit("")), " ", " "), r"\s+", " ")
    return F.regexp_replace(F.lower(F.trim(spaced)), r"[.,;:]+$", "")


def words_that_count(form: Column) -> Column:
    """Distinct words of a comparable form without stop words."""
    return F.array_except(F.split(form, " "), F.array(*map(F.lit, ["", *STOP_WORDS])))


def meaningful(c: str | Column) -> Column:
    """Distinct words of a value's comparable form without stop words."""
    return words_that_count(comparable(c))


def shared_words(x: Column, y: Column) -> Column:
    """Shared words of two comparable forms over the larger word count; 0 if either side has none."""
    share = lambda s: F.size(F.array_intersect(s["x"], s["y"])) / F.greatest(F.size(s["x"]), F.size(s["y"]))
    both = F.struct(words_that_count(x).alias("x"), words_that_count(y).alias("y"))
    return let(both, lambda s: F.when((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0), 0.0).otherwise(share(s)))


def overlap(a: Column, b: Column) -> Column:
    """Shared words of two values over the larger word count; 0 if either side has none."""
    return shared_words(comparable(a), comparable(b))


def edit_share(a: Column, b: Column) -> Column:
    """Edit distance over the longer length of the comparable forms."""
    x, y = comparable(a), comparable(b)
    return F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))


def alnum_tokens(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    x, y = alnum_tokens(a), alnum_tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(c: str | Column) -> Column:
    """Lower case, then a capital at each word start, after hyphens and apostrophes too."""
    words = F.regexp_extract_all(F.lower(col(c)), F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def version_number(c: str | Column) -> Column:
    """First run of digits; null without one, or where it is no version number (beyond an int)."""
    return F.nullif(F.regexp_extract(col(c), r"(\d+)", 1), F.lit("")).try_cast("int")


def score_value(c: str | Column) -> Column:
    """A value as the scorer compares it."""
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), r"\s+", " ")
    x = F.regexp_replace(x, r"(\d),(\d)", "$1.$2")
    x = F.regexp_replace(F.regexp_replace(x, "[µμ]g", "mcg"), r"(\d)\s+(mcg|mg|g|kcal|kj|ml|iu|%)", "$1$2")
    x = F.regexp_replace(F.regexp_replace(x, r"\s*\([^()]*\)$", ""), r"\s*%\s*(rda)?$", "")
    return F.trim(F.regexp_replace(x, r"[.,;:]+$", ""))


def key_tokens(c: str | Column) -> Column:
    """A nutrient name as an order-free set of words."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\([^()]*\)", " "), "[,:]", " ")
    return F.array_sort(F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: w != "")))


def presentable_date(c: str | Column, with_time: bool = False) -> Column:
    """DD-MM-YYYY of an ISO text, a dash for blank, anything else unchanged; times are as written (UTC)."""
    pattern = r"^(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}:\d{2}).*)?$"
    shown = F.regexp_replace(col(c), pattern, "$3-$2-$1 $4" if with_time else "$3-$2-$1")
    return F.when(blank(c), F.lit("—")).otherwise(F.trim(shown))
