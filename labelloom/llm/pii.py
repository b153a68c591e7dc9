"""Personal data by weak supervision.

Patterns propose candidate spans. Labelers vote on each: the strict pattern with its checksum (regex), lists of
endings, calling codes and issuers (gazetteer), cue words in front (context), and the span's surroundings (shape).
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for each kind. Its
posteriors label all candidates, and a naive Bayes span classifier trained on them decides which loose spans are
added; strict ones always stay. Everything that meets a text runs as column expressions; what reaches the driver are
counts of vote patterns and feature values, whose number does not depend on the corpus.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import cut, text_or_empty
from labelloom.llm.spans import SPAN, apart, find_spans, joined, none, of_kind

KINDS = ["email", "ip", "card", "phone", "id", "name", "address"]

# What the gazetteer labeler and the patterns of names and addresses look for.
ENDINGS = """
    com org net edu gov mil int info biz io app dev me tv co ai name pro mobi
    ar at au be bg br ca ch cl cn cy cz de dk ee es eu fi fr gr hk hr hu id ie il in is it jp kr li lt lu lv mt mx my nl no
    nz pe ph pk pl pt ro rs ru se sg si sk th tr tw ua uk us vn za
""".split()
CALLING_CODES = """
    1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91
    92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 356 357 358 359 370 371 372 380 381 385 386 420 421 852 880 886 966
    971 972
""".split()
ACCOUNT_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO RS SA SE SI SK SM TR".split()
GIVEN_NAMES = """
    Aaron Adam Alan Albert Alejandro Alexander Alice Amanda Amy Ana Andrea Andrew Angela Anna Anne Anthony Antonio Ashley
    Barbara Benjamin Betty Brandon Brenda Brian Carlos Carmen Carol Catherine Charles Charlotte Christian Christine
    Christopher Claire Claudia Daniel David Deborah Dennis Diana Donald Donna Dorothy Edward Elena Elizabeth Emily Emma Eric
    Eva Fatima Francisco Frank Gabriel Gary George Gloria Grace Gregory Hannah Hans Heather Helen Henry Isabel Jack Jacob
    James Jane Janet Jason Javier Jean Jeffrey Jennifer Jessica Johan John Jonathan Jorge Jose Joseph Joshua Juan Juergen
    Julia Julie Karen Katherine Kathleen Kevin Klaus Laura Lars Linda Lisa Louise Lucia Luis Manuel Marco Margaret Maria
    Marie Mark Martin Mary Matthew Melissa Michael Michelle Miguel Mohammed Nancy Nathan Nicholas Nicole Olivia Pablo Pamela
    Patricia Patrick Paul Pedro Peter Philip Pierre Priya Rachel Rafael Raymond Rebecca Richard Robert Roger Rosa Ruth Ryan
    Samuel Sandra Sarah Scott Sofia Sophie Stefan Stephanie Stephen Steven Susan Teresa Thomas Timothy Ursula Victoria
    Vincent Walter William Wolfgang
""".split()
TITLES = "Mr Mrs Ms Miss Dr Prof Professor Herr Frau Monsieur Madame Señor Señora".split()
STREETS = "Street Avenue Road Lane Boulevard Drive Court Square Terrace Place Parkway Highway Crescent Way".split()
NO_STREETS = "The This That These Those A An In On At And Or Of For".split()  # capital words that begin no street name
SHORT_STREETS = "St Ave Rd Ln Blvd Dr Ct Sq Pl Pkwy Hwy".split()

# Possessive repeats and look-behinds find the same leftmost matches as the plain patterns, in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_FRONT = r"(?=\p{Lu})(?<![\p{L}\p{N}'’-])"
_SURNAME = r"\p{Lu}[\p{L}'’]*\p{Ll}(?:-\p{Lu}\p{Ll}+)?"
_HOUSE = r"[0-9]{1,5}[A-Za-z]?"
LOOSE = [
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9A-Za-z-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z+(-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])",
    rf"{_FRONT}(?:(?:{'|'.join(TITLES)})\.?\x20(?:\p{{Lu}}[\p{{L}}.]*\x20){{0,2}}|(?:{'|'.join(GIVEN_NAMES)})\x20(?:\p{{Lu}}\.?\x20)?){_SURNAME}(?![\p{{L}}\p{{N}}])",
    rf"(?<![\p{{L}}\p{{N}}.,-])(?:{_HOUSE}\x20(?!(?:{'|'.join(NO_STREETS)})\x20)(?:\p{{Lu}}[\p{{L}}'’.-]*\x20){{1,4}}?(?:{'|'.join([*STREETS, *SHORT_STREETS])})(?![\p{{L}}\p{{N}}])"
    rf"|\p{{Lu}}\p{{Ll}}+(?:straße|strasse|gasse|allee|platz|weg)\x20{_HOUSE}(?![\p{{L}}\p{{N}}])"
    rf"|(?:Calle|Avenida|Plaza|Paseo)(?:\x20\p{{L}}+){{1,4}}?,?\x20{_HOUSE}(?![\p{{L}}\p{{N}}])"
    rf"|{_HOUSE},?\x20(?:rue|avenue|boulevard|place|quai)(?:\x20(?:de|du|des|la|le|les|\p{{Lu}}[\p{{L}}'’-]*)){{1,5}}(?![\p{{L}}\p{{N}}]))",
]

# What the gazetteer and context labelers look for, by kind.
GAZETTEER = [
    rf"(?i)(?:^|[^a-z])(?:{'|'.join(ENDINGS)})$",
    r"^(?:2001|2[0-9a-f]{3}|fe80|fd|[1-9]|1[0-9]{2}|2[0-1][0-9]|22[0-3])",
    r"^[3-6]",
    rf"^\+(?:{'|'.join(CALLING_CODES)})|^\(?[2-9][0-9]{{2}}",
    rf"^(?:[0-8][0-9]{{2}}-|{'|'.join(ACCOUNT_COUNTRIES)})",
    rf"{_FRONT}(?:{'|'.join(GIVEN_NAMES)})(?=\p{{Lu}})|^(?:{'|'.join(TITLES)})\.?\p{{Lu}}",
    rf"(?:{'|'.join(STREETS)})$|(?:straße|strasse|gasse|allee|platz|weg)[0-9]+[A-Za-z]?$|^(?:Calle|Avenida|Plaza|Paseo)|^[0-9]+[A-Za-z]?,?(?:rue|avenue|boulevard|place|quai)",
]
CUES = [
    r"(?i)(?:mail|contact|write|reach|courriel|correo|kontakt)\W*(?:\w+\W+){0,2}$",
    r"(?i)(?:\bip\b|host|server|address|addr|client)\W*(?:\w+\W+){0,2}$",
    r"(?i)(?:card|visa|master|credit|carte|karte|tarjeta|pay)\W*(?:\w+\W+){0,2}$",
    r"(?i)(?:call|phone|tel|fax|mobile|cell|whatsapp|telefon|teléfono|téléphone)\W*(?:\w+\W+){0,2}$",
    r"(?i)(?:ssn|social security|iban|account|konto|compte|cuenta)\W*(?:\w+\W+){0,2}$",
    r"(?i)(?:name|dear|signed|regards|patient|client|customer|contact|mail|call|born|meet|heiße|liebe|appelle|llamo)\W*(?:\w+\W+){0,1}$",
    r"(?i)(?:address|adresse|anschrift|dirección|live|lives|living|reside|resides|wohn|wohnt|ship|deliver|home|at|habite)\W*(?:\w+\W+){0,2}$",
]
AGAINST = r"(?i)(?:order|invoice|version|isbn|part|ref|serial|page|figure|section)\W*(?:\w+\W+){0,1}$"

LABELERS = ["regex", "gazetteer", "context", "shape"]
ROUNDS = 25
SURE = 0.95
HASHED_WORDS = 64
SMOOTHING = 5.0


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def card_ok(m: Column) -> Column:
    number = digits(m)
    return F.when(F.length(number).between(14, 19), luhn(number)).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """The strict spans: parts of an address at most 255, cards by length and Luhn, phones of 10 to 15 digits."""
    email = F.when(F.contains(text, F.lit("@")), find_spans(text, EMAIL, 0)).otherwise(none())
    ip = F.filter(find_spans(text, IP, 1), lambda x: x["m"].rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"))
    card = F.filter(find_spans(text, CARD, 2), lambda x: card_ok(x["m"]))
    phone = F.when(F.contains(text, F.lit("+")), F.filter(find_spans(text, PHONE, 3), lambda x: F.length(digits(x["m"])).between(10, 15))).otherwise(none())
    return F.concat(email, ip, card, phone)


def loose_spans(text: Column) -> Column:
    """Candidates that the strict patterns miss: spelt-out addresses, long-form hosts, cards with a wrong digit,
    national phone numbers, identity or account numbers, names with a title or a listed given name, and street
    addresses with a house number."""
    return F.concat(*(find_spans(text, pattern, k) for k, pattern in enumerate(LOOSE)))


def _by_kind(span: Column, patterns: list[str], value: Column) -> Column:
    chain = F.lit(False)
    for k, pattern in enumerate(patterns):
        chain = F.when(span["k"] == k, value.rlike(pattern)).otherwise(chain)
    return chain


def labelled(span: Column, strict: bool) -> Column:
    """struct(s, k, e, votes, features) of a span. A vote is +, - or 0."""
    m, before = span["m"], span["before"]
    vote = lambda yes, no: F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))
    tidy = F.regexp_replace(m, r"\s", "")
    listed = _by_kind(span, GAZETTEER, tidy)
    checked = F.when(span["k"] == 2, card_ok(m)).when(span["k"] == 0, tidy.rlike(r"(?i)(?:\.|dot[\])])[a-z]{2,}$")).otherwise(F.lit(True))
    repeated = m.rlike(r"^(?:\D*([0-9]))(?:\D*\1)+\D*$")
    votes = F.concat(vote(F.lit(strict) | checked, ~checked), vote(listed, ~listed), vote(_by_kind(span, CUES, before), before.rlike(AGAINST)), vote(F.lit(False), repeated | before.rlike("[0-9A-Za-z]$")))
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)\P{L}*$", 1))
    features = F.array(
        F.concat(F.lit("word:"), F.pmod(F.xxhash64(word), F.lit(HASHED_WORDS)).cast("string")),
        F.concat(F.lit("length:"), F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits:"), F.least(F.length(digits(m)), F.lit(20)).cast("string")),
        F.concat(F.lit("front:"), F.when(before == "", "none").when(before.rlike(r"\s$"), "space").when(before.rlike(r"\w$"), "word").otherwise("sign")),
        F.concat(F.lit("votes:"), votes),
    )
    return F.struct(span["s"].alias("s"), span["k"].alias("k"), span["e"].alias("e"), votes.alias("votes"), features.alias("features"))


def em(counts: dict[tuple[int, str], int], rounds: int = ROUNDS) -> dict[tuple[int, str], float]:
    """Posterior that a span is personal data for each (kind, votes), by expectation-maximisation.

    Each kind has a prior, each labeler and kind a table P(vote | truth); labelers are independent given the truth.
    The start is the balance of the votes.
    """
    posterior = {key: 1 / (1 + math.exp(-1.5 * (key[1].count("+") - key[1].count("-")))) for key in counts}
    for _ in range(rounds):
        prior: dict = defaultdict(lambda: [1.0, 1.0])
        table: dict = defaultdict(lambda: [0.5, 0.5])
        for (kind, votes), n in counts.items():
            p = posterior[kind, votes]
            for truth, weight in ((1, n * p), (0, n * (1 - p))):
                prior[kind][truth] += weight
                for i, v in enumerate(votes):
                    table[kind, i, v][truth] += weight
        for kind, votes in counts:
            log = [0.0, 0.0]
            for truth in (0, 1):
                log[truth] = math.log(prior[kind][truth] / sum(prior[kind]))
                for i, v in enumerate(votes):
                    log[truth] += math.log(table[kind, i, v][truth] / sum(table[kind, i, o][truth] for o in "+-0"))
            posterior[kind, votes] = 1 / (1 + math.exp(max(-500, min(500, log[0] - log[1]))))
    return posterior


def _lookup(values: dict[str, float]) -> Column:
    return F.transform_values(F.str_to_map(F.lit(";".join(f"{k}={v:.6g}" for k, v in values.items()) or "none=0"), F.lit(";"), F.lit("=")), lambda _, v: v.cast("double"))


def train(spans: DataFrame) -> dict[str, float]:
    """Weights (log-odds) of 'kind' and 'kind|feature' for the span classifier, from rows (span) of all candidates."""
    counts = {(r["k"], r["votes"]): r["n"] for r in spans.groupBy("span.k", "span.votes").agg(F.count("*").alias("n")).collect()}
    posterior = _lookup({f"{k}|{v}": p for (k, v), p in em(counts).items()})
    truth = F.coalesce(F.element_at(posterior, F.concat_ws("|", "span.k", "span.votes")), F.lit(0.0))
    weighed = spans.select("span.k", "span.features", truth.alias("p"))
    each = weighed.select("k", "p", F.explode(F.concat(F.array(F.lit("")), F.col("features"))).alias("feature"))
    rows = each.groupBy("k", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = {r["k"]: (r["yes"] + 1, r["no"] + 1) for r in rows if r["feature"] == ""}
    weights = {str(k): math.log(yes / no) for k, (yes, no) in total.items()}
    for r in rows:
        if r["feature"]:
            yes, no = total[r["k"]]
            common = SMOOTHING * (r["yes"] + r["no"]) / (yes + no)  # a rare feature says little, whichever class is larger
            weights[f"{r['k']}|{r['feature']}"] = math.log((r["yes"] + common) / (yes + SMOOTHING)) - math.log((r["no"] + common) / (no + SMOOTHING))
    return weights


def personal_spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id (and columns ``keep``), base and added: the strict spans and those that the classifier adds.

    A null or empty text has none; a null doc_id is kept; repeated rows stay; an empty table gives an empty result;
    columns not kept are ignored. Texts are searched whole.
    """
    columns, text = ["doc_id", *(keep or [])], text_or_empty()
    plain = docs.select(*columns, base_spans(text).alias("base"), loose_spans(text).alias("loose"))
    fresh = apart(F.col("loose"), F.col("base"))
    found = cut(plain.select(*columns, "base", F.concat(F.transform("base", lambda x: labelled(x, True)), F.transform(fresh, lambda x: labelled(x, False))).alias("candidates"), F.size("base").alias("strict")), "personal")
    weights = train(found.select(F.explode("candidates").alias("span")))
    table = _lookup(weights)
    weight = lambda key: F.coalesce(F.element_at(table, key), F.lit(0.0))
    score = lambda x: F.aggregate(x["features"], weight(x["k"].cast("string")), lambda acc, f: acc + weight(F.concat_ws("|", x["k"], f)))
    loose = F.slice("candidates", F.col("strict") + 1, F.greatest(F.size("candidates") - F.col("strict"), F.lit(0)))
    added = F.filter(loose, lambda x: score(x) >= math.log(SURE / (1 - SURE)))
    spans = F.transform(added, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.lit("").alias("m"), F.lit("").alias("before"))).cast(f"array<{SPAN}>")
    return found.select(*columns, "base", spans.alias("added"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans of every document; see ``personal_spans``."""
    found = personal_spans(docs)
    counts = [of_kind(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"), (F.size("base") + F.size("added")).cast("long").alias("n_spans"))
