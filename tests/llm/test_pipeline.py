"""The pipeline against its stages followed by hand on the smallest tables."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from labelloom.llm import language_id, secrets
from tests.llm import brute
from tests.llm.test_near_texts import brute as all_pairs
from tests.llm.test_near_texts import groups


@pytest.fixture(scope="module")
def stages(spark, docs):
    """Rows after every stage, started from the table with edge cases."""
    import tempfile

    out, now = [], docs
    folder = tempfile.mkdtemp(prefix="spark-")
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, now, "").write.parquet(f"{folder}/{i}")
        now = spark.read.parquet(f"{folder}/{i}")
        out.append(now)
    return out


def rows(df):
    return [tuple(r) for r in df.select(*P.COLUMNS).collect()]


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "secret scan", "packing"]
    assert all(s.columns == P.COLUMNS for s in stages[:-1])


def test_language(docs, stages):
    model = language_id.trained(docs)
    named = language_id.identify(docs, model, ["text", "lang", "source", "n_chars"]).collect()
    want = Counter((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in named if r["lang_pred"] != "und" and r["score"] >= model.floor)
    assert Counter(rows(stages[0])) == want and len(want) > 150
    kept = {r[1] for r in rows(stages[0])}
    assert all(len(t or "") < 40 for t in {r["text"] for r in docs.where("source <> 'edge'").collect()} - kept)


def test_one_of_each_group(stages):
    """Exactly one row of each component stays, one with its smallest id."""
    before, kept = rows(stages[0]), rows(stages[1])
    smallest = all_pairs([(r[0], r[1]) for r in before])
    assert len(kept) == len(groups([(r[0], r[1]) for r in before]))
    assert Counter(r[0] for r in kept) == Counter(min((d for d in g if d is not None), default=None) for g in groups([(r[0], r[1]) for r in before]).values())
    assert {*kept} <= {r for r, least in zip(before, smallest) if r[0] == least}


def test_copies_under_null_and_repeated_ids_go(spark):
    text, other = " ".join(f"t{i}" for i in range(60)), " ".join(f"o{i}" for i in range(60))
    given = [(5, text), (None, text), (None, other), (None, other), (7, text + " end"), (5, other + " end"), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", f"s{i}", 1) for i, (d, t) in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r["doc_id"], (r["text"] or "")[:2]) for r in P.one_of_each_group(spark, docs, "").collect()), key=str)
    assert kept == [(5, "o0"), (5, "t0"), (None, "")]


def test_without_repeats(stages):
    before = rows(stages[1])
    want = brute.substring([(r[0], r[1]) for r in before])
    got = {(r[0], r[2], r[3]): r for r in rows(stages[2])}
    for d, t, lang, source, n in before:
        words, removed, sha = want[d, t]
        if removed == words and words:
            assert (d, lang, source) not in got
        elif not removed:
            assert got[d, lang, source] == (d, t, lang, source, len(t))
        else:
            text = got[d, lang, source][1]
            assert brute.hashlib.sha256(text.encode()).hexdigest() == sha and got[d, lang, source][4] == len(text)


def test_without_secrets(stages):
    before, after = {(r[0], r[2], r[3]): r for r in rows(stages[2])}, rows(stages[3])
    assert len(before) == len(after)
    added = {r["doc_id"]: [(x["s"], x["e"]) for x in r["added"]] for r in secrets.secret_spans(stages[2]).collect()}
    for d, t, lang, source, n in after:
        old = before[d, lang, source][1]
        spans = sorted([tuple(map(int, s.split(":")[1:])) for s in brute.spans_of(old, brute.SECRETS)] + added[d])
        at, out = 0, ""
        for a, b in spans:
            if a >= at:
                out += old[at:a] + "[secret]"
            at = max(at, b)
        assert t == out + old[at:] and n == len(t)


def test_packed(stages):
    docs = rows(stages[3])
    ids = brute.token_ids([r[1] for r in docs])
    want = Counter((r[0], s, len(i[s : s + 2048]), brute.crc(i[s : s + 2048]), len(i)) for r, i in zip(docs, ids) for s in range(0, len(i), 2048))
    got = stages[4].collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    used = defaultdict(int)
    for r in got:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 100
