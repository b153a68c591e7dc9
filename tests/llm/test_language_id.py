import numpy as np

from labelloom.llm import language_id as L


def test_held_out_accuracy_and_whole_texts(docs):
    model = L.trained(docs)
    rows = L.identify(docs, model, ["lang", "text", "source"]).withColumn("held_out", L.held_out()).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"] and r["source"] != "edge" and len(r["text"]) > 30 and r["lang_pred"] != "und"]
    assert len(held) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and 0 <= r["score"] <= 1


def test_training_sees_no_held_out_row(spark, docs):
    other = docs.withColumn("lang", L.F.when(L.held_out(), L.F.lit("xx")).otherwise(L.F.col("lang")))
    a, b = L.trained(docs), L.trained(other)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_counts_by_hand(monkeypatch):
    text = " .Ab, ß🙂c" * 50
    points = np.concatenate(list(L.letter_blocks(text)))
    assert "".join(map(chr, points)) == " ab ß c" * 50 + " "
    whole = L.counts(text)
    assert whole.sum() == 3 * len(points) - 3
    for chunk in (1, 2, 3, 7):
        monkeypatch.setattr(L, "CHUNK", chunk)
        assert np.array_equal(L.counts(text), whole)
    assert not L.counts(" 12 \n" * 9).any() and not list(L.letter_blocks(""))


def test_nothing_to_learn_from(spark, empty, docs):
    assert L.identify(docs, L.trained(empty)).where("lang_pred <> 'und'").count() == 0
    assert L.identify(empty, L.trained(docs)).count() == 0


def test_penalties_and_temperature():
    rng = np.random.default_rng(0)
    x = rng.random((400, 30))
    y = (x[:, 0] > x[:, 1]).astype(int)
    w = L.ftrl(lambda r: x[r], y, 30, 2, 20)
    assert np.mean((x @ w).argmax(1) == y) > 0.9
    assert 0.02 <= L.temperature(x @ w * 100, rng.integers(0, 2, 400)) <= 5


def test_a_text_as_long_as_many_blocks(spark, docs):
    model = L.trained(docs)
    text = next(r["text"] for r in docs.where("lang = 'de'").collect() if len(r["text"] or "") > 500)
    many = spark.createDataFrame([(1, text * (4_000_000 // len(text)), "x"), (2, "7 " * 2_000_000, "y")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in L.identify(many, model).collect()}
    assert got[1]["lang_pred"] == "de" and got[2]["lang_pred"] == "und" and got[2]["score"] == 0


def test_the_floor_is_above_a_toss_up(docs):
    model = L.trained(docs)
    assert 1 / len(model.languages) < model.floor < 0.6


def test_the_penalty_leaves_few_weights(docs):
    train = docs.where(L.F.col("lang").isNotNull() & ~L.held_out())
    dense, sparse = (np.mean(L.fit(train, l1=l1).weights != 0) for l1 in (0.0, L.L1))
    assert 0 < sparse < dense / 2


def test_many_label_values(spark, docs):
    """The most frequent values are learned, ties by name; the rows of all count for the document frequencies."""
    train = docs.where(L.F.col("lang").isNotNull() & ~L.held_out())
    ids = L.F.col("doc_id").cast("string")
    dirty = train.withColumn("lang", L.F.when(L.F.crc32(ids) % 2 == 0, L.F.concat(L.F.lit("zz"), ids)).otherwise(L.F.col("lang")))
    usual = sorted(r["lang"] for r in dirty.where("lang NOT LIKE 'zz%'").select("lang").distinct().collect())
    a, b = L.fit(dirty, max_languages=len(usual)), L.fit(train)
    assert a.languages == usual and np.array_equal(a.idf, b.idf)
    assert len(L.fit(dirty, max_languages=len(usual) + 1).languages) == len(usual) + 1
