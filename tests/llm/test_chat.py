from collections import defaultdict

from labelloom.llm import chat


def test_rotation_by_hand(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "yo 𝕏"), (1, 70, "ann", "end"), (1, 70, "ann", "end"), (2, None, None, None), (None, 3, "bob", "x"), (1, 64, "cy", "")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk int, perspective string").repartition(3)
    got = defaultdict(list)
    for r in sorted(chat.rotated(table).collect(), key=lambda r: (r["offset"],)):
        key = r["conv_id"], r["perspective"]
        assert r["offset"] == sum(len(x["text"]) for x in got[key])
        got[key].append(r)
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "bob")}
    for (conv, who), chunks in got.items():
        own = sorted(((t, r or "unknown", x or "") for c, t, r, x in rows if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        want, masked = "", []
        for _, r, x in own:
            want += f"<|{'assistant' if r == who else 'user name=' + r}|>\n{x}\n"
            masked += [x + "\n"] * (r == who)
        assert "".join(c["text"] for c in chunks) == want
        assert [c["text"][a:b] for c in chunks for a, b in c["mask"]] == masked
    assert len(got[1, "ann"]) == 1


def test_one_turn_number_for_a_whole_conversation(spark):
    rows = [(5, turn, f"r{i % 2}", f"text {i}") for turn in (None, 3) for i in range(300)]
    got = sorted((r["perspective"], r["chunk"], r["n_turns"], r["offset"], len(r["text"])) for r in chat.rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert [x[2] for x in got] == ([64] * 9 + [24]) * 2
    for who in (got[:10], got[10:]):
        assert [x[3] for x in who] == [sum(y[4] for y in who[:i]) for i in range(10)]


def test_offsets_over_many_blocks(spark):
    rows = [(k, c, (c * 7) % 5) for k in ("a", "b") for c in range(50)]
    table = spark.createDataFrame(rows, "k string, chunk long, length long")
    got = {(r["k"], r["chunk"]): r["offset"] for r in chat._offsets(table, ["k"], block=4).collect()}
    assert got == {(k, c): sum(x for j, d, x in rows if j == k and d < c) for k, c, _ in rows}


def test_empty(spark):
    assert chat.rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
