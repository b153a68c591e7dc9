import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from labelloom.llm import sentence_pieces as S


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_are_those_of_the_library(library, monkeypatch):
    rng = random.Random(1)
    texts = ["", " ", "  ", "   a", "x   a  ", "① ▁a", "a" * 700, "ab" * 300, "\t\n x", "東京都に行った " * 5, "𝕏 nbsp x", "<s> </s> <0x00> <unk>", "▁" * 40]
    texts += ["".join(rng.choice("abcdethr nio s") for _ in range(300)) for _ in range(100)]
    texts += ["".join(rng.choice("inthearo") for _ in range(300)) for _ in range(60)]
    encoder = S.Encoder()
    monkeypatch.setattr(S, "CHUNK_CHARS", 5000)
    got = encoder.encode(texts)
    assert [g.tolist() for g in got] == library.encode(texts, num_threads=1)
    assert [encoder.decode(g) for g in got] == [t.replace("▁", " ") for t in texts]
    assert [g.tolist() for g in encoder.encode(texts[::-1])] == [g.tolist() for g in got[::-1]]


def test_pieces_at_the_very_end(library):
    encoder = S.Encoder()
    for last in ("the", "in", "en", "then", "ation", "a", "ſ"):
        for words in (["then", "into", last], ["enter", "the", "ationx", last]):
            ids, counts = encoder.words(words)
            assert ids.tolist() == [i for w in words for i in library.encode(w)] and counts.tolist() == [len(library.encode(w)) for w in words]


def test_table(docs, library):
    rows = S.encoded(docs).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=key) == sorted(((d, library.encode(t)) for d, t in texts), key=key)
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)


def test_suffix_array():
    codes = np.array([ord(c) for c in "banana$band"])
    order = S.suffix_array(codes, 16)
    text = "banana$band"
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))


def test_empty(empty):
    assert S.encoded(empty).count() == 0
