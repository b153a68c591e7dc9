import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from labelloom.llm.queries import op1_packing
from tests.llm import brute

MARK = "<|endoftext|>"
TEXTS = [f"{MARK} is text", f"one {MARK} two", f"{MARK}{MARK}", f"ends with {MARK}", f"spaces  {MARK}  around\n", "<|endoftext| > is none", "plain", f"été {MARK} 𝕏 " * 700]


@pytest.mark.parametrize("query", ["op1", "pipeline"])
def test_ids_of_the_tokenizers_file(spark, tmp_path, query):
    """Without any setting of the tokenizer: strings of added tokens get their own ids."""
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = (op1_packing(spark, str(tmp_path)) if query == "op1" else corpus_pipeline.packed(spark, docs, "")).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [e.ids + [1] for e in plain.encode_batch(TEXTS, add_special_tokens=False)]
    assert any(50256 in x for x in ids)
    want = {(d, s, len(i[s : s + 2048]), brute.crc(i[s : s + 2048]), len(i)) for d, i in enumerate(ids) for s in range(0, len(i), 2048)}
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows} == want
