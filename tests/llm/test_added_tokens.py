import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from crawlsight.llm.queries import op3_harmonic_packing, tokenizer_path
from crawlsight.llm.tokens import encoder
from tests.llm.data import frame

TEXT = "a<|endoftext|>b"


def test_ids_are_the_librarys():
    plain = Tokenizer.from_file(tokenizer_path())
    encode = encoder(tokenizer_path(), True)
    assert encode.ids(TEXT).tolist() == [64, 50256, 65] and encode.fast is not None
    for text in ["", "a b", "<|endoftext|>", "x <|endoftext|> y\n", "<|endoftext", "漢<|endoftext|>"]:
        assert encode.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("query", ["op3", "pipeline"])
def test_packed(spark, tmp_path, query):
    docs = frame(spark, [(1, TEXT, "en", "s", 15)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = op3_harmonic_packing(spark, str(tmp_path)) if query == "op3" else corpus_pipeline.packed(spark, docs, "")
    ids = np.array([64, 50256, 65, 0], dtype="<u4")
    pieces = sorted(got.collect(), key=lambda r: r.start)
    assert {r.doc_tokens for r in pieces} == {4} and [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces]
