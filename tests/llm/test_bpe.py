import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from touchline.llm import bpe


@pytest.fixture(scope="module")
def library():
    out = Tokenizer.from_file(str(bpe.default_vocabulary()))
    out.no_truncation()
    out.no_padding()
    return out


def texts():
    r = random.Random(3)
    chars = "abcdefghij  \n\t.,'-ÄÖß éñΣσςİıǅ漢字🙂‍́ 　\x1f\x00'sTMth12"
    out = ["".join(r.choice(chars) for _ in range(r.randrange(1, 60))) for _ in range(500)]
    return out + ["", None, " \n", "Hello, World!", "<|startoftext|>hi<|endoftext|> there", "I'll we've DON'T", "a" * 3000, "ab " * 20_000, "ﬁ Å Å"]


def test_as_the_library(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BYTES", 2000)
    all_texts = texts()
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id int, text string")
    got = {r.doc_id: r for r in bpe.digest(bpe.round_trip(docs)).collect()}
    for i, text in enumerate(all_texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), text
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), text
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text


def test_whole_table_as_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids for r in docs.collect()}
    assert bpe.round_trip(docs).orderBy("doc_id").collect() == bpe.decode(bpe.encode(docs)).orderBy("doc_id").collect()
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == want[r.doc_id]
        assert r.text == library.decode(want[r.doc_id], skip_special_tokens=False)


def test_decode_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, ids binary")
    assert [r.text for r in bpe.decode(rows).collect()] == ["", ""]
