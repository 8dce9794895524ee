"""The stages of the pipeline one after another, each against a plain form on the rows that its predecessor kept."""

import hashlib
import random

import numpy as np
import pytest
from test_ngram_join import brute
from test_pii import base
from tokenizers import Tokenizer

import corpus_pipeline as P
from touchline.llm import bpe, pii
from touchline.llm.base import stage, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    docs, out = table(spark, FOLDER, "documents"), []
    out.append(docs)
    for name, step in P.STAGES:
        docs = stage(step(spark, docs, FOLDER), f"test-{name}")
        out.append(docs)
    return out


def test_columns(kept):
    for docs in kept[:-2]:
        assert docs.columns == kept[0].columns
    assert kept[4].columns == [*kept[0].columns, "mix_slot"] and "mix_slot" in kept[5].columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_join", "pii", "mixing", "bpe"]


def test_toxic_documents_go_and_clean_ones_stay(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables have some ten or fifty toxic labels, too few to learn from
    toxic = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    docs = table(spark, folder, "documents")
    before, after = ({r.doc_id for r in d.collect()} for d in (docs, P.drop_toxic(spark, docs, folder)))
    clean, bad = ({d for d in before if toxic.get(d) == k} for k in (0, 1))
    assert after <= before and len(clean & after) >= 0.98 * len(clean)
    assert len(bad - after) >= 0.75 * len(bad)


def test_one_of_each_group_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    want = {d for d, _, c in brute(rows, 5, 80) if c == d}
    assert {r.doc_id for r in kept[2].collect()} == want


def test_no_personal_data_is_left(kept):
    before = {r.doc_id: r.text for r in kept[2].collect()}
    after = {r.doc_id: r.text for r in kept[3].collect()}
    assert before.keys() == after.keys()
    for d, text in before.items():
        if not base(text) and " term>" not in (after[d] or "") and "<secret>" not in (after[d] or ""):
            assert after[d] == text or len(after[d]) < len(text)
        for s, k, e, m in base(text):
            assert f"<{pii.KINDS[k]}>" in after[d] or any(x < e and s < z for x, _, z, _ in base(text) if x != s)


def test_tokens_as_the_library(kept):
    library = Tokenizer.from_file(str(bpe.default_vocabulary()))
    library.no_truncation()
    library.no_padding()
    want = []
    for r in kept[4].collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, r.mix_slot, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, kept[5].collect())) == sorted(want)


def test_odd_rows_pass_all_stages_as_they_are(spark, tmp_path):
    """Null ids, repeats, null and empty texts and columns that are called like those of the operators: values after each stage."""
    r = random.Random(8)
    text = lambda k: " ".join(f"{r.choice('abcdefgh')}{r.choice('klmnop')}{i}x{k}" for i in range(40))
    rows = [(i, text(i), "en", "s1" if i % 3 else None, 7, 42.5, "p", "m", f"own{i}", -1) for i in range(60)]
    rows += [(None, text(100), "en", "s2", 7, 42.5, "p", "m", "none", -1), (None, text(101), None, "s2", 7, 42.5, "p", "m", "none", -1)]
    rows += [rows[4], rows[4], (500, rows[5][1], "en", "s1", 7, 42.5, "p", "m", "copy", -1), (501, None, "en", "s1", 7, 42.5, "p", "m", "null", -1), (502, "", "en", "s1", 7, 42.5, "p", "m", "empty", -1), (503, f"mail me at some.one@example.com {text(7)}", "en", "s2", 7, 42.5, "p", "m", "mail", -1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, passages string, mix_slot string, term string, component long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 20 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out, now = [], table(spark, str(tmp_path), "documents")
    for name, step in P.STAGES:
        now = stage(step(spark, now, str(tmp_path)), f"odd-{name}")
        out.append(now)
    others = ["lang", "source", "score", "passages", "mix_slot", "term", "component"]
    known = {tuple(x) for x in docs.select("doc_id", *others).collect()}
    for got in out[:4]:
        assert {tuple(x) for x in got.select("doc_id", *others).collect()} <= known
        assert got.columns[: len(docs.columns)] == docs.columns
    toxic, alone, clean, mix = ([x.asDict() for x in got.collect()] for got in out[:4])
    assert all(x["score"] == 42.5 and x["passages"] == "p" for x in mix)
    assert sum(x["term"] == "none" for x in alone) == 2 and {501, 502} <= {x["doc_id"] for x in alone}
    assert not {500} & {x["doc_id"] for x in alone if any(y["doc_id"] == 5 for y in toxic)} and sum(x["doc_id"] == 4 for x in alone) == 1
    assert next(x["text"] for x in clean if x["doc_id"] == 501) is None and "<email>" in next(x["text"] for x in clean if x["doc_id"] == 503)
    assert "mix_slot_" in out[3].columns and not {501, 502} & {x["doc_id"] for x in mix}
    assert out[4].columns == ["doc_id", "mix_slot_", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(((x["doc_id"], x["mix_slot_"]) for x in mix), key=repr) == sorted(((x.doc_id, x.mix_slot_) for x in out[4].collect()), key=repr)
