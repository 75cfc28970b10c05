import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from llm_rows import SF, docs_table  # noqa: F401

from tracegauge.llm import bpe
from tracegauge.llm.queries import QUERIES, vocabulary_path

tokenizers = pytest.importorskip("tokenizers")
theirs = tokenizers.Tokenizer.from_file(vocabulary_path())
ours = bpe.Codec(open(vocabulary_path(), "rb").read())


def same(text):
    want = theirs.encode(text, add_special_tokens=False).ids
    packed = ours.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == want
    assert ours.decode(packed) == theirs.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_random_text_encodes_as_the_library_does(text):
    same(text)


@pytest.mark.parametrize("text", ["", "a  b\n\n c\t\x1c\x1d \x85x᠎ y", "<|endoftext|> a<|endoftext|>", "don't 'S  \n", "日本語 é́ ½²٣", "x" * 5000, " " * 3000, "ab" * 4000])
def test_edges(text):
    same(text)


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_bpe_round_trip"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = theirs.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_null_empty_and_repeated_rows(docs_table):
    out = bpe.encode_decode(docs_table([(1, None), (1, None), (None, ""), (2, "hi hi")]), vocabulary_path())
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out.collect()) == [(0, 0, ""), (1, 0, ""), (1, 0, ""), (2, 2, "hi hi")]
    assert bpe.encode_decode(docs_table([(1, "x")]).limit(0), vocabulary_path()).count() == 0
