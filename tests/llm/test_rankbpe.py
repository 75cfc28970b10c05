import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from llm_rows import SF, docs_table  # noqa: F401

from tracegauge.llm import rankbpe
from tracegauge.llm.queries import QUERIES, vocabulary_path

tiktoken = pytest.importorskip("tiktoken")
PATH = vocabulary_path("byte_bpe_multi_50k.tiktoken")
RAW = open(PATH, "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ours = rankbpe.Codec(RAW, public_tokenizers.PATTERN)


def same(text):
    want = theirs.encode_ordinary(text)
    ids = np.frombuffer(ours.encode(text), "<u4").astype(np.int64)
    assert ids.tolist() == want
    assert b"".join(x.tobytes() for x in ours.decode(ids)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_random_text_encodes_as_the_library_does(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abehnort", max_size=300))
def test_one_long_match_encodes_as_the_library_does(text):
    same(text)


@pytest.mark.parametrize("text", ["", "a  b\n\n c\t\x1c\x1d \x85x᠎ y", "don't 'S  \n", "日本語 é́ ½²٣", "x" * 50_000, " " * 30_000, "ab" * 40_000, "é" * 20_000])
def test_edges_and_matches_past_the_packed_form(text):
    same(text)


def test_a_text_longer_than_a_block_is_encoded_whole():
    text = "word und x123 " * (rankbpe.LONG_TEXT // 10)
    same(text)


class Naive:
    """Merge the leftmost pair of the least rank, again and again."""

    @staticmethod
    def merge(word, ranks):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=100, deadline=None)
@given(st.permutations([b"ab", b"bc", b"abc", b"ca", b"aa", b"aab", b"bcab", b"cc", b"cabc", b"aaa"]), st.text(alphabet="abc", max_size=40), st.booleans())
def test_any_order_of_ranks_and_both_forms_equal_naive_merging(tokens, text, packed):
    # ranks in any order: a longer token may rank before its own parts
    ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
    own = rankbpe.Codec(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()), r"[^\x00]+")
    if packed:
        own.short = own.long
    word = text.encode()
    if word:
        assert own.merge(word).tolist() == Naive.merge(word, ranks)


def test_query_equals_the_library(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op13_rank_queue_bpe"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = theirs.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_null_empty_and_repeated_rows(docs_table):
    rows = docs_table([(1, None), (1, None), (None, ""), (2, "hi hi")])
    out = rankbpe.encode_decode(rows, PATH, public_tokenizers.PATTERN)
    assert sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded)) for r in out.collect()) == [(0, 0, b""), (1, 0, b""), (1, 0, b""), (2, 2, b"hi hi")]
    kept = rankbpe.encode_decode(rows, PATH, public_tokenizers.PATTERN, keep=("text", "__row", "words"))
    assert sorted(r.text or "" for r in kept.collect()) == ["", "", "", "hi hi"]
    assert rankbpe.encode_decode(rows.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
