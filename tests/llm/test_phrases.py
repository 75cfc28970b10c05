import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from llm_rows import docs_table  # noqa: F401

from tracegauge.llm import phrases
from tracegauge.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(docs, longest):
    f, n = {}, Counter()
    for lang, text in docs:
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            own.update(" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return f, n


def brute(docs, least, longest, share, most):
    out = []
    f, n = counts_of(docs, longest)
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if " " in p and a >= least}
        rows = []
        for p, a in candidates.items():
            w = p.split(" ")
            cuts = [(1000 * a * n[lang] // (own[" ".join(w[:k])] * own[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            longer = [b for q, b in candidates.items() if len(q.split(" ")) > len(w) and f" {p} " in f" {q} "]
            if not any(100 * b >= share * a for b in longer):
                rows.append((p, a, own[" ".join(w[:k])], own[" ".join(w[k:])], n[lang], score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(rows[:most], 1)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.grp, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in frame.collect())


@pytest.mark.parametrize("least,longest,share,most", [(4, 5, 100, 50), (3, 3, 60, 2000), (2, 2, 100, 10)])
def test_equals_brute_force(spark, least, longest, share, most):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = phrases.top(phrases.collocations(docs, least, longest, share), most)
    want = brute([(r.lang, r.text) for r in docs.collect()], least, longest, share, most)
    assert len(want) > 10
    assert rows_of(made) == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.lang, r.text) for r in docs.collect()], 100, 5, 100, 2000)
    got = QUERIES["op12_collocations"](spark, sf)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 10


def test_odd_rows(spark, docs_table):
    rows = [(1, None), (2, ""), (None, "A b\ta  B"), (None, "a b. a b"), (3, "ü é ü é"), (4, "a b, c\x0bd"), (4, "a b, c\x0bd")]
    docs = docs_table(rows)
    got = rows_of(phrases.top(phrases.collocations(docs, 2, 4, 100, group=None), 9))
    assert got == [("", *r[1:]) for r in brute([(None, t) for _, t in rows], 2, 4, 100, 9)]
    # the group may be any column, also one named as a column inside
    assert {r[0] for r in rows_of(phrases.top(phrases.collocations(docs, 2, 4, group="a"), 9))} == {"und"}
    assert phrases.collocations(docs.limit(0), 1, group=None).count() == 0


def test_scores_are_exact_past_64_bits(spark):
    big = 4 * 10**12
    rows = [("g", "", 0, 10**14), ("g", "x", 1, big + 7), ("g", "y", 1, big + 9), ("g", "x y", 2, big)]
    made = phrases.scores(spark.createDataFrame(rows, "grp string, phrase string, size int, f long")).collect()
    assert [r.score for r in made] == [1000 * big * 10**14 // ((big + 7) * (big + 9))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), max_size=60), max_size=12), st.integers(1, 12))
def test_merged_summaries_keep_every_frequent_gram(parts, least):
    true = Counter(x for p in parts for x in p)
    own = phrases.Summary(sum(map(len, parts)) // least + 1)
    for p in parts:
        own.merge(*phrases.counted(np.array(p, np.uint64)))
        assert len(own.hashes) <= own.capacity
    assert own.taken < least
    assert {x for x, n in true.items() if n >= least} <= set(own.frequent(least).tolist())
    assert all(true[h] - own.taken <= c <= true[h] for h, c in zip(own.hashes.tolist(), own.counts.tolist()))


def test_a_long_text_is_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    text = "ab cd ef. gh " * 30 + "x" * 200 + " ab cd\n" + "q r " * 60
    batch = pa.RecordBatch.from_arrays([pa.array(["g"]), pa.array([text])], names=["grp", "text"])
    got = Counter()
    for block, _, new in phrases.blocks(iter([batch]), 3):
        for n in (1, 2, 3):
            _, whole = block.grams(n)
            first = max(0, new - n + 1)
            got.update(block.phrases(first + np.flatnonzero(whole[first:]), n))
    assert got == counts_of([("g", text)], 3)[0]["g"]
