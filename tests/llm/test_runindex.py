import random

import brute
import numpy as np
import pytest
from llm_rows import SF, docs_table, rows_of  # noqa: F401

from tracegauge.llm import runindex
from tracegauge.llm.queries import QUERIES

OUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def digests(out):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in out.collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted(brute.suffixes(docs), key=repr)
    assert rows_of(QUERIES["op5_run_index_dedup"](spark, SF), *OUT) == want and any(r[2] for r in want)


@pytest.mark.parametrize("shard", [2, 4096])
def test_overlaps_periods_and_both_ways_of_matching(docs_table, shard):
    docs = [(i - 4, t) for i, t in enumerate(brute.invented(33))]
    docs += [(200, "abc" * 150), (201, "q" * 99), (202, "q" * 100), (203, "q" * 130), (204, "é" * 120), (205, "xé" * 70)]
    for width in (100, 12):
        assert digests(runindex.remove_repeats(docs_table(docs), width, shard=shard)) == sorted(brute.suffixes(docs, width), key=repr)


def test_null_ids_come_last_and_equal_rows_are_one_text(docs_table):
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh") for _ in range(150))
    got = digests(runindex.remove_repeats(docs_table([(None, text), (7, text), (7, text), (3, None), (9, "")])))
    assert [r[:4] for r in got] == [(3, 0, 0, 0), (7, 150, 0, 0), (7, 150, 0, 0), (9, 0, 0, 0), (None, 150, 150, 1)]
    assert digests(runindex.remove_repeats(docs_table([(1, "x")]).limit(0))) == []


def test_index_marks_equal_brute_force():
    r = random.Random(2)
    base = bytes(r.choice(b"ab") for _ in range(60))
    parts = [base[r.randrange(20) : r.randrange(40, 60)] + bytes(r.choice(b"abc") for _ in range(r.randrange(9))) for _ in range(30)] + [b"a" * 30, b"ab", b"a" * 12]
    bounds = np.cumsum([0, *map(len, parts)])
    content, offset = runindex.RunIndex(np.frombuffer(b"".join(parts), np.uint8), bounds, 10).marks()
    seen, want = set(), set()
    for k, p in enumerate(parts):
        for i in range(len(p) - 9):
            if p[i : i + 10] in seen:
                want.add((k, i))
            seen.add(p[i : i + 10])
    assert set(zip(content.tolist(), offset.tolist())) == want
