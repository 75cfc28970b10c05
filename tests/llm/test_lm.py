import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from llm_rows import SF, docs_table  # noqa: F401
from pyspark.sql import functions as F

from tracegauge.llm import lm
from tracegauge.llm.queries import QUERIES


def base(docs, teaches):
    own = Counter()
    for d, t in docs:
        if teaches(d):
            own.update([*brute.SPACED.findall(brute.lowered(t)), None])
    n, v = sum(own.values()), len(own)
    out = []
    for d, t in docs:
        tokens = [*brute.SPACED.findall(brute.lowered(t)), None]
        out.append((d, len(tokens), sum(own[w] > 0 for w in tokens), n, sum(math.log10((own[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return sorted(out, key=repr)


def same(got, want):
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-9)


def test_query_has_the_exact_base_and_beats_it_on_held_out_texts(spark):
    sf = SF.replace("0.001", "0.01")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op4_log_bilinear_scores"](spark, sf).collect()
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    same(rows, base(docs, lambda d: zlib.crc32(str(d).encode()) % 10 != 0))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_class_probabilities_sum_to_one():
    share = np.full(40, 1 / 40)
    model = lm.LogBilinear.fresh(share)
    z = model.normalisers()
    for u, v in ((0, 1), (7, 7), (39, 3)):
        p = 10 ** model.log10(z, np.full(40, u), np.full(40, v), np.arange(40))
        assert p.sum() == pytest.approx(1, abs=1e-5)


def test_noise_contrastive_steps_learn_a_context():
    r = np.random.default_rng(0)
    one = r.integers(0, 8, 60_000)
    word = (one + 1) % 8
    share = np.full(8, 1 / 8)
    model = lm.LogBilinear.fresh(share)
    for epoch in range(3):
        model.fit(one, np.zeros_like(one), word, share, 0.2, seed=epoch)
    p = 10 ** model.log10(model.normalisers(), np.arange(8), np.zeros(8, int), (np.arange(8) + 1) % 8)
    assert p.min() > 0.5


def test_null_empty_repeated_and_untaught_rows(spark, docs_table, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 5)
    rows = [(1, "A b a"), (1, "A b a"), (2, None), (None, "a zz " + "q" * 100), (3, ""), (4, "b\tc\x0bA"), (5, "q" * 100)]
    teaches = F.coalesce(F.col("doc_id") != 4, F.lit(False))
    got = lm.score(docs_table(rows), teaches).collect()
    same(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr), base(rows, lambda d: d is not None and d != 4))
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    none = lm.score(docs_table(rows), F.lit(False)).collect()
    assert {r.base_score for r in none} == {0.0} and {r.score for r in none} == {0.0} and {r.train_tokens for r in none} == {0}
    assert lm.score(docs_table(rows).limit(0), teaches).count() == 0


def test_warm_start_reaches_the_end_of_long_texts():
    assert lm.spread_places(7).tolist() == list(range(7))
    places = lm.spread_places(100_000)
    assert len(set(places.tolist())) == lm.WARM_TOKENS and places[0] == 0 and places[-1] == 99_999
    assert np.diff(places).max() - np.diff(places).min() <= 1
