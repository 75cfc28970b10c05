import zlib

import numpy as np
from llm_rows import SF, docs_table  # noqa: F401
from pyspark.sql import functions as F

from tracegauge.llm import langid
from tracegauge.llm.queries import QUERIES


def test_gradients_equal_differences():
    r = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b", "c"], hidden=3)
    for name in ("inputs", "recur", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, label = r.integers(0, 6, (7, 5)).astype(np.uint8), r.integers(0, 3, 5)
    seen = np.arange(7)[:, None] < r.integers(1, 8, 5)[None, :]
    _, grads = net.gradients(x, seen, label)
    for p, g in zip((net.inputs, net.recur, net.out, net.bias), grads):
        flat, gf = p.reshape(-1), g.reshape(-1)
        for i in r.choice(len(flat), min(25, len(flat)), replace=False):
            if abs(gf[i]) < 1e-4:
                continue
            old = flat[i]
            flat[i] = old + 1e-3
            up = net.gradients(x, seen, label)[0]
            flat[i] = old - 1e-3
            down = net.gradients(x, seen, label)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - gf[i]) < 0.02 * abs(gf[i]) + 2e-4


def test_windows_cut_every_byte_once():
    data, offsets = np.arange(200, dtype=np.uint8), np.array([0, 0, 1, 130, 200])
    starts, sizes, row = langid.windows(data, offsets, 64)
    assert np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)]).tolist() == list(range(200))
    assert row.tolist() == [1, 2, 2, 2, 3, 3]


def test_query_knows_held_out_languages(spark):
    sf = SF.replace("0.001", "0.01")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op10_language"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    right = [docs[r.doc_id].lang == r.lang_pred for r in got if r.held_out]
    assert np.mean(right) > 0.95


def test_null_texts_and_langs(spark, docs_table):
    rows = [(1, "le chat est la"), (2, "the cat is here"), (3, None), (4, ""), (5, "123 !?"), (None, "the cat"), (2, "the cat is here")]
    docs = docs_table(rows).withColumn("lang", F.when(F.col("doc_id") == 1, "fr").when(F.col("doc_id") == 2, "en"))
    net = langid.train(docs, F.lit(True))
    assert net.labels == ["en", "fr"]
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.predict(docs, net).collect())
    assert [g[0] for g in got] == [0, 1, 2, 2, 3, 4, 5] and [g[1] for g in got if g[0] > 2] == ["und"] * 3
    assert langid.train(docs, F.lit(False)) is None and {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), net).count() == 0


def test_no_language_is_crowded_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 5)
    hot = [(i, f"wort nummer {i} und mehr", "de") for i in range(3000)]
    rare = [(10_000 + k, f"some words {k}", f"x{k:02d}") for k in range(30)]
    docs = spark.createDataFrame(hot + rare, "doc_id long, text string, lang string").repartition(4)
    counts = {r.lang: r["count"] for r in langid.sample(docs, F.lit(True), "doc_id", "text", "lang").groupBy("lang").count().collect()}
    assert counts == {"de": 5} | {f"x{k:02d}": 1 for k in range(30)}
    assert len(langid.train(docs, F.lit(True)).labels) == 31
