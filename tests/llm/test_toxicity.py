import zlib

import numpy as np
from llm_rows import SF, docs_table  # noqa: F401
from pyspark.sql import functions as F

from tracegauge.llm import kernels as K, toxicity
from tracegauge.llm.queries import QUERIES


def lexicon(*words):
    hashes = np.array([toxicity.word_hash(w) for w in words], np.uint64)
    order = np.argsort(hashes)
    none = np.zeros(0, np.uint64)
    others = [none] * len(toxicity.STEMS)
    return toxicity.Lexicon([hashes[order], *others], [order, *others])


def test_features_count_what_they_say():
    texts = [b"you IDIOT!! an id1ot, sooo bad", b"", b"fine words here?"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    made = toxicity.features(lexicon("idiot"), data, offsets)
    row = dict(zip(toxicity.FEATURES, made[0]))
    assert row["word_16"] == 1 / 6 and row["near_second_person"] == 1 / 6 and row["hidden_count"] == np.log1p(1)
    assert row["exclamations"] == 2 / len(texts[0]) and row["all_caps"] == 1 / 6 and row["mixed"] == 1 / 6 and row["repeated_letters"] == 1 / len(texts[0])
    assert not made[1].any() and made[2][toxicity.FEATURES.index("questions")] == 1 / len(texts[2])


def test_query_finds_held_out_toxic_documents(spark):
    sf = SF.replace("0.001", "0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op3_toxicity"](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    judged = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    hit, false = np.mean([p for y, p in judged if y == 1]), np.mean([p for y, p in judged if y == 0])
    assert hit > 0.8 and false < 0.01  # some labels of these tables are wrong on purpose


def test_without_labels_and_with_odd_rows(spark, docs_table):
    docs = docs_table([(1, None), (2, ""), (None, "you"), (2, "x")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.train(docs, none, F.lit(True)).score(docs).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0), (2, 1)], "doc_id long, toxic int")
    got = toxicity.train(docs, one, F.lit(True)).score(docs).collect()
    assert len(got) == 4 and {r.score for r in got} == {1.0}
    assert len(K.SPACE) == 256
