import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_rows import SF, docs_table  # noqa: F401

from tracegauge.llm import resample
from tracegauge.llm.queries import QUERIES

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, n, buckets, percent, least, seed):
    """Every column by plain counting: {(id, place): (words, features, weight, score, rank)}."""

    def features(text):
        words = WORDS.findall((text or "").translate(LOWER))
        grams = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    own, s, t = [(id, *features(text)) for id, text in docs], Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for id, words, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        rows.append([id, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 3])
def test_equals_brute_force(spark, n):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    made = resample.resample(docs, target, n=n, buckets=997, percent=25, least_words=30, seed=7)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], n, 997, 25, 30, 7)
    assert got(made) == want
    assert sum(r[5] is not None for r in want) > 20


def test_query_equals_brute_force(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 1, 10_000, 10, 20, 2024)
    assert got(QUERIES["op11_target_resampling"](spark, SF)) == [(r[0], *r[2:]) for r in want]


def test_odd_rows(spark, docs_table):
    rows = [(1, None), (2, ""), (3, "...!"), (None, "a b"), (None, "a b"), (5, "Ünï CÖDE a b"), (5, "Ünï CÖDE a b"), (6, "\x00 nul\x7fdel")]
    target = docs_table([(1, "a b c"), (2, None)])
    made = resample.resample(docs_table(rows), target, n=2, buckets=50, percent=100, least_words=0, seed=1)
    want = brute(rows, ["a b c", None], 2, 50, 100, 0, 1)
    assert got(made.drop("rank")) == sorted((r[:5] for r in want), key=repr)
    assert sorted(r.rank for r in made.collect()) == list(range(1, len(rows) + 1))
    none = docs_table(rows).limit(0)
    assert resample.resample(none, target).count() == 0
    assert all(r.weight == 0 for r in resample.resample(docs_table([(1, "x")]), none, buckets=1).collect())


@pytest.mark.parametrize("n", [1, 2, 4])
def test_a_long_text_is_cut_between_words(monkeypatch, n):
    monkeypatch.setattr(resample, "CUT_BYTES", 64)
    text = ("Ab cd, éf-gh " * 40 + "x" * 300 + " zz " + "ü" * 70 + "," * 200 + " end").encode()
    raw = np.frombuffer(text, np.uint8)
    features = resample.Features(n, 101)
    words, made = features(raw, np.array([0, len(raw)]))
    plain = [w.encode() for w in WORDS.findall(text.decode().translate(LOWER))]
    want = Counter(zlib.crc32(b" ".join(plain[i : i + k])) % 101 for k in range(1, n + 1) for i in range(len(plain) - k + 1))
    assert int(words[0]) == len(plain)
    assert Counter(made.flatten().to_pylist()) == want


def test_ties_go_to_the_smaller_id_whatever_partition_it_is_in(spark):
    """equal texts tie often; the smaller ids stand in the later partitions."""
    docs = [(i, "w " * 20) for i in range(2000, 0, -1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(8, (-F.col("doc_id")))
    made = resample.resample(frame, frame.limit(0), 1, 100, 100, 20, 7)
    assert got(made) == brute(docs, [], 1, 100, 100, 20, 7)


def test_bytes_that_are_no_text_stay_in_their_row():
    """op11: offsets are bytes; a lone continuation byte moved the words behind it into the next row."""
    texts = [b"\x80\x80\x80\x80 a", b"\xff b c", "éé ÜÜ d".encode(), b"", b"e\n\nf g h"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    words, made = resample.Features(2, 97)(np.frombuffer(b"".join(texts), np.uint8), offsets)
    plain = [WORDS.findall(t.decode("utf-8", "replace").translate(LOWER)) for t in texts]
    assert words.tolist() == [len(p) for p in plain]
    for own, p in zip(made.to_pylist(), plain):
        assert Counter(own) == Counter(zlib.crc32(" ".join(p[i : i + k]).encode()) % 97 for k in (1, 2) for i in range(len(p) - k + 1))
