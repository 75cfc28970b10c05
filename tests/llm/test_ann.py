from collections import Counter

import numpy as np
from llm_rows import SF
from pyspark.sql import functions as F, types as T

from tracegauge.llm import ann
from tracegauge.llm.queries import QUERIES


def exact(rows, is_query, k):
    own = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = min(v, own.get(i, v))
    out = {}
    for q in filter(is_query, own):
        found = sorted((-float((np.array(own[q], float) * np.array(v, float)).sum()), i) for i, v in own.items() if i != q and len(v) == len(own[q]))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def test_query_recall_scores_and_order(spark):
    sf = SF.replace("0.001", "0.1")
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = exact(rows, lambda i: i % 20 == 0, 20)
    got = QUERIES["op1_collision_counting"](spark, sf).collect()
    assert Counter(r.query_id for r in got) == {q: 20 for q in want}
    found = {(r.query_id, r.vec_id): r.score for r in got}
    near = {(q, i): s for q, x in want.items() for i, s in x}
    assert len(near.keys() & found.keys()) / len(near) >= 0.9
    assert all(abs(found[x] - near[x]) < 1e-12 for x in near.keys() & found.keys())
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert all([x[0] for x in v] == list(range(1, 21)) and [x[1:] for x in v] == sorted(x[1:] for x in v) for v in by.values())


def test_a_common_vector_hides_no_neighbour(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.standard_normal((600, 16)))]
    rows = [(i, rows[5][1] if i % 3 == 1 else v) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = exact(rows, lambda i: i % 20 == 0, 20)
    got = {(x.query_id, x.vec_id) for x in ann.search(df, F.col("id") % 20 == 0, k=20).collect()}
    near = {(q, i) for q, x in want.items() for i, _ in x}
    assert len(got) == len(near) and len(got & near) / len(near) >= 0.9


def test_ties_odd_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [-1.0, 0.5]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 1.0]), (11, [1.0]), (20, [3.0, 1.0]), (20, [0.0, 1.0])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("size", T.StringType())])
    df = spark.createDataFrame([(*r, "s") for r in rows], schema).repartition(3)
    got = ann.search(df, F.col("id") % 20 == 0, k=4).orderBy("query_id", "rank").collect()
    want = exact(rows, lambda i: i % 20 == 0, 4)
    assert {q: [(r.vec_id, r.score) for r in got if r.query_id == q] for q in want} == want
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
