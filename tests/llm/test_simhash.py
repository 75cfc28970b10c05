import random

import brute
import numpy as np
from brute import invented
from llm_rows import SF, docs_table, rows_of  # noqa: F401

from tracegauge.llm import components, simhash
from tracegauge.llm.queries import QUERIES


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = rows_of(QUERIES["op7_simhash_components"](spark, SF), "doc_id", "fingerprint", "component_id")
    assert got == sorted(brute.simhash(docs), key=repr)


def test_ties_nulls_repeats_and_small_tiles(docs_table):
    docs = [(i % 50 if i % 11 else None, t) for i, t in enumerate(invented(3))]
    out = simhash.near_duplicates(docs_table(docs))
    want = sorted(((d, int(p, 16) - (1 << 64) * (int(p, 16) >> 63), c) for d, p, c in brute.simhash(docs)), key=repr)
    assert rows_of(out, "doc_id", "print", "component_id") == want
    assert simhash.near_duplicates(docs_table([(1, "x")]).limit(0)).count() == 0


def test_tiles_connect_what_one_shard_connects(spark):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(6)]
    words = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for c in centres for _ in range(40)})
    points = spark.createDataFrame([(int(np.uint64(w).view(np.int64)),) for w in words], "print long")
    group = {w: w for w in words}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in words:
        for b in words:
            if (a ^ b).bit_count() <= 3:
                group[find(a)] = find(b)
    for shard in (7, 4096):
        got = {r.node: r.root for r in components.components(simhash.links(points, shard=shard)).collect()}
        classes = {}
        for w in words:
            s = int(np.uint64(w).view(np.int64))
            classes.setdefault(find(w), set()).add(got.get(s, s))
        assert all(len(x) == 1 for x in classes.values()) and len({min(x) for x in classes.values()}) == len(classes)


def test_tree_search_finds_all_within_the_radius():
    r = np.random.default_rng(1)
    words = np.unique(r.integers(0, 1 << 12, 300, dtype=np.uint64))
    found = {(int(words[n]), int(words[i])) for n, near in simhash.BKTree(words).search(words, 2) for i in near}
    assert found == {(int(a), int(b)) for a in words for b in words if (int(a) ^ int(b)).bit_count() <= 2}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(9)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
