"""Nearest neighbours by inner product with collision-counting hashing.

Every hash is one random projection kept as a sorted array. A query opens a window around
its own projection in each of them; the window grows by virtual rehashing (a factor
``GROWTH`` per round), and a vector that collides in at least ``THRESHOLD`` of the
``HASHES`` windows is verified by its inner product. A query stops growing when
``SHARE`` of the vectors of a block, and the wanted number, are verified. Vectors gain one
component, so that the largest inner product is the least distance.

All rows are searched, in blocks: ``BLOCK`` vectors against ``QUERIES`` queries a time, which
bounds a task whatever the table's size; each block gives its own nearest, and the
nearest of all blocks are merged.

Cases: rows with a null id, and vectors that are null, empty, zero, or hold a null or
non-finite component take no part; of rows that share an id the least vector counts;
vectors are compared with vectors of their own length only; ties go to the smaller id;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

HASHES, THRESHOLD, GROWTH, FIRST, SHARE, SEED = 64, 36, 1.2, 0.6, 0.2, 7
BLOCK, QUERIES, STEP = 8192, 512, 64


def usable(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector, size, norm) of the rows that take part."""
    own = rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").alias("vector")).where("id is not null and vector is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    own = own.where(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)).groupBy("id").agg(F.min("vector").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return own.withColumn("size", F.size("vector")).withColumn("norm", norm)


class Collisions:
    """Sorted projections of a block of vectors; ``longest`` bounds the norms of all vectors."""

    def __init__(self, vectors: np.ndarray, longest: float):
        self.vectors = vectors
        self.directions = np.random.default_rng(SEED).standard_normal((HASHES, vectors.shape[1] + 1))
        scaled = vectors / longest
        rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(1)))
        values = np.column_stack([scaled, rest]) @ self.directions.T
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(values, order, 0).T.copy()
        self.rank = np.empty((HASHES, len(vectors)), np.uint16)
        for h in range(HASHES):
            self.rank[h, order[:, h]] = np.arange(len(vectors))
        self.spread = float(values.std()) or 1.0

    def candidates(self, queries: np.ndarray, wanted: int):
        """(query, vectors that passed the threshold) of some queries; windows grow until enough pass."""
        norms = np.sqrt((queries * queries).sum(1, keepdims=True))
        at = np.column_stack([queries / norms, np.zeros(len(queries))]) @ self.directions.T
        n = len(self.vectors)
        enough = min(n, wanted + int(SHARE * n))
        open_ = np.arange(len(queries))
        half = FIRST * self.spread
        while len(open_):
            count = np.zeros((len(open_), n), np.uint8)
            for h in range(HASHES):
                low = np.searchsorted(self.sorted[h], at[open_, h] - half, "left")
                width = np.searchsorted(self.sorted[h], at[open_, h] + half, "right") - low
                # one comparison of unsigned ranks tells whether low <= rank < low + width
                count += (self.rank[h][None, :] - low.astype(np.uint16)[:, None]) < width.astype(np.uint16)[:, None]
            passed = count >= THRESHOLD
            done = passed.sum(1) >= enough
            for i in np.flatnonzero(done):
                yield open_[i], np.flatnonzero(passed[i])
            open_ = open_[~done]
            half *= GROWTH


def search(rows: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` nearest among all rows but its own.

    ``is_query`` is a condition on a column named ``id``.
    """
    own = usable(rows, id, vector)
    bounds = {r.size: (r.longest, r.n, r.queries) for r in own.groupBy("size").agg(F.max("norm").alias("longest"), F.count("*").alias("n"), F.count_if(is_query).alias("queries")).collect()}
    if not bounds:
        return own.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    longest = max(x[0] for x in bounds.values())
    blocks = -(-max(x[1] for x in bounds.values()) // BLOCK)
    parts = max(1, -(-max(x[2] for x in bounds.values()) // QUERIES))
    dealt = own.drop("norm").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("part", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = dealt.where(is_query).withColumn("block", every(blocks)).withColumn("asks", F.lit(True))
    held = dealt.withColumn("part", every(parts)).withColumn("asks", F.lit(False))

    def solve(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        out: list[tuple] = []
        if asks.any() and not asks.all():
            vectors = np.stack(table.column("vector").to_numpy()).astype(np.float64)
            # Equal vectors collide alike: they are one entry of the index, with their k + 1 least ids, so that a
            # common vector does not fill a query's share of verified vectors.
            different, entry = np.unique(vectors[~asks], axis=0, return_inverse=True)
            order = np.lexsort((ids[~asks], entry))
            own_ids, first_of = ids[~asks][order], np.searchsorted(entry[order], np.arange(len(different) + 1))
            query_ids, query_vectors = ids[asks], vectors[asks]
            for first in range(0, len(different), 2 * BLOCK):  # blocks are dealt by hash; ranks need under 2 ** 16 vectors
                index = Collisions(different[first : first + 2 * BLOCK], longest)
                for a in range(0, len(query_ids), STEP):
                    for i, found in index.candidates(query_vectors[a : a + STEP], k + 1):
                        begin = first_of[first + found]
                        size = np.minimum(first_of[first + found + 1] - begin, k + 1)
                        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
                        score = np.repeat((index.vectors[found] * query_vectors[a + i]).sum(1), size)
                        near = own_ids[at]
                        best = np.lexsort((near, -score))
                        best = best[near[best] != query_ids[a + i]][:k]
                        out.append((np.full(len(best), query_ids[a + i]), near[best], score[best]))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})

    near = asked.unionByName(held).withColumn("id", F.col("id").cast("long")).groupBy("size", "block", "part").applyInArrow(solve, "query_id long, vec_id long, score double")
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
