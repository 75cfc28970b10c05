"""SimHash near-duplicates with BK-trees over shards of fingerprints.

Fingerprints are 64-bit majorities over the XXH64 (seed 42) of word shingles. Two that
differ in at most ``RADIUS`` = 3 bits agree on at least two of five blocks, so every pair
of blocks deals the distinct fingerprints into shards; each shard is a BK-tree, whose
children are keyed by their Hamming distance to the parent, and a search follows only
edges within the radius. A shard of more than ``SHARD`` members is cut into tiles, and
each pair of tiles is a task's work of bounded size. A shard gives a spanning forest of
its links, never all pairs; components follow by star contraction.

Cases: null and empty texts have fingerprint zero and link like any other; fewer words
than a shingle are one shingle; repeated rows repeat in the result; a null doc_id takes
part, and a component of null ids only has a null id; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import map_texts, settle
from .components import components

SHINGLE, SEED, RADIUS, SHARD = 3, 42, 3, 4096
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def _prints(size: int):
    digest, seed = xxhash.xxh64_intdigest, SEED

    def run(data: np.ndarray, offsets: np.ndarray):
        raw = K.LOWER[data].tobytes()
        joined = [b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        text = b"".join(joined)
        bounds = np.zeros(len(joined) + 1, np.int64)
        np.cumsum([len(x) for x in joined], out=bounds[1:])
        starts, ends, counts = K.spans(np.frombuffer(text, np.uint8), bounds, K.SPACE)
        first, row = K.row_windows(counts, size)
        short = np.flatnonzero((counts > 0) & (counts < size))
        where = np.concatenate([row, short])
        order = np.argsort(where, kind="stable")
        a = np.concatenate([starts[first], bounds[short]])[order].tolist()
        b = np.concatenate([ends[first + size - 1], bounds[short + 1]])[order].tolist()
        hashes = np.fromiter([digest(text[i:j], seed) for i, j in zip(a, b)], np.uint64, len(a))
        return [K.bit_majorities(hashes, np.bincount(where, minlength=len(joined))).view(np.int64)]

    return run


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Kept columns and the 64-bit ``print`` of every row."""
    return map_texts(docs, list(keep), text, _prints(shingle), "print long")


class BKTree:
    """A Burkhard-Keller tree over distinct 64-bit words, built and searched many words at a time."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.nodes: list[tuple[int, list[tuple[int, int]]]] = []  # (word, [(distance, child node)])
        waiting = [(np.arange(len(words)), -1, 0)] if len(words) else []
        while waiting:
            members, parent, edge = waiting.pop()
            node = len(self.nodes)
            self.nodes.append((int(members[0]), []))
            if parent >= 0:
                self.nodes[parent][1].append((edge, node))
            rest = members[1:]
            if len(rest) == 1:
                waiting.append((rest, node, int(np.bitwise_count(words[rest[0]] ^ words[members[0]]))))
            elif len(rest):
                far = np.bitwise_count(words[rest] ^ words[members[0]])
                waiting.extend((rest[far == d], node, int(d)) for d in np.unique(far))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each visited word, the indexes of the queries within the radius of it."""
        waiting = [(0, np.arange(len(queries)))] if self.nodes else []
        while waiting:
            node, active = waiting.pop()
            word, children = self.nodes[node]
            far = np.bitwise_count(queries[active] ^ self.words[word]).astype(np.int16)
            near = active[far <= radius]
            if len(near):
                yield word, near
            for edge, child in children:
                follow = active[np.abs(far - edge) <= radius]
                if len(follow):
                    waiting.append((child, follow))


def _shard_links(words: np.ndarray, tiles: np.ndarray, pair: tuple[int, int], radius: int) -> tuple[list, list]:
    """A spanning forest of the links of one shard, or between its two tiles."""
    members, queries = (words, words) if pair[0] == pair[1] else (words[tiles == pair[0]], words[tiles == pair[1]])
    if pair[0] == pair[1] and len(words) == 2:
        close = np.bitwise_count(words[0] ^ words[1]) <= radius
        return ([words[0]], [words[1]]) if close else ([], [])
    both = np.concatenate([members, queries]) if pair[0] != pair[1] else members
    shift = len(members) if pair[0] != pair[1] else 0
    label = np.arange(len(both))
    u, v = [], []
    for word, near in BKTree(members).search(queries, radius):
        near = near + shift
        own = label[near]
        apart = own != label[word]
        if apart.any():
            groups, at = np.unique(own[apart], return_index=True)
            for i in near[apart][at]:
                u.append(both[word])
                v.append(both[i])
            label[np.isin(label, groups)] = label[word]
    return u, v


def links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links (u, v) that connect the distinct values of ``print`` at most ``radius`` bits apart."""
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"radius {radius} needs more blocks than {len(BLOCKS)}")
    part = lambda at, n: F.shiftrightunsigned(F.col("print"), at).bitwiseAND((1 << n) - 1)
    keys = [F.struct(F.lit(k).alias("k"), (part(*x) * (1 << y[1]) + part(*y)).alias("value")) for k, (x, y) in enumerate(combinations(BLOCKS, 2))]
    dealt = points.select("print", F.explode(F.array(*keys)).alias("key")).select("print", "key.k", "key.value")
    sizes = settle(dealt.groupBy("k", "value").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    tiles = F.ceil(F.col("n") / shard).cast("int")
    own = dealt.join(sizes, ["k", "value"]).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = own.withColumn("other", others).select("k", "value", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "print")
    ready = pairs.repartition("k", "value", "a", "b").sortWithinPartitions("k", "value", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def solve(table: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            u, v, begin = [], [], 0
            for end in ends:
                if end - begin > 1:
                    more = _shard_links(table["print"][begin:end].view(np.uint64), table["tile"][begin:end], (table["a"][begin], table["b"][begin]), radius)
                    u += more[0]
                    v += more[1]
                begin = end
            return pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], names=["u", "v"])

        for batch in batches:
            table = np.zeros(batch.num_rows, [("k", "i4"), ("value", "i8"), ("a", "i4"), ("b", "i4"), ("tile", "i4"), ("print", "i8")])
            for i, name in enumerate(table.dtype.names):
                table[name] = batch.column(i).to_numpy()
            table = table if rest is None else np.concatenate([rest, table])
            key = table[["k", "value", "a", "b"]]
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1
            cut = ends[-1] if len(ends) else 0
            if cut:
                yield solve(table[:cut], ends)
            rest = table[cut:]
        if rest is not None and len(rest):
            yield solve(rest, np.array([len(rest)]))

    return ready.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Kept columns, ``print``, ``component_id`` (the least id reachable) and ``root`` (the same for one component only) of every row."""
    prints = settle(fingerprints(docs, tuple(dict.fromkeys([*keep, id])), text), "prints")
    points = settle(prints.groupBy("print").agg(F.min(F.col(f"`{id}`")).alias("low")), "points")
    linked = components(links(points, radius))
    roots = linked.join(points, linked["node"] == points["print"]).groupBy("root").agg(F.min("low").alias("least"))
    least = linked.join(roots, "root").select(F.col("node").alias("print"), "root", "least")
    # an only fingerprint's least id is its own; one of a component is that of the component, null or not
    classes = points.join(least, "print", "left").select("print", F.coalesce("root", "print").alias("root"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(classes, "print", "left").select(*[F.col(f"`{c}`") for c in keep], "print", "component_id", "root")
