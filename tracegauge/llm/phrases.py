"""Collocation mining: frequent phrases by Misra-Gries summaries, then exact counts and a cut-based score.

First pass. Texts are cut into pieces and words; every run of 1 to ``longest`` words of a
piece is a gram, hashed with its group. A task's grams are counted and dealt by the top bits of
their hashes: one row holds a task's hashes and counts of one hash partition. Each
partition merges its rows into one Misra-Gries summary whose capacity exceeds the
partition's mass divided by the threshold; merging takes off the same count from all
counters when there are too many, and what is taken off in all stays under the threshold,
so every gram as frequent as the threshold survives. There are as many partitions as
the text needs for a summary and its rows to stay small; a gram that is a third of all is one
counter a row.

Second pass. A bitmap of the surviving hashes lets through the grams worth counting (and
a few others); those are counted exactly, as strings, by an aggregate that starts within each task.
The bitmap is sized by the survivors and never passes ``MOST_BITS``; a full one lets
more through and changes no result.

Phrases of two or more words at the threshold are candidates. Cutting one into two parts scores it by
1000 * a * n / (l * r), in exact decimals; its lowest cut counts. A candidate whose words
lie inside a longer candidate that is about as frequent is dropped.

Cases: a null text is empty; a null group is ``und``; rows are counted whether or not they are equal;
an empty table gives an empty table; columns besides the group and the text are not
looked at; a text of any length is taken whole (its words go through in blocks that
overlap by ``longest`` - 1 words); ties of the score go to the more frequent phrase, then to the
lesser string in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import kernels as K
from .common import settle

U = np.uint64
PIECE_ENDS = K.byte_set((46, 46), (44, 44), (59, 59), (58, 58), (33, 33), (63, 63), (0x0A, 0x0D))
WORD_ENDS = PIECE_ENDS | K.byte_set((0x20, 0x20), (0x09, 0x09))
TASK_BYTES = 8 << 20
BLOCK_BYTES = 2 << 20
PARTITION_BYTES = 2 << 20
LEAST_BITS, MOST_BITS, SPARE_BITS = 16, 29, 8
TOP_BUCKETS = 16
MOST_PARTS = 26


def prepared(docs: DataFrame, group: str | None, text: str) -> DataFrame:
    own = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("und")) if group else F.lit("")
    return docs.select(own.alias("grp"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


class Block:
    """Words of some texts (lower-cased), with the hashes of their grams."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, groups: np.ndarray, salts: np.ndarray):
        self.low = K.LOWER[data]
        self.starts, self.ends, counts = K.spans(self.low, offsets, WORD_ENDS)
        row = np.repeat(np.arange(len(counts)), counts)
        self.group = groups[row]
        ends_before = np.cumsum(PIECE_ENDS[self.low])
        # a number that grows at each piece end and at each text
        self.piece = (ends_before[self.starts] if len(self.starts) else np.zeros(0, np.int64)) + row
        self.codes = K.span_hash(K.prefix_hash(self.low), self.starts, self.ends)
        self.salt = salts[row]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every run of n words, whether it lies in one piece)."""
        hashes = K.gram_hash(self.codes, n, n)
        size = len(hashes)
        return K.mix(hashes ^ self.salt[:size]), self.piece[:size] == self.piece[n - 1 : n - 1 + size]

    def phrases(self, at: np.ndarray, n: int) -> list[str]:
        raw = self.low.tobytes()
        starts, ends = self.starts, self.ends
        return [b" ".join([raw[starts[i + k] : ends[i + k]] for k in range(n)]).decode("utf-8", "replace") for i in at.tolist()]


def blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Block, pa.Array, int]]:
    """(block, names of its groups, first word of it that is new) of (grp, text) batches."""
    for batch in batches:
        data, offsets = K.buffers(batch.column(1))
        coded = batch.column(0).dictionary_encode()
        names = coded.dictionary
        groups = coded.indices.to_numpy()
        salts = np.array([hash_name(g) for g in names.to_pylist()], U)[groups]
        for a, b in K.chunks(offsets, BLOCK_BYTES):
            own = data[offsets[a] : offsets[b]]
            if b - a > 1 or len(own) <= 2 * BLOCK_BYTES:
                yield Block(own, offsets[a : b + 1] - offsets[a], groups[a:b], salts[a:b]), names, 0
            else:
                for first, start, end in overlapping(own, longest - 1):
                    yield Block(own[start:end], np.array([0, end - start]), groups[a:b], salts[a:b]), names, first


def overlapping(data: np.ndarray, words: int) -> Iterator[tuple[int, int, int]]:
    """(words repeated, start, end) of parts of one long text that end between words and repeat the last ``words`` words before them."""
    at, start, repeated = 0, 0, 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        while end < len(data) and not WORD_ENDS[data[end]]:
            gap = WORD_ENDS[data[end : end + BLOCK_BYTES]]
            end += int(gap.argmax()) if gap.any() else len(gap)
        yield repeated, start, end
        firsts, _, _ = K.spans(data[start:end], np.array([0, end - start]), WORD_ENDS)
        repeated = min(words, len(firsts))
        start = start + int(firsts[-repeated]) if repeated else end
        at = end


def hash_name(name: str) -> int:
    raw = np.frombuffer(name.encode(), np.uint8)
    return int(K.span_hash(K.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])


def counted(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and their summed counts."""
    if counts is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[len(hashes) > 0], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    if counts is None:
        return hashes[first], np.diff(np.append(first, len(hashes)))
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


class Summary:
    """A Misra-Gries summary of at most ``capacity`` counters.

    ``merge`` takes counters; when there are more than the capacity, the count of the first that is too
    many is taken off all. Each time that takes at least capacity + 1 times that count off the
    whole mass, so ``taken`` stays at or below mass / (capacity + 1).
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.hashes, self.counts = np.zeros(0, U), np.zeros(0, np.int64)

    def merge(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes, self.counts = counted(np.concatenate([self.hashes, hashes]), np.concatenate([self.counts, counts]))
        if len(self.counts) > self.capacity:
            off = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.taken += off
            stay = self.counts > off
            self.hashes, self.counts = self.hashes[stay], self.counts[stay] - off

    def frequent(self, least: int) -> np.ndarray:
        """Every hash whose true count may reach ``least``."""
        return self.hashes[self.counts + self.taken >= least]


def task_counts(rows: DataFrame, longest: int, parts_log2: int) -> DataFrame:
    """(part, hashes, counts) per task and hash partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, counts = counted(np.concatenate(held))
            part = (hashes >> U(64 - parts_log2)).astype(np.int64) if parts_log2 else np.zeros(len(hashes), np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            counts = counts.astype("<u4")
            for a, b in zip(edges[:-1], edges[1:]):
                data = [pa.array([part[a]], pa.int32()), pa.array([hashes[a:b].tobytes()], pa.binary()), pa.array([counts[a:b].tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(data, names=["part", "hashes", "counts"])

        for block, _, new in blocks(batches, longest):
            for n in range(1, longest + 1):
                hashes, whole = block.grams(n)
                first = max(0, new - n + 1)
                held.append(hashes[first:][whole[first:]])
            size += len(block.low)
            if size >= TASK_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "part int, hashes binary, counts binary")


def survivors(summaries: DataFrame, least: int) -> DataFrame:
    """(part, hashes) of the grams that may occur ``least`` times, from (part, hashes, counts)."""

    def run(table: pa.Table) -> pa.Table:
        pairs = [(np.frombuffer(h, U), np.frombuffer(c, "<u4").astype(np.int64)) for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist())]
        mass = sum(int(c.sum()) for _, c in pairs)
        own = Summary(mass // least + 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for i, (h, c) in enumerate(pairs):
            held.append((h, c))
            size += len(h)
            if size > own.capacity or i == len(pairs) - 1:
                own.merge(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                held, size = [], 0
        return pa.table({"part": table.column("part").slice(0, 1), "n": pa.array([len(found := own.frequent(least))]), "hashes": pa.array([found.tobytes()], pa.binary())})

    return summaries.groupBy("part").applyInArrow(run, "part int, n long, hashes binary")


def survivor_bitmap(found: DataFrame, parts_log2: int):
    """A broadcast bitmap of the top bits of the surviving hashes, and its number of bits (log2).

    Sized by the survivors, at most 2 ** MOST_BITS bits (64 MB). Each partition gives its own slice of it.
    """
    n = found.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, parts_log2 + 3, int(n).bit_length() + SPARE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slots = np.unique((np.frombuffer(raw, U) >> U(64 - bits)).astype(np.int64))
                slots -= part << (bits - parts_log2)
                own = np.zeros(1 << (bits - parts_log2 - 3), np.uint8)
                np.bitwise_or.at(own, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "own"])

    whole = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (bits - parts_log2 - 3)
    for part, own in found.where("n > 0").select("part", "hashes").mapInArrow(run, "part int, own binary").toLocalIterator():
        whole[part * step : (part + 1) * step] = np.frombuffer(own, np.uint8)
    return found.sparkSession.sparkContext.broadcast(whole), bits


def exact_counts(rows: DataFrame, longest: int, bitmap, bits: int) -> DataFrame:
    """(grp, phrase, size, f) of every gram the bitmap lets through; size 0: all words of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, names, new in blocks(batches, longest):
            total = np.bincount(block.group[new:], minlength=len(names))
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(own)), pa.array([""] * len(own), pa.string()), pa.array(np.zeros(len(own), np.int32)), pa.array(total[own])], names=["grp", "phrase", "size", "f"])
            below = None
            for n in range(1, longest + 1):
                hashes, whole = block.grams(n)
                pass_ = whole & K.has_bits(bitmap.value, (hashes >> U(64 - bits)).astype(np.int64))
                if below is not None:
                    pass_ &= below[:-1] & below[1:] if len(below) > 1 else False
                below = pass_
                at = np.flatnonzero(pass_)
                at = at[at + n > new]
                if not len(at):
                    continue
                _, first, inverse = np.unique(hashes[at], return_index=True, return_inverse=True)
                f = np.bincount(inverse)
                at = at[first]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(block.group[at])), pa.array(block.phrases(at, n), pa.string()), pa.array(np.full(len(at), n, np.int32)), pa.array(f)], names=["grp", "phrase", "size", "f"])

    return rows.mapInArrow(run, "grp string, phrase string, size int, f long").groupBy("grp", "phrase", "size").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5, group: str | None = "lang", text: str = "text") -> DataFrame:
    """(grp, phrase, size, f): exact counts of every phrase of 1 to ``longest`` words that occurs ``least`` times in its group; size 0 holds the group's words."""
    rows = prepared(docs, group, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts_log2 = min(MOST_PARTS, max(0, (int(size) // PARTITION_BYTES).bit_length()))
    found = settle(survivors(task_counts(rows, longest, parts_log2), least), "survivors")
    bitmap, bits = survivor_bitmap(found, parts_log2)
    return settle(exact_counts(rows, longest, bitmap, bits).where(F.col("size").eqNullSafe(0) | (F.col("f") >= least)), "phrases")


def scores(counts: DataFrame) -> DataFrame:
    """(grp, phrase, size, a, l, r, n, score) of the candidates: the lowest cut, ties to the shorter first part."""
    whole = counts.where("size = 0").select("grp", F.col("f").alias("n"))
    words = F.split("phrase", " ")
    cut = (
        counts.where("size >= 2")
        .select("grp", "phrase", "size", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        .withColumns({"left": F.array_join(F.slice("w", 1, F.col("k")), " "), "right": F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ")})
        .drop("w")
    )
    parts = counts.where("size >= 1")
    made = (
        cut.join(parts.select("grp", F.col("phrase").alias("left"), F.col("f").alias("l")), ["grp", "left"])
        .join(parts.select("grp", F.col("phrase").alias("right"), F.col("f").alias("r")), ["grp", "right"])
        .join(whole, "grp")
    )
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = made.groupBy("grp", "phrase", "size", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("grp", "phrase", "size", "a", "best.l", "best.r", "n", "best.score")


def contained(candidates: DataFrame, longest: int) -> DataFrame:
    """(grp, phrase, inside): the largest count of a longer candidate that holds the phrase's words in a row."""
    words = F.split("phrase", " ")
    sizes = [(n, at) for n in range(2, longest) for at in range(longest - n + 1)]
    subs = F.filter(
        F.array(*[F.when((F.col("size") > n) & (F.col("size") >= at + n), F.array_join(F.slice("w", at + 1, n), " ")) for n, at in sizes]),
        lambda x: x.isNotNull(),
    )
    return candidates.withColumn("w", words).select("grp", F.explode(subs).alias("phrase"), "a").groupBy("grp", "phrase").agg(F.max("a").alias("inside"))


def collocations(
    docs: DataFrame,
    least: int = 100,
    longest: int = 5,
    share: int = 100,
    group: str | None = "lang",
    text: str = "text",
) -> DataFrame:
    """(grp, phrase, size, a, l, r, n, score) of every candidate that is not dropped.

    A candidate goes if a longer candidate that holds its words in a row has at least
    ``share`` hundredths of its count.
    """
    made = scores(frequent_phrases(docs, least, longest, group, text))
    if longest < 3:
        return made
    made = settle(made, "candidates")
    inside = contained(made, longest)
    return made.join(inside, ["grp", "phrase"], "left").where(F.col("inside").isNull() | (100 * F.col("inside") < share * F.col("a"))).drop("inside")


def top(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each group with their ``rank``; hot groups are cut down in buckets first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = W.partitionBy("grp", "bucket").orderBy(*order)
    cut = found.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(TOP_BUCKETS))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    return cut.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= most).drop("bucket")
