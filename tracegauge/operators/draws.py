"""Row-by-row draws that SQL can repeat, hashed and counted in arrays.

Draw ``slot`` of replicate ``r`` takes row ``md5("seed:r:slot")`` (its first 32 bits) modulo the number of
rows. A task holds the rows of one key once, as arrays, and walks the replicates of its
chunk: the digests of a whole block of slots are computed step by step in numpy, the draws are counted
per row, and each arm's metrics follow from its counts in rank order. Only metric values leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

# Rows of one key that a task may hold, slots hashed at once, chunks of replicates for each core.
DENSE_ROWS = 1 << 22
BLOCK = 1 << 15
CHUNKS_PER_CORE = 6

SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


# -- digests -------------------------------------------------------------------------


@dataclass(frozen=True)
class Tails:
    """The ends of messages that differ only in a slot number, for slots of as many digits and a prefix of one length."""

    slots: slice
    first: int
    words: list[np.ndarray]
    bits: int


def tails(n: int, prefix: int) -> Iterator[Tails]:
    """Slots 0 to n - 1 in blocks, as message words behind ``prefix`` bytes; prefix and digits fit one digest block."""
    low, digits = 0, 1
    while low < n:
        if prefix + digits > 55:
            raise ValueError("a draw's text must fit one block of the digest")
        high = min(n, 10**digits)
        for at in range(low, high, BLOCK):
            number = np.arange(at, min(at + BLOCK, high))
            first, last = prefix // 4, (prefix + digits) // 4
            text = np.zeros((len(number), 4 * (last - first + 1)), np.uint8)
            for k in range(digits):
                text[:, prefix - 4 * first + k] = 48 + number // 10 ** (digits - 1 - k) % 10
            text[:, prefix - 4 * first + digits] = 0x80
            yield Tails(slice(at, at + len(number)), first, list(np.ascontiguousarray(text.view("<u4").T)), 8 * (prefix + digits))
        low, digits = high, digits + 1


def heads(prefix: bytes, tail: Tails) -> np.ndarray:
    """The first 32 bits of the MD5 of ``prefix`` and each slot number."""
    known = np.frombuffer(prefix + bytes(-len(prefix) % 4), "<u4")
    fixed = [int(w) for w in known] + [0] * (16 - len(known))
    fixed[14] = tail.bits
    varied = {tail.first + i: w for i, w in enumerate(tail.words)}
    for k in varied.keys() & set(range(len(known))):  # the word that begins in the prefix and ends in the digits
        varied[k] = varied[k] | np.uint32(fixed[k])
    n = len(tail.words[0])
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    # After step 60 the first word of the state is known: the last three steps only turn it round.
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        word = varied.get(WORDS[i])
        f += a
        if word is None:
            f += np.uint32((SINES[i] + fixed[WORDS[i]]) & 0xFFFFFFFF)
        else:
            f += np.uint32(SINES[i])
            f += word
        np.left_shift(f, np.uint32(TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
        f |= g
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    b += np.uint32(START[0])
    return b.byteswap()


def drawn_rows(n: int, seed: int) -> Callable[[int], np.ndarray]:
    """For a replicate, the row that each of ``n`` slots draws."""
    blocks: dict[int, list[Tails]] = {}
    picks = np.empty(n, np.int64)

    def of(replicate: int) -> np.ndarray:
        prefix = f"{seed}:{replicate}:".encode()
        if len(prefix) not in blocks:
            blocks.clear()  # replicates come in order, so an earlier length is done with
            blocks[len(prefix)] = list(tails(n, len(prefix)))
        for tail in blocks[len(prefix)]:
            np.remainder(heads(prefix, tail), np.uint32(n), out=picks[tail.slots], casting="unsafe")
        return picks

    return of


# -- metrics -------------------------------------------------------------------------


@dataclass(frozen=True)
class Ranking:
    """An arm's rows, best score first, and where each distinct score begins; a missing score comes last."""

    order: np.ndarray
    begins: np.ndarray

    @classmethod
    def of(cls, score: pa.ChunkedArray) -> Ranking:
        missing = score.is_null().to_numpy()
        value, code = np.unique(pc.fill_null(score, 0.0).to_numpy(), return_inverse=True)
        code = np.where(missing, 0, code + 1)
        order = np.argsort(-code, kind="stable").astype(np.int32)
        ranked = code[order]
        return cls(order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])))

    def metrics(self, count: np.ndarray, hits: np.ndarray, wanted: Sequence[str], budget: float) -> list[float | None]:
        """The wanted metrics where row i was drawn ``count[i]`` times, ``hits[i]`` of them positives."""
        n, pos = count[self.order], hits[self.order]
        if len(self.begins) < len(self.order):
            n, pos = np.add.reduceat(n, self.begins), np.add.reduceat(pos, self.begins)
        seen, found = np.cumsum(n), np.cumsum(pos)
        total, positives = int(seen[-1]), int(found[-1])
        out: list[float | None] = []
        for name in wanted:
            if name == "auprc":
                out.append(float((pos * (found / np.maximum(seen, 1))).sum() / positives))
            elif name == "auroc":
                negatives = n - pos
                lost = (pos * ((seen - n) - (found - pos) + 0.5 * negatives)).sum()
                out.append(float(1.0 - lost / (positives * (total - positives))))
            else:
                most = max(1, math.ceil(budget * total))
                room = np.clip(most - (seen - n), 0, n)
                out.append(1.0 if most >= total else float((pos * (room / np.maximum(n, 1))).sum() / positives))
        return out


KNOWN = ("auprc", "auroc", "recall_at_budget")


def replicate_values(
    numbered: DataFrame, keys: Sequence[str], arms: Sequence[str], metrics: Sequence[str], resamples: int, seed: int, budget: float
) -> DataFrame:
    """(keys, arm, replicate, metrics) of rows with ``idx``, ``n_rows`` and ``y``; one-class resamples give no row.

    ``n_rows`` is at most ``DENSE_ROWS``. Replicates are dealt into chunks, and each chunk gets the rows of a key once.
    """
    unknown = sorted(set(metrics) - set(KNOWN))
    if unknown:
        raise ValueError(f"unknown metric {unknown[0]!r}; known: {sorted(KNOWN)}")
    keys, arms, metrics = list(keys), list(arms), list(metrics)
    chunks = min(resamples, CHUNKS_PER_CORE * numbered.sparkSession.sparkContext.defaultParallelism)
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    score = [F.col(a).cast("double").alias(a) for a in arms]
    rows = numbered.select(*keys, every, F.col("idx").cast("int"), F.coalesce(F.col("y").cast("tinyint"), F.lit(0).cast("tinyint")).alias("y"), *score)
    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    names = [*keys, "arm", "replicate", *metrics]

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table.column("idx")))
        y = table.column("y").to_numpy().astype(np.int64)
        ranked = [Ranking.of(table.column(a)) for a in arms]
        draw = drawn_rows(len(y), seed)
        own: list[tuple] = []
        for replicate in range(table.column("chunk")[0].as_py(), resamples, chunks):
            count = np.bincount(draw(replicate), minlength=len(y))
            hits = count * y
            if 0 < hits.sum() < len(y):
                own += [(arm, replicate, *ranking.metrics(count, hits, metrics, budget)) for arm, ranking in zip(arms, ranked)]
        head = [pa.array([table.column(k)[0].as_py()] * len(own), table.schema.field(k).type) for k in keys]
        kinds = [pa.string(), pa.int32(), *[pa.float64()] * len(metrics)]
        return pa.table([*head, *(pa.array([r[i] for r in own], kind) for i, kind in enumerate(kinds))], names=names)

    spread = rows.repartition(chunks, *keys, "chunk")
    return spread.groupBy(*keys, "chunk").applyInArrow(run, f"{kinds}arm string, replicate int, " + ", ".join(f"{m} double" for m in metrics))
