"""Repeated passages by winnowed seeds: which units (words or bytes) stand in a window that also stands earlier.

A window is WIDTH consecutive units of one text. Its seed is the least hash of its k-unit
grams (the leftmost of equal ones), so equal windows have equal seeds at equal places. The
windows that share one occurrence of a seed are a *piece*: at most WIDTH - k + 1 windows,
some two WIDTHs of text. The steps, each a join or a grouped aggregate:

1. ``shared_seeds``: seeds that occur twice or more; as a bitmap of fixed size they filter
   the next steps (a prefilter only: false hits cost work, not results).
2. ``pieces``: the pieces of such seeds. Equal pieces fold to one *content* with its
   earliest owner before anything else is done with them, so hot passages are short.
3. Contents of one seed are extended against each other window by window (the callers
   choose how), which gives the windows of a content that stand in an earlier content.
4. ``covered``: every piece takes all its windows, if an equal piece is earlier, or those
   of step 3; a text gets the ranges of its own units.

Owners are ordered by id (nulls last), then hash of the text, then place. Seeds, pieces
and windows are compared by pairs of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K
from .common import settle, slot_bitmap

BITS = 28
_U = np.uint64
_HIGH = _U(0xFFFFFFFF00000000)


@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``codes(data, offsets) -> (hash per unit, units per row, begin and end byte per unit)``."""

    codes: Callable
    width: int
    gram: int
    chunk: int = K.CHUNK_BYTES


def word_codes(data: np.ndarray, offsets: np.ndarray):
    starts, ends, counts = K.spans(data, offsets, K.SPACE)
    return K.span_hash(K.prefix_hash(data), starts, ends), counts, starts, ends


def byte_codes(data: np.ndarray, offsets: np.ndarray):
    at = np.arange(len(data))
    return K.BYTE_CODES[data], np.diff(offsets), at, at + 1


class Windows:
    """The windows of a chunk of texts and their seeds."""

    def __init__(self, unit: Unit, data: np.ndarray, offsets: np.ndarray):
        codes, self.counts, self.begin, self.end = unit.codes(data, offsets)
        n = len(codes)
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(codes * K.powers(K.BASE, n), out=self.prefix[1:])
        self.inverse = K.powers(K.BASE_INVERSE, n + 1)
        self.first, self.row = K.row_windows(self.counts, unit.width)
        if not len(self.first):
            self.place, self.seed = np.zeros(0, np.int64), np.zeros(0, _U)
            return
        m = n - unit.gram + 1
        grams = K.mix((self.prefix[unit.gram : unit.gram + m] - self.prefix[:m]) * self.inverse[:m])
        keyed = K.sliding_min((grams & _HIGH) | np.arange(m, dtype=_U), unit.width - unit.gram + 1)[self.first]
        self.place = (keyed & ~_HIGH).astype(np.int64)
        self.seed = grams[self.place]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.mix((self.prefix[b] - self.prefix[a]) * self.inverse[a])

    def starts(self) -> np.ndarray:
        """Index of the first window of each piece."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        new = np.ones(len(self.first), bool)
        new[1:] = (self.place[1:] != self.place[:-1]) | (self.row[1:] != self.row[:-1])
        return np.flatnonzero(new)


def passed(found: DataFrame, bitmap) -> DataFrame:
    """The settled pieces; executors need the filter no more."""
    out = settle(found, "pieces")
    bitmap.unpersist()
    return out


def rows_of(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`").cast("string")
    return docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("body"))


def shared_seeds(rows: DataFrame, unit: Unit, per_text: bool) -> DataFrame:
    """(seed) of those that occur twice: in two texts, or, unless ``per_text``, anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for a, b in K.chunks(offsets, unit.chunk):
                w = Windows(unit, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = w.starts()
                seed, row = w.seed[at], w.row[at]
                if per_text:
                    order = np.lexsort((row, seed))
                    new = np.ones(len(order), bool)
                    new[1:] = (seed[order][1:] != seed[order][:-1]) | (row[order][1:] != row[order][:-1])
                    seed = seed[order][new]
                seed, n = np.unique(seed, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n)], names=["seed", "n"])

    return rows.select("body").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")


def seed_filter(rows: DataFrame, unit: Unit, per_text: bool):
    return slot_bitmap(shared_seeds(rows, unit, per_text), "seed", BITS)


def pieces(rows: DataFrame, unit: Unit, bitmap, payload: str | None = None) -> DataFrame:
    """(seed, content, id, text_hash, at, n) of the pieces whose seed passes; with a payload, also their
    ``windows`` (hash of each window) or their ``bytes``."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            for a, b in K.chunks(offsets, unit.chunk):
                own = data[offsets[a] : offsets[b]]
                w = Windows(unit, own, offsets[a : b + 1] - offsets[a])
                at = w.starts()
                size = np.diff(np.append(at, len(w.first)))
                keep = K.has_bits(bitmap.value, (w.seed[at] >> _U(64 - BITS)).astype(np.int64))
                at, size = at[keep], size[keep]
                first, row = w.first[at], w.row[at]
                last = first + size + unit.width - 1
                content = w.hash(first, last)
                base = np.cumsum(w.counts) - w.counts
                of = pa.array(row + a)
                out = [pa.array(w.seed[at].view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of), pa.array((first - base[row]).astype(np.int32)), pa.array(size.astype(np.int32))]
                if payload == "windows":
                    each = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    hashes = w.hash(each, each + unit.width)
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(hashes.view(np.int64))))
                elif payload == "bytes":
                    raw = own.tobytes()
                    out.append(pa.array([raw[i:j] for i, j in zip(w.begin[first].tolist(), w.end[last - 1].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["seed", "content", "id", "text_hash", "at", "n", *([payload] if payload else [])])

    more = {"windows": ", windows array<long>", "bytes": ", bytes binary", None: ""}[payload]
    return rows.mapInArrow(run, f"seed long, content long, id {kind}, text_hash long, at int, n int{more}")


def owner() -> Column:
    return F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("text_hash"), F.col("at"))


def contents(found: DataFrame, *payload: str) -> DataFrame:
    """(seed, content, owner: the earliest, times) of the different pieces, and their payload."""
    return found.groupBy("seed", "content").agg(F.min(owner()).alias("owner"), F.count("*").alias("times"), *[F.first(p).alias(p) for p in payload])


def contested(distinct: DataFrame) -> DataFrame:
    """(seed, n) of the seeds with two contents or more."""
    return distinct.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1")


def rivals(rows: DataFrame, unit: Unit, seeds: DataFrame, payload: str) -> DataFrame:
    """Contents of contested seeds with their payload, which only they need; a few of other seeds may pass the filter."""
    return contents(pieces(rows, unit, slot_bitmap(seeds, "seed", BITS), payload), payload)


def extended(apart: DataFrame, earlier) -> DataFrame:
    """(seed, content, hits: windows of the content that stand in an earlier one) of contents (seed, content, owner, windows).

    ``earlier(least, owner)`` says whether the window's least owner stands before the content's.
    """
    each = apart.select("seed", "content", "owner", F.posexplode("windows").alias("k", "window"))
    least = each.groupBy("seed", "window").agg(F.min("owner").alias("least"), F.count("*").alias("n")).where("n > 1").select("seed", "window", "least")
    hit = each.join(least, ["seed", "window"]).where(earlier(F.col("least"), F.col("owner")))
    return hit.groupBy("seed", "content").agg(F.sort_array(F.collect_set("k")).alias("hits"))


def covered(found: DataFrame, distinct: DataFrame, hits: DataFrame, unit: Unit, earlier) -> DataFrame:
    """(id, text_hash, ranges: [start, end) in units, sorted) of the texts with covered units."""
    told = distinct.select("seed", "content", "owner", "times").join(hits, ["seed", "content"], "left").where("times > 1 or hits is not null").drop("times")
    told = settle(told, "told")  # so that the next join reads two tables, and Spark can split a content that many texts have
    met = found.join(told, ["seed", "content"])
    own = met.select("id", "text_hash", "at", "n", "hits", earlier(F.col("owner"), owner()).alias("copy")).where("copy or hits is not null")
    # windows of a piece lie within one width of each other: the first and the last hit cover what is between
    low = F.when(F.col("copy"), 0).otherwise(F.col("hits")[0])
    high = F.when(F.col("copy"), F.col("n") - 1).otherwise(F.element_at("hits", -1))
    ranges = own.select("id", "text_hash", F.struct((F.col("at") + low).alias("a"), (F.col("at") + high + unit.width).alias("b")).alias("range"))
    return ranges.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set("range")).alias("ranges"))


def with_ranges(docs: DataFrame, ranges: DataFrame, keep: list[str], id: str, text: str) -> tuple[DataFrame, list[str]]:
    """Kept columns (as __keep0...), ``body`` and the texts' ranges."""
    own = docs.select(*[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)], F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("body")).withColumn("__hash", F.xxhash64("body"))
    joined = own.join(ranges, own["__id"].eqNullSafe(ranges["id"]) & (own["__hash"] == ranges["text_hash"]), "left")
    names = [f"__keep{i}" for i in range(len(keep))]
    return joined.select(*names, "body", F.coalesce(F.col("ranges.a"), F.array()).cast("array<int>").alias("a"), F.coalesce(F.col("ranges.b"), F.array()).cast("array<int>").alias("b")), names


def list_ints(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]

