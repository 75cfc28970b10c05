"""Benchmark decontamination by winnowing.

Every window of ``WINDOW`` item words is represented by the least hash of its ``GRAM``-word
grams, so two equal windows always agree on it: any shared span of ``WINDOW`` words is found.
Document windows whose fingerprint occurs in the benchmark (a bitmap of fixed size) are
hits of the seed; they are extended to their whole word sequence and joined with the
item windows exactly.

Cases: null and empty texts have no words, items without words have no window; an item of
fewer words than a window is one window of its own length; every document row gives a row,
with its own counts if a ``doc_id`` is null or repeats; equal items each count, an item_id
counts once; items with a null item_id mark words but are not counted or listed; an empty
benchmark hits nothing; other columns are not looked at; the order of rows does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import kernels as K
from .common import settle, slot_bitmap

WINDOW, GRAM, BITS = 10, 5, 24


def _words(data: np.ndarray, offsets: np.ndarray):
    """(lowered bytes, starts, ends, counts, hashes) of the words of a chunk."""
    low = K.LOWER[data]
    starts, ends, counts = K.spans(low, offsets, K.NOT_WORD)
    return low, starts, ends, counts, K.span_hash(K.prefix_hash(low), starts, ends)


def _fingerprints(codes: np.ndarray, length: int, window: int) -> np.ndarray:
    """Fingerprint of every ``length`` words in a row: winnowed for whole windows, the words' own hash for short items."""
    if length < window:
        return K.gram_hash(codes, length, salt=length)
    k = min(GRAM, window)
    return K.sliding_min(K.gram_hash(codes, k, salt=window), window - k + 1)


def _window_bytes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, length: int) -> list[bytes]:
    raw = low.tobytes()
    return [b" ".join([raw[starts[j] : ends[j]] for j in range(i, i + length)]) for i in first.tolist()]


def item_windows(items: DataFrame, window: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Item, window length, word sequence and fingerprint of every window of the benchmark."""
    rows = items.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b in K.chunks(offsets):
                low, starts, ends, counts, codes = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for length in range(1, window + 1):
                    first, row = K.row_windows(counts, length)
                    own = np.ones(len(first), bool) if length == window else counts[row] == length
                    first, row = first[own], row[own]
                    prints = _fingerprints(codes, length, window)[first] if len(first) else np.zeros(0, np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(np.full(len(first), length, np.int32)), pa.array(_window_bytes(low, starts, ends, first, length), pa.binary()), pa.array(prints.view(np.int64))],
                        names=["item", "length", "words", "print"],
                    )

    return rows.mapInArrow(run, "item string, length int, words binary, print long")


def candidates(docs: DataFrame, bitmap, lengths: list[int], window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per document row: kept columns, ``n_words``, and the windows whose fingerprint the benchmark may hold."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    found = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(len(keep)))
            for a, b in K.chunks(offsets):
                low, starts, ends, counts, codes = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                base = np.cumsum(counts) - counts
                at, size, words, rows_of = [], [], [], []
                for length in lengths:
                    first, row = K.row_windows(counts, length)
                    if not len(first):
                        continue
                    prints = _fingerprints(codes, length, window)[first]
                    hit = K.has_bits(bitmap.value, (prints >> np.uint64(64 - BITS)).astype(np.int64))
                    first, row = first[hit], row[hit]
                    words += _window_bytes(low, starts, ends, first, length)
                    at.append(first - base[row])
                    rows_of.append(row)
                    size.append(np.full(len(first), length))
                row = np.concatenate(rows_of) if rows_of else np.zeros(0, int)
                order = np.argsort(row, kind="stable")
                listed = pa.StructArray.from_arrays(
                    [pa.array((np.concatenate(x) if x else np.zeros(0))[order].astype(np.int32)) for x in (at, size)] + [pa.array(words, pa.binary()).take(pa.array(order))], fields=list(found)
                )
                bounds = np.searchsorted(row[order], np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in range(len(keep))], pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), listed)], names=[*keep, "n_words", "found"]
                )

    return rows.mapInArrow(run, f"{kept}n_words long, found array<struct<at: int, length: int, words: binary>>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Kept columns of every document row with ``n_words``, ``n_hit`` (words inside any benchmark window) and ``items`` (sorted ids, as strings)."""
    known = settle(item_windows(items, window), "items")
    bitmap = slot_bitmap(known, "print", BITS)
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most ``window`` numbers
    base = settle(candidates(docs, bitmap, lengths, window, keep, text).withColumn("__row", F.monotonically_increasing_id()), "windows")
    seen = base.select("__row", F.explode("found").alias("f")).select("__row", "f.at", "f.length", "f.words")
    hits = settle(seen.join(known.select("words", "length").distinct(), ["words", "length"]), "hits")
    ordered = W.partitionBy("__row").orderBy("at", "length")
    end = F.col("at") + F.col("length")
    reach = F.coalesce(F.max(end).over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = hits.select("__row", F.greatest(F.lit(0), end - F.greatest("at", reach)).alias("n")).groupBy("__row").agg(F.sum("n").alias("n_hit"))
    named = known.where("item is not null").select("words", "length", "item").distinct()
    listed = hits.select("__row", "words", "length").distinct().join(named, ["words", "length"]).groupBy("__row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.drop("found").join(covered, "__row", "left").join(listed, "__row", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
