"""Long repeated byte strings by run-length indexes over repetitive shards.

Seeds deal the corpus into shards: all pieces of text around one seed, folded to different
contents (see ``passages``), go to one shard, so every repeated string of ``WIDTH`` bytes lies
whole in a shard with all of its other copies. A shard is highly repetitive; its index is a
run-compressed Burrows-Wheeler transform with, for each run, its head, start and mapped row,
and for each class of rows that share ``WIDTH`` bytes the least text position as its sample.
Each content's matching statistics are streamed backwards through the index, many contents
at once, and windows whose class has an earlier sample are marked.

A seed with over ``SHARD`` contents would make a shard without a bound; its windows are
matched one by one in a grouped aggregate instead, with equal results.

Cases: a null or empty text has no bytes; a text shorter than the width loses nothing;
strings are ordered by id (null last), then by the hash of the text, then by place, so
rows that share an id are ordered by their texts' hashes, and equal rows are one text
and treated alike; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import settle
from .passages import Unit, Windows, byte_codes, contents, contested, covered, extended, list_ints, passed, pieces, rivals, rows_of, seed_filter, with_ranges

WIDTH, GRAM = 100, 48
SHARD, BLOCK_BYTES = 4096, 1 << 19
_U = np.uint64


def suffix_ranks(codes: np.ndarray, enough: int) -> np.ndarray:
    """Rank of every suffix by its first ``enough`` codes at least: some codes packed into one number, then prefix doubling."""
    n = len(codes)
    bits = max(1, int(codes.max(initial=0) + 1).bit_length())
    size = max(1, 62 // bits)
    pair = np.zeros(n, np.int64)
    for j in range(min(size, n)):
        pair[: n - j] |= (codes[j:] + 1) << (bits * (size - 1 - j))
    while True:
        order = np.argsort(pair)
        ordered = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))[:n]
        if size >= enough or rank.max(initial=0) >= n - 1:
            return rank
        pair = rank * (n + 1)
        pair[: n - size] += rank[size:] + 1
        size *= 2


class RunIndex:
    """An index of a few contents: run-compressed transform, and a sample for each class of equal ``width`` bytes.

    Each content ends in a terminator of its own, in order, so rows and positions
    correspond one to one and no match crosses contents.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, width: int):
        m, n = len(bounds) - 1, len(data) + len(bounds) - 1
        ends = bounds[1:] + np.arange(m)
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = data.astype(np.int64) + m
        text[ends] = np.arange(m)
        rank = suffix_ranks(text, int(np.diff(bounds).max(initial=0)) + 1)
        rows = np.empty(n, np.int64)  # the suffix array; not kept
        rows[rank] = np.arange(n)
        transform = text[rows - 1]
        heads = np.flatnonzero(np.diff(transform, prepend=-1))
        order = np.argsort(transform[heads], kind="stable")
        size = np.diff(np.append(heads, n))
        mapped = np.empty(len(heads), np.int64)
        mapped[order] = np.cumsum(size[order]) - size[order]
        # runs: head symbol, first row, and the row that its first row maps to
        self.head, self.start, self.mapped = transform[heads], heads, mapped
        codes = np.zeros(n + 1, _U)
        np.cumsum(K.mix(text.astype(_U) + _U(1)) * K.powers(K.BASE, n), out=codes[1:])
        far = np.minimum(rows + width, n)
        window = K.mix((codes[far] - codes[rows]) * K.powers(K.BASE_INVERSE, n + 1)[rows])
        first = np.append(True, window[1:] != window[:-1])
        self.sample = np.minimum.reduceat(rows, np.flatnonzero(first))
        # directories: the run and the class of each row of this block, so that a step costs no search
        self.run_of, self.class_of = np.cumsum(np.diff(transform, prepend=-1) != 0) - 1, np.cumsum(first) - 1
        self.terminators, self.lengths, self.begin, self.width = m, np.diff(bounds), bounds[:-1] + np.arange(m), width

    def back(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol before, row of the suffix that starts with it)."""
        run = self.run_of[row]
        return self.head[run], self.mapped[run] + row - self.start[run]

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """(content, offset) of the windows that stand earlier, streaming all contents backwards from their terminators."""
        own, row, left = np.arange(self.terminators), np.arange(self.terminators), self.lengths.copy()
        content, offset = [], []
        while True:
            live = left > 0
            own, row, left = own[live], row[live], left[live] - 1
            if not len(own):
                break
            _, row = self.back(row)
            long = self.lengths[own] - left >= self.width
            earlier = self.sample[self.class_of[row[long]]] < self.begin[own[long]] + left[long]
            content.append(own[long][earlier])
            offset.append(left[long][earlier])
        return (np.concatenate(content), np.concatenate(offset)) if content else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def shard_hits(apart: DataFrame, width: int) -> DataFrame:
    """(seed, content, hits) of contents (seed, content, owner, bytes) through run-length indexes.

    Rows come sorted by seed; an index is built of whole seeds, some hundred thousand
    bytes at a time.
    """
    flat = apart.select("seed", "content", "owner.no_id", "owner.id", "owner.text_hash", "owner.at", "bytes")
    ready = flat.repartition("seed").sortWithinPartitions("seed", "no_id", "id", "text_hash", "at").select("seed", "content", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            seeds = table.column(0).to_numpy()
            data, bounds = K.buffers(table.column(2))
            first = np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1]))
            groups = np.append(first, len(seeds))
            i = 0
            while i < len(first):
                j = int(np.searchsorted(bounds[groups], bounds[groups[i]] + BLOCK_BYTES, "right")) - 1
                j = min(max(j, i + 1), len(first))
                a, b = groups[i], groups[j]
                content, offset = RunIndex(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width).marks()
                order = np.lexsort((offset, content))
                content, offset = content[order], offset[order]
                hit, at = np.unique(content, return_index=True)
                rows = pa.array(hit + a)
                yield pa.RecordBatch.from_arrays(
                    [table.column(0).combine_chunks().take(rows), table.column(1).combine_chunks().take(rows), pa.ListArray.from_arrays(pa.array(np.append(at, len(offset)).astype(np.int32)), pa.array(offset.astype(np.int32)))], names=["seed", "content", "hits"]
                )
                i = j

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]).combine_chunks() if held is not None and held.num_rows else table
            seeds = table.column(0).to_numpy()
            ends = np.flatnonzero(seeds[1:] != seeds[:-1]) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield from solve(table.slice(0, cut).combine_chunks())
            held = table.slice(cut)
        if held is not None and held.num_rows:
            yield from solve(held.combine_chunks())

    return ready.mapInArrow(run, "seed long, content long, hits array<int>")


def window_hashes(apart: DataFrame, unit: Unit) -> DataFrame:
    """Contents with the hash of each of their windows in place of their bytes."""
    flat = apart.select("seed", "content", "owner", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(3))
            w = Windows(unit, data, offsets)
            hashes = w.hash(w.first, w.first + unit.width)
            bounds = np.searchsorted(w.row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))], names=["seed", "content", "owner", "windows"])

    kind = flat.schema["owner"].dataType.simpleString()
    return flat.mapInArrow(run, f"seed long, content long, owner {kind}, windows array<long>")


def _earlier(a, b):
    return a < b


def repeated_ranges(docs: DataFrame, width: int = WIDTH, id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(id, text_hash, ranges) in bytes of every text with strings of ``width`` bytes that start earlier."""
    unit = Unit(byte_codes, width, min(GRAM, width), 1 << 19)
    rows = rows_of(docs, id, text)
    bitmap = seed_filter(rows, unit, per_text=False)
    found = passed(pieces(rows, unit, bitmap), bitmap)
    distinct = settle(contents(found), "contents")
    seeds = settle(contested(distinct), "seeds")
    large = settle(seeds.where(F.col("n") > shard).select("seed"), "large")
    apart = rivals(rows, unit, seeds, "bytes")
    indexed = shard_hits(apart.join(large, "seed", "left_anti"), width)
    matched = extended(window_hashes(apart.join(large, "seed", "left_semi"), unit), _earlier)
    hits = settle(indexed.unionByName(matched), "hits")
    return settle(covered(found, distinct, hits, unit, _earlier), "ranges")


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """Kept columns, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept`` (the bytes left) of every row."""
    rows, names = with_ranges(docs, repeated_ranges(docs, width, id, text, shard), list(keep), id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(len(names)))
            (begin, at), (end, _) = (list_ints(batch.column(len(names) + k)) for k in (1, 2))
            for x, y in K.chunks(offsets, 1 << 20):
                low = offsets[x]
                own = np.repeat(np.arange(x, y), np.diff(at[x : y + 1]))
                part = slice(at[x], at[y])
                # a range of one text never touches the next text's first byte, so all rows are covered at once
                gone = K.ranges_cover(begin[part] + offsets[own] - low, end[part] + offsets[own] - low, int(offsets[y] - low))
                total = np.concatenate([[0], np.cumsum(gone)])
                before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
                firsts = offsets[x:y] - low
                before[firsts[firsts < len(before)]] = False
                edges = np.concatenate([[0], np.cumsum(gone & ~before)])
                bounds = offsets[x : y + 1] - low
                left = data[low : offsets[y]][~gone].tobytes()
                kept = (bounds - total[bounds]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(x, y - x) for k in range(len(names))], *[pa.array(np.diff(v).astype(np.int64)) for v in (bounds, total[bounds], edges[bounds])], pa.array([left[i:j] for i, j in zip(kept[:-1], kept[1:])], pa.binary())],
                    names=[*names, "n_bytes", "n_removed", "n_spans", "kept"],
                )

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(names)])
    made = rows.mapInArrow(run, f"{kinds}n_bytes long, n_removed long, n_spans long, kept binary")
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_bytes", "n_removed", "n_spans", "kept")
