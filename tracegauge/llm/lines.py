"""Line dedup with a log-template tree.

Every line walks a tree of fixed depth: its token count, then its ``LEADING`` tokens, then
the template of the leaf. Tokens with a digit or an @ are variable fields and become a
wildcard; the tokens after the leading ones are cut into ``BLOCKS`` blocks, and besides the
whole line each template with one block as a wildcard is counted, so fields that vary
without digits (names, titles) generalise too. A template is recurring when its first
lines in at least ``LEAST`` documents stand between different neighbours: whole copies of a
document share neighbours and are left to document dedup. A template in at least ``WIDE``
different texts recurs whatever its neighbours are, so that blank lines, the other lines of a
repeated passage and a fixed order of lines hide nothing; whole copies are one text there, near
copies are not. Lines of recurring templates are dropped everywhere but in the document with
the least id that has the template.

A line of under ``SHORTEST`` tokens, or with half of its tokens variable, is no template;
block wildcards need ``GENERAL`` tokens. Templates are compared by 64-bit hashes.

Cases: null and empty texts stay as they are; documents with a null id count but are never
the first; equal rows are treated alike; blank lines stay; a document all of whose lines are
dropped becomes the empty text; an empty table gives an empty table; other columns pass
through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import settle

LEADING, BLOCKS, LEAST, WIDE, SHORTEST, GENERAL = 2, 3, 6, 12, 3, 6
VARIABLE = K.byte_set((48, 57), (64, 64))
_U = np.uint64
_WILD = _U(0x5DEECE66D1CE4E5B)


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line bounds, lines per row): a row of n newlines has n + 1 lines; each bound after the first of a row is past its newline."""
    new = np.flatnonzero(data == 10) + 1
    per_row = np.diff(np.searchsorted(new, offsets, "right")) + 1
    begins = np.sort(np.concatenate([offsets[:-1], new]), kind="stable")
    return np.append(begins, offsets[-1]), per_row


def signatures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(per line and template: hash, zero where there is none; neighbour hash; row; line in row)."""
    bounds, per_row = line_offsets(data, offsets)
    row = np.repeat(np.arange(len(per_row)), per_row)
    nth = np.arange(len(row)) - (np.cumsum(per_row) - per_row)[row]
    starts, ends, _ = K.spans(data, offsets, K.SPACE)
    n = np.diff(np.searchsorted(starts, bounds))
    codes = K.span_hash(K.prefix_hash(data), starts, ends)
    variable = np.concatenate([[0], np.cumsum(VARIABLE[data])])
    wild = variable[ends] > variable[starts]
    codes = np.where(wild, _WILD, codes)
    place = np.concatenate([[0], np.cumsum(n)])
    prefix = np.concatenate([np.zeros(1, _U), np.cumsum(codes * K.powers(K.BASE, len(codes) + 1)[1:])]) if len(codes) else np.zeros(1, _U)
    inverse = K.powers(K.BASE_INVERSE, len(prefix))

    def part(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return K.mix((prefix[b] - prefix[a]) * inverse[a])

    begin, end = place[:-1], place[1:]
    count = K.mix(n.astype(_U) + _U(1))
    whole = K.mix(part(begin, end) + count)
    lead = begin + np.minimum(LEADING, n)
    edges = [lead + (end - lead) * j // BLOCKS for j in range(BLOCKS + 1)]
    blocks = [part(edges[j], edges[j + 1]) for j in range(BLOCKS)]
    leaf = K.mix(part(begin, lead) + count)
    wilds = np.concatenate([[0], np.cumsum(wild)])
    named = (n >= SHORTEST) & (2 * (wilds[end] - wilds[begin]) < n)
    out = [np.where(named, whole, 0)]
    for j in range(BLOCKS):
        total = leaf + _U(j + 1)
        for i in range(BLOCKS):
            if i != j:
                total = K.mix(total * _U(31) + blocks[i])
        out.append(np.where(named & (n >= GENERAL), total, 0))
    first, last = nth == 0, nth == per_row[row] - 1
    before = np.where(first, 0, np.roll(whole, 1))
    after = np.where(last, 0, np.roll(whole, -1))
    return np.stack(out, 1), K.mix(before * _U(3) + after), row, nth


def line_table(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, text_hash, line, templates, firsts, around) of every line with a template; ``firsts`` are templates first met there in its document."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("text_hash"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(2))
            for a, b in K.chunks(offsets):
                made, around, row, nth = signatures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lines = np.flatnonzero(made[:, 0])
                made, around, row, nth = made[lines], around[lines], row[lines], nth[lines]
                flat, line = made.ravel(), np.repeat(np.arange(len(lines)), made.shape[1])
                there = flat > 0
                flat, line = flat[there], line[there]
                order = np.lexsort((line, flat, row[line]))
                new = np.ones(len(order), bool)
                new[1:] = (flat[order][1:] != flat[order][:-1]) | (row[line[order]][1:] != row[line[order]][:-1])
                keep = np.sort(order[new])
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(line[x], np.arange(len(lines) + 1)).astype(np.int32)), pa.array(flat[x].view(np.int64))) for x in (slice(None), keep)]
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(nth.astype(np.int32)), *lists, pa.array(around.view(np.int64))], names=["id", "text_hash", "line", "templates", "firsts", "around"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, line int, templates array<long>, firsts array<long>, around long")


def recurring(lines: DataFrame, least: int = LEAST, wide: int = WIDE) -> DataFrame:
    """(template, first) of the templates met between at least ``least`` different neighbours or in at least ``wide`` different texts."""
    met = lines.select(F.explode("firsts").alias("template"), "around", "id")
    placed = met.groupBy("template", "around").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    counted = placed.groupBy("template").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.min("first").alias("first"))
    counted = settle(counted.where((F.col("n") >= least) | (F.col("rows") >= wide)), "counted")
    few = counted.where(F.col("n") < least).select("template", "first")
    held = lines.select("text_hash", F.explode("firsts").alias("template")).join(few, "template").groupBy("template", "first", "text_hash").count()
    spread = held.groupBy("template", "first").agg(F.count("*").alias("texts")).where(F.col("texts") >= wide)
    return counted.where(F.col("n") >= least).select("template", "first").unionByName(spread.select("template", "first"))


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """All columns of ``docs`` with the lines of recurring templates taken out of ``text``, and ``n_lines`` and ``n_dropped``."""
    lines = settle(line_table(docs, id, text), "lines")
    known = settle(recurring(lines, least), "templates")
    met = lines.select("id", "text_hash", "line", F.explode("templates").alias("template")).join(known, "template").where(~F.col("id").eqNullSafe(F.col("first")))
    gone = met.groupBy("id", "text_hash").agg(F.collect_set("line").alias("__gone"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    key, body = names[docs.columns.index(id)], names[docs.columns.index(text)]
    rows = rows.withColumn("__hash", F.xxhash64(F.col(body).cast("string")))
    joined = rows.join(gone, rows[key].eqNullSafe(gone["id"]) & (rows["__hash"] == gone["text_hash"]), "left")
    split = F.split(F.col(body).cast("string"), "\n", -1)
    kept = F.array_join(F.filter(split, lambda _, i: ~F.array_contains("__gone", i)), "\n")
    none = F.col("__gone").isNull()
    out = [F.when(none, F.col(body)).otherwise(kept).alias(text) if n == body else F.col(n).alias(c) for n, c in zip(names, docs.columns)]
    return joined.select(*out, F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.when(none, 0).otherwise(F.size("__gone")).cast("long").alias("n_dropped"))
