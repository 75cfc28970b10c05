"""Substring dedup by seed and extend: long word sequences that an earlier document has are taken out.

Documents meet on winnowed anchors of ``GRAM`` words; matches are extended to whole windows of
``WINDOW`` words, and the maximal runs of such windows that also stand in a document with a
smaller id are removed (see ``passages``).

Cases: a null or empty text has no words; a text shorter than a window loses nothing; a
null id comes after all others, and null ids do not remove each other, nor do rows with
one id; equal rows are treated alike; an empty table gives no rows; other columns are not
looked at; texts are windows of words however long they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .common import settle
from .passages import Unit, contents, contested, covered, extended, list_ints, passed, pieces, rivals, rows_of, seed_filter, with_ranges, word_codes

WINDOW, GRAM = 13, 5


def _earlier(a, b):
    """The owner a has a smaller id than the owner b; a null id is larger than all."""
    return ~a["no_id"] & (b["no_id"] | (a["id"] < b["id"]))


def repeated_ranges(docs: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, ranges) in words of every text with sequences that start in a document with a smaller id."""
    unit = Unit(word_codes, window, min(GRAM, window), 2 << 20)
    rows = rows_of(docs, id, text)
    bitmap = seed_filter(rows, unit, per_text=True)
    found = passed(pieces(rows, unit, bitmap), bitmap)
    distinct = settle(contents(found), "contents")
    hits = settle(extended(rivals(rows, unit, contested(distinct), "windows"), _earlier), "hits")
    return settle(covered(found, distinct, hits, unit, _earlier), "ranges")


def remove_repeats(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Kept columns, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space) of every row."""
    rows, names = with_ranges(docs, repeated_ranges(docs, window, id, text), list(keep), id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(len(names)))
            (begin, at), (end, _) = (list_ints(batch.column(len(names) + k)) for k in (1, 2))
            for x, y in K.chunks(offsets, 2 << 20):
                n_words, n_gone, kept = [], [], []
                for i in range(x, y):
                    words = data[offsets[i] : offsets[i + 1]].tobytes().split()
                    n_words.append(len(words))
                    gone = K.ranges_cover(begin[at[i] : at[i + 1]], end[at[i] : at[i + 1]], len(words)) if at[i + 1] > at[i] else np.zeros(0, bool)
                    n_gone.append(int(gone.sum()))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if len(gone) else words))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(x, y - x) for k in range(len(names))], pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(names)])
    made = rows.mapInArrow(run, f"{kinds}n_words long, n_removed long, kept string")
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_words", "n_removed", "kept")
