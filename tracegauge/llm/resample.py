"""Importance resampling towards a target: hashed n-gram histograms, gains, and a seeded draw without replacement.

Texts are lower-cased (A-Z only) and split by an untrained ``Split`` pre-tokeniser of the
tokenizers library, which returns words with their offsets. Offsets say which document a
word stands in; the words of a chunk, joined by one space, give each word a span of bytes,
and a window of n words is the pair (start of its first, end of its last). The crc32 of
those bytes, modulo the number of buckets, is the window's bucket.

A document's weight is the floored mean of its buckets' gains (a log ratio of the target's and the
corpus's smoothed shares, in thousandths). Adding a Gumbel variable that is a digest of
seed and id and taking the highest scores draws without replacement, in proportion to
the exponential of the weights, whatever the partitions are.

Texts are read once: buckets are written to the shared folder, and histograms, weights
and ranks start there. The histogram (one number a bucket) is the only thing that reaches
the driver. Ranks are running counts over nested cells of (score, id, row), so no task
sorts them all.

Cases: a null, empty or wordless text has no features and weight 0; a null id digests as
the empty string and is the largest of a tie; rows of one id are rows of their own, ranked
in the order they are written in; an empty corpus gives an empty table, an empty target an
empty histogram; kept columns may have any names but those that are added; long texts are
cut between words, with the windows that straddle a cut kept.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tracegauge.operators.running import running_totals

from . import kernels as K
from .common import map_texts, settle

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CUT_BYTES = 1 << 20
LAST = (1 << 63) - 1


def splitter() -> Callable[[str], list[tuple]]:
    """The pre-tokeniser: drops runs of separators, keeps words with their offsets.

    Offsets are asked for in bytes; those in characters take more than half of the library's time.
    """
    from tokenizers import PreTokenizedString, Regex
    from tokenizers.pre_tokenizers import Split

    split = Split(Regex(SEPARATORS), "removed")

    def found(text: str) -> list[tuple]:
        pieces = PreTokenizedString(text)
        split.pre_tokenize(pieces)
        return pieces.get_splits(offset_type="byte")

    return found


def cuts(low: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``CUT_BYTES`` that end between words (a longer word is not cut)."""
    a = 0
    while a < len(low):
        b = min(a + CUT_BYTES, len(low))
        while b < len(low) and not K.NOT_WORD[low[b]]:
            gap = K.NOT_WORD[low[b : b + CUT_BYTES]]
            b += int(gap.argmax()) if gap.any() else len(gap)
        yield a, b
        a = b


def window_buckets(words: list[bytes], rows: np.ndarray, n: int, buckets: int, new: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every run of 1 to ``n`` words of one row that ends at word ``new`` or later."""
    crc = zlib.crc32
    own = np.array([crc(w) for w in words[new:]], np.uint64) % np.uint64(buckets)
    out, of = [own], [rows[new:]]
    if n > 1:
        joined = memoryview(b" ".join(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        start = end - size
    for k in range(2, n + 1):
        first = np.arange(max(0, new - k + 1), max(0, len(words) - k + 1))
        first = first[rows[first] == rows[first + k - 1]]
        pairs = zip(start[first].tolist(), end[first + k - 1].tolist())
        out.append(np.fromiter((crc(joined[a:b]) for a, b in pairs), np.uint64, len(first)) % np.uint64(buckets))
        of.append(rows[first])
    return np.concatenate(out).astype(np.int32), np.concatenate(of)


@dataclass
class Features:
    """Bucket lists of the rows of a chunk of texts."""

    n: int
    buckets: int

    def __post_init__(self):
        self.split = splitter()

    def short(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words per row, buckets, row of each) of whole texts: one call of the pre-tokeniser for all."""
        rows = len(offsets) - 1
        # one line end after each text, so that no word crosses two of them
        parts = np.full(len(low) + rows, 10, np.uint8)
        parts[np.arange(len(low)) + np.repeat(np.arange(rows), np.diff(offsets))] = low
        raw, at = parts.tobytes(), offsets[1:] + np.arange(rows)  # bytes up to each line end
        try:
            text = raw.decode()
        except UnicodeDecodeError:  # replacements have other lengths
            own = [raw[a : b + 1].decode("utf-8", "replace") for a, b in zip([0, *(at[:-1] + 1).tolist()], at.tolist())]
            text, at = "".join(own), np.cumsum([len(x.encode()) for x in own]) - 1
        found = self.split(text)
        row = np.searchsorted(at, np.array([place[0] for _, place, _ in found], np.int64), "right")
        made, of = window_buckets([w.encode() for w, _, _ in found], row, self.n, self.buckets)
        return np.bincount(row, minlength=rows), made, of

    def long(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one text of any length, cut between words."""
        carried: list[bytes] = []
        made, words = [], 0
        for a, b in cuts(low):
            own = [w.encode() for w, _, _ in self.split(low[a:b].tobytes().decode("utf-8", "replace"))]
            words += len(own)
            both = carried + own
            made.append(window_buckets(both, np.zeros(len(both), np.int64), self.n, self.buckets, len(carried))[0])
            carried = both[max(0, len(both) - self.n + 1) :] if self.n > 1 else []
        made = np.concatenate(made) if made else np.zeros(0, np.int32)
        return np.array([words]), made, np.zeros(len(made), np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list:
        low = K.LOWER[data]
        words, made, of = self.long(low) if len(offsets) == 2 and len(low) > CUT_BYTES else self.short(low, offsets)
        order = np.argsort(of, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])
        return [words.astype(np.int64), pa.ListArray.from_arrays(ends.astype(np.int32), made[order])]


_FEATURES: dict[tuple[int, int], Features] = {}  # per worker process


def bucketed(docs: DataFrame, n: int, buckets: int, keep: list[str], text: str = "text") -> DataFrame:
    """Kept columns, ``n_words`` and ``buckets`` (one number a feature) of every row."""

    def run(data, offsets):
        if (n, buckets) not in _FEATURES:
            _FEATURES[n, buckets] = Features(n, buckets)
        return _FEATURES[n, buckets](data, offsets)

    return map_texts(docs, keep, text, run, "n_words long, buckets array<int>")


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket: each task counts its own rows, then a sum over at most ``buckets`` numbers a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, per bucket."""
    k, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighted(rows: DataFrame, gain: np.ndarray, keep: list[str]) -> DataFrame:
    """Kept columns, ``n_features`` and ``weight`` of bucketed rows."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(len(keep))
            size = np.diff(own.offsets.to_numpy().astype(np.int64))
            total = np.concatenate([[0], np.cumsum(shared.value[own.flatten().to_numpy()])])
            end = np.cumsum(size)
            weight = (total[end] - total[end - size]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(size), pa.array(weight)], names=[*keep, "n_features", "weight"])

    return rows.select(*[F.col(f"`{c}`") for c in keep], "buckets").mapInArrow(run, f"{kinds}, n_features long, weight long")


def noise(id: Column, seed: int) -> Column:
    """A Gumbel variable in floored thousandths, from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 2,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 0,
    id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """Id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every row.

    Features are all runs of 1 to ``n`` words. Of the documents of at least
    ``least_words`` words, ``percent`` of a hundred are drawn (rounded down).
    """
    named = docs.select(F.col(f"`{id}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    rows = settle(bucketed(named, n, buckets, ["__id"], "__text").withColumn("__row", F.monotonically_increasing_id()), "buckets")
    wanted = bucketed(target.select(F.col(f"`{target_text}`").alias("__text")), n, buckets, [], "__text")
    gain = gains(histogram(rows, buckets), histogram(wanted, buckets))
    scored = settle(weighted(rows, gain, ["__id", "__row", "n_words"]).withColumn("score", F.col("weight") + noise(F.col("__id"), seed)), "weights")
    able = scored.where(F.col("n_words") >= least_words).withColumns(
        {"__down": -F.col("score"), "__order": F.coalesce(F.col("__id").cast("long"), F.lit(LAST)), "__one": F.lit(1).cast("long")}
    )
    take = able.count() * percent // 100
    # Rows are cut only below whole ids: a cell of rows above them would put a partition before a smaller id.
    cells = [F.shiftright("__down", 8), F.col("__down"), F.col("__order"), F.shiftright("__row", 33)]
    placed = running_totals(able, [], ["__down", "__order", "__row"], ["__one"], cells)
    rank = F.when(F.col("before___one") < take, F.col("before___one") + 1).cast("long")
    columns = ["n_words", "n_features", "weight", "score"]
    drawn = placed.select(F.col("__id").alias(id), *columns, rank.alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select(F.col("__id").alias(id), *columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
