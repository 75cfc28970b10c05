"""Byte-level BPE encoding and decoding by a queue of merge ranks under a hierarchical bitmap.

Each match of the split pattern is encoded alone. A match that is a token as a whole is
that token; else its bytes are a doubly linked list, and each pair of neighbours whose joined bytes
are a token waits in the bucket of that token's rank. A bitmap of two levels marks the
buckets that hold something: find-first-set in the upper word, then in a lower one, gives the
next rank without comparing any entries, so the cost of a merge does not grow with the
length of the match. Entries whose pair has changed since are stale and are skipped.

Equal ranks are merged leftmost first. A bucket is sorted once, when its rank is first
the least: from then until it is empty it can get no new entry, because every pair that
is made meanwhile holds the merged bytes and one neighbour more, so it is a longer token.

Decoding concatenates vocabulary strings with one numpy gather per block of ids.

Cases: a null or empty text has no ids and decodes to the empty string; every row gives a
row, whatever its id; repeated rows repeat; an empty table gives an empty table; columns
that are not kept are not looked at, and kept ones may have any names but those that are
added; a text of any length is encoded whole, in blocks of matches, and a single match of
any length takes some 20 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

CACHE_WORDS = 600_000
CACHED_BYTES = 64
LONG_MATCH = 1 << 12
LONG_TEXT = 1 << 20
BLOCK = 1 << 16
WORD_BITS = 9
WORD_MASK = (1 << WORD_BITS) - 1
BIT = [1 << i for i in range(1 << WORD_BITS)]
NONE = -1


def packed_integers(values: Iterable[int] = ()) -> array:
    return array("i", values)


class RankQueue:
    """Buckets of positions by merge rank and the lower words of their bitmap; empty between two words.

    Positions are kept as their complements, so that the last of a sorted bucket is the
    leftmost. ``kind`` makes a bucket: lists, or packed integers for long words. The loop that
    pushes and pops stands in ``Codec.merge``, as calls would take longer than the steps.
    """

    def __init__(self, ranks: int, kind: Callable[[], list | array] = list):
        self.buckets = [kind() for _ in range(ranks)]
        self.low = [0] * (1 + (ranks >> WORD_BITS))
        self.sorted: set[int] = set()  # ranks whose bucket is in order

    @staticmethod
    def sort(bucket: list | array) -> None:
        if isinstance(bucket, list):
            bucket.sort()
        else:
            np.frombuffer(bucket, np.int32).sort()


class Codec(dict):
    """Maps a match of the pattern to its packed ids (unsigned 32-bit); fills itself, up to a bound."""

    def __init__(self, raw: bytes, pattern: str):
        lines = (line.split() for line in raw.splitlines() if line.strip())
        self.ranks: dict[bytes, int] = {base64.b64decode(token): int(rank) for token, rank in lines}
        # white space of the library's pattern language is the Unicode property, without U+001C to U+001F
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        strings = [b""] * (1 + max(self.ranks.values(), default=-1))
        for token, rank in self.ranks.items():
            strings[rank] = token
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pairs = [self.ranks.get(bytes(divmod(i, 256)), NONE) for i in range(1 << 16)]
        self.short, self.long = RankQueue(len(strings)), RankQueue(len(strings), packed_integers)

    def merge(self, word: bytes) -> array:
        """Ids of one match, by merges alone."""
        n, rank_of, pair_rank = len(word), self.ranks.get, self.pairs
        queue, packed = (self.short, list) if n <= LONG_MATCH else (self.long, packed_integers)
        buckets, low, ordered, high = queue.buckets, queue.low, queue.sorted, 0
        waiting = packed([pair_rank[a << 8 | b] for a, b in zip(word, word[1:])])
        waiting.append(NONE)
        for i, rank in enumerate(waiting):
            if rank >= 0:
                bucket = buckets[rank]
                if not bucket:
                    low[rank >> WORD_BITS] |= BIT[rank & WORD_MASK]
                    high |= 1 << (rank >> WORD_BITS)
                bucket.append(~i)
        after, before = packed(range(1, n + 1)), packed(range(-1, n - 1))
        while high:
            # the first rank that waits: find-first-set in the upper word, then in a lower one
            at = (high & -high).bit_length() - 1
            bits = low[at]
            rank = (at << WORD_BITS) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                if rank not in ordered:
                    ordered.add(rank)
                    queue.sort(bucket)
            else:
                if ordered:
                    ordered.discard(rank)
                low[at] = bits = bits & (bits - 1)
                if not bits:
                    high &= high - 1
            i = ~bucket.pop()
            if waiting[i] != rank:
                continue  # stale: one of the two was merged meanwhile
            gone = after[i]
            waiting[gone] = NONE
            after[i] = k = after[gone]
            made = NONE
            if k < n:
                before[k] = i
                made = rank_of(word[i : after[k]], NONE)
                if made >= 0:
                    bucket = buckets[made]
                    if not bucket:
                        low[made >> WORD_BITS] |= BIT[made & WORD_MASK]
                        high |= 1 << (made >> WORD_BITS)
                    bucket.append(~i)
            waiting[i] = made
            h = before[i]
            if h >= 0:
                waiting[h] = made = rank_of(word[h:k], NONE)
                if made >= 0:
                    bucket = buckets[made]
                    if not bucket:
                        low[made >> WORD_BITS] |= BIT[made & WORD_MASK]
                        high |= 1 << (made >> WORD_BITS)
                    bucket.append(~h)
        ids, i, ranks = array("I"), 0, self.ranks
        while i < n:
            ids.append(ranks[word[i : after[i]]])
            i = after[i]
        return ids

    def __missing__(self, match: str) -> bytes:
        word = match.encode()
        whole = self.ranks.get(word)
        packed = (self.merge(word) if whole is None else array("I", (whole,))).tobytes()
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[match] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; long texts go through in blocks of matches."""
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        out, matches = [], self.split.finditer(text)
        while block := [m.group() for m in islice(matches, BLOCK)]:
            out.append(b"".join(map(self.__getitem__, block)))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> list[np.ndarray]:
        """The bytes of the ids, in blocks."""
        out = []
        for i in range(0, len(ids), BLOCK):
            own = ids[i : i + BLOCK]
            size = self.sizes[own]
            end = np.cumsum(size)
            out.append(self.flat[np.repeat(self.starts[own] - end + size, size) + np.arange(end[-1])])
        return out


_CODECS: dict[str, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One codec per vocabulary, pattern and worker process."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Kept columns, ``ids`` (array of int) and ``decoded`` (binary) of every row.

    ``vocabulary`` names a file of ranks on the driver's machine; its bytes (some
    megabytes, whatever the corpus) are broadcast. ``pattern`` splits the texts.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(data, offsets):
        own = codec(shared.value, pattern)
        raw = data.tobytes()
        packed = [own.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:])]
        ends = np.cumsum([0, *map(len, packed)]) // 4
        ids = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        parts = own.decode(ids)
        decoded = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        sizes = np.concatenate([[0], np.cumsum(own.sizes[ids])])[ends]
        strings = pa.BinaryArray.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(sizes.astype(np.int32)), pa.py_buffer(decoded)])
        return [pa.ListArray.from_arrays(ends.astype(np.int32), ids.astype(np.int32)), strings]

    return map_texts(docs, list(keep), text, run, "ids array<int>, decoded binary")
