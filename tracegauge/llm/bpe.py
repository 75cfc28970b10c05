"""Byte-level BPE encoding and decoding with a public vocabulary file.

Encoding keeps a priority queue of merge ranks over a doubly linked list of symbols: the
lowest rank, leftmost first, is merged; entries whose symbols have changed since are
stale and skipped. Decoding concatenates vocabulary strings. Equal words are merged once
per worker (a cache with a bound).

Cases: a null or empty text has no ids and decodes to the empty text; every row gives a
row, whatever its ``doc_id``; repeated rows repeat; an empty table gives an empty table;
other columns of the input are not looked at; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

CACHE_WORDS = 400_000
DECODE_IDS = 1 << 18
# The published split pattern of byte-level BPE vocabularies. \s is spelled out, because
# it must not hold the separators U+001C to U+001F.
SPACES = r"\t-\r \x85\xA0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec(dict):
    """Maps a word to its packed ids (little-endian unsigned 32-bit); fills itself."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        stand_in = byte_characters()
        vocabulary = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings: dict[int, bytes] = {i: bytes(stand_in[c] for c in s) for s, i in vocabulary.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.first = [0] * 256
        for c, b in stand_in.items():
            self.first[b] = vocabulary[c]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[a] << 32 | vocabulary[b]] = rank
            self.merged.append(vocabulary[a + b])
        self.words = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        symbols = [self.first[b] for b in word]
        n = len(symbols)
        ranks, merged, push, pop = self.ranks, self.merged, heapq.heappush, heapq.heappop
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = [r * n + i for i in range(n - 1) if (r := ranks.get(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(pop(queue), n)
            j = after[i]
            if symbols[i] < 0 or j >= n or ranks.get(symbols[i] << 32 | symbols[j]) != rank:
                continue  # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = merged[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    push(queue, r * n + i)
            h = before[i]
            if h >= 0 and (r := ranks.get(symbols[h] << 32 | symbols[i])) is not None:
                push(queue, r * n + h)
        return [s for s in symbols if s >= 0]

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.merge(word.encode()), "<u4").tobytes()
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; the strings of special tokens become their ids."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out.extend(map(self.__getitem__, self.words.findall(part)))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4")
        pieces = [b"".join(map(self.strings.__getitem__, ids[i : i + DECODE_IDS].tolist())) for i in range(0, len(ids), DECODE_IDS)]
        return b"".join(pieces).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(raw: bytes) -> Codec:
    """One codec per vocabulary and worker process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def encode_decode(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Kept columns, ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit) and ``decoded`` of every row.

    ``vocabulary`` names a file on the driver's machine; its bytes (some megabytes,
    whatever the corpus) are broadcast.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(data, offsets):
        own = codec(shared.value)
        raw = data.tobytes()
        ids = [own.encode(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:])]
        return [np.array([len(x) // 4 for x in ids], np.int64), pa.array(ids, pa.binary()), pa.array([own.decode(x) for x in ids], pa.string())]

    return map_texts(docs, list(keep), text, run, "n_tokens long, ids binary, decoded string")
