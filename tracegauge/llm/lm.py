"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end per text. Corpus counts of all training tokens
give a smoothed unigram base. The neural model predicts a token's class from the two
before it: the ``SHORTLIST`` most frequent words and the end are classes of their own,
every other word belongs to one of ``BUCKETS`` classes by its first bytes and is drawn
within its class by smoothed counts, so the whole is a normalised distribution over all
words. Class vectors are trained in numpy: a warm start on a bounded sample (``WARM_TOKENS`` tokens spread
over each of ``WARM_DOCS`` whole texts), then one pass
over every training document, each task from the warm start, averaged by tokens. With
two context tokens there are CLASSES ** 2 contexts, whose normalisers are one table of
batched matrix products; it, the class vectors and at most ``FREQUENT`` of the most frequent words (of at most
``LONGEST`` bytes, down to a level of their counts) are broadcast, and their size does not
depend on the corpus.
Counts of all other words meet the documents in a join.

Cases: a null or empty text is one end token; rows with a null doc_id are scored but teach
nothing; repeated rows count and are scored each; without training rows every token has
base log10(1) and score equals it; an empty table gives no rows; other columns are not
looked at; a word of any length counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K
from .common import settle

SHORTLIST, BUCKETS = 767, 256
CLASSES, END = SHORTLIST + BUCKETS + 1, SHORTLIST + BUCKETS
FREQUENT, LONGEST, STEM, LEVELS = 131_072, 64, 3, 8
DIMENSIONS, NOISE, BATCH = 20, 48, 4096
WARM_DOCS, WARM_TOKENS, WARM_RATE, RATE = 400, 1500, 0.2, 0.05
COUNTER_WORDS = 200_000
ALPHA = 0.1


def bucket(word: bytes) -> int:
    return SHORTLIST + crc32(word[:STEM]) % BUCKETS


def split(raw: bytes) -> list[bytes]:
    """bytes.lower and bytes.split know exactly A-Z and the six ASCII spaces."""
    return raw.lower().split()


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows; each task sums its own words first, some hundred thousand at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            raw = data.tobytes()
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                held.update(split(raw[a:b]))
                if len(held) > COUNTER_WORDS:
                    yield flush()
        yield flush()

    return docs.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts that every task may hold: the frequent words, totals, and totals of each bucket."""

    words: dict[bytes, int]  # frequent word -> place
    counts: np.ndarray  # by place
    classes: np.ndarray  # by place
    total: int
    distinct: int
    ends: int
    bucket_total: np.ndarray
    bucket_distinct: np.ndarray

    @property
    def below(self) -> float:
        return self.total + ALPHA * (self.distinct + 1)

    def shares(self) -> np.ndarray:
        """Share of each class among the training tokens, never zero."""
        share = np.zeros(CLASSES)
        own = self.classes < SHORTLIST
        share[self.classes[own]] = self.counts[own]
        share[SHORTLIST:END] = self.bucket_total
        share[END] = self.ends
        return (share + ALPHA) / (share + ALPHA).sum()


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    known = counts.where(F.octet_length("word") <= LONGEST).withColumn("level", F.floor(F.log2("n") * LEVELS))
    left, cut = FREQUENT, None
    for r in sorted(known.groupBy("level").agg(F.count("*").alias("v")).collect(), key=lambda r: -r.level):  # some hundred levels at most
        left -= r.v
        if left < 0:
            break
        cut = r.level
    top = sorted(known.where(F.col("level") >= cut).collect(), key=lambda r: (-r.n, bytes(r.word))) if cut is not None else []
    words = {bytes(r.word): i for i, r in enumerate(top)}
    classes = np.array([i if i < SHORTLIST else bucket(w) for i, w in enumerate(words)], np.int64)
    n = np.array([r.n for r in top], np.int64)
    crc = F.crc32(F.substring("word", 1, STEM)) % BUCKETS
    by = counts.groupBy(crc.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    total, distinct = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in by:
        total[r.bucket], distinct[r.bucket] = r.n, r.v
    all_total, all_distinct = int(total.sum()), int(distinct.sum())
    for w, i in list(words.items())[:SHORTLIST]:
        total[bucket(w) - SHORTLIST] -= n[i]
        distinct[bucket(w) - SHORTLIST] -= 1
    return Vocabulary(words, n, classes, all_total + ends, all_distinct + (ends > 0), ends, total, distinct)


def token_classes(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(place among the frequent words or -1, class) of each word."""
    place = np.fromiter(map(vocabulary.words.get, words, [-1] * len(words)), np.int64, len(words))
    known = vocabulary.classes if len(vocabulary.classes) else np.zeros(1, np.int64)
    classes = known[np.maximum(place, 0)]
    for i in np.flatnonzero(place < 0).tolist():
        classes[i] = bucket(words[i])
    return place, classes


def contexts(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two before each token of a text; ends stand before its start."""
    return np.concatenate([[END], classes[:-1]]), np.concatenate([[END, END], classes[:-2]])[: len(classes)]


@dataclass
class LogBilinear:
    """score(w | u, v) = (R[u] * c1 + R[v] * c2) . Q[w] + b[w]."""

    context: np.ndarray  # R (CLASSES, D)
    target: np.ndarray  # Q (CLASSES, D)
    bias: np.ndarray
    weights: np.ndarray  # (2, D)
    squares: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fresh(cls, share: np.ndarray, seed: int = 1) -> LogBilinear:
        r = np.random.default_rng(seed)
        n = len(share)
        draw = lambda: (r.standard_normal((n, DIMENSIONS)) * 0.1).astype(np.float32)
        return cls(draw(), draw(), np.log(share).astype(np.float32), np.ones((2, DIMENSIONS), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.bias, self.weights]

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, noise: np.ndarray, share: np.ndarray, rate: float) -> None:
        """One step of noise-contrastive estimation: tell each word from the same noise words (AdaGrad)."""
        if not self.squares:
            self.squares = [np.full_like(p, 0.01) for p in self.parameters()]
        k = len(noise)
        r1, r2, q = self.context[one], self.context[two], self.target[word]
        guess = r1 * self.weights[0] + r2 * self.weights[1]
        qn = self.target[noise]
        odds = (guess * q).sum(1) + self.bias[word] - np.log(k * share[word])
        noisy = guess @ qn.T + (self.bias[noise] - np.log(k * share[noise]))
        up = (1 / (1 + np.exp(odds))).astype(np.float32)
        down = (-1 / (1 + np.exp(-noisy))).astype(np.float32)
        d_guess = up[:, None] * q + down @ qn
        rows = np.concatenate([one, two])
        d_context = _scatter(rows, np.concatenate([d_guess * self.weights[0], d_guess * self.weights[1]]), len(self.bias))
        d_target = _scatter(word, up[:, None] * guess, len(self.bias)) + _scatter(noise, down.T @ guess, len(self.bias))
        d_bias = np.bincount(word, up, len(self.bias)) + np.bincount(noise, down.sum(0), len(self.bias))
        d_weights = np.stack([(d_guess * r1).sum(0), (d_guess * r2).sum(0)])
        for p, g, s in zip(self.parameters(), (d_context, d_target, d_bias, d_weights), self.squares):
            g = (g / len(word)).astype(np.float32) * 30
            s += g * g
            p += rate * g / np.sqrt(s)

    def fit(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, share: np.ndarray, rate: float, seed: int) -> None:
        r = np.random.default_rng(seed)
        edges = np.cumsum(share)
        for i in range(0, len(word), BATCH):
            noise = np.minimum(np.searchsorted(edges, r.random(NOISE)), len(share) - 1)
            self.step(one[i : i + BATCH], two[i : i + BATCH], word[i : i + BATCH], noise, share, rate)

    def normalisers(self) -> np.ndarray:
        """log of the sum over all classes for every pair of context classes, block by block."""
        n = len(self.bias)
        out = np.empty((n, n), np.float32)
        second = self.context * self.weights[1]
        for u in range(n):
            y = (second + self.context[u] * self.weights[0]) @ self.target.T + self.bias
            top = y.max(1, keepdims=True)
            out[u] = top[:, 0] + np.log(np.exp(y - top).sum(1))
        return out

    def log10(self, normalisers: np.ndarray, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        guess = self.context[one] * self.weights[0] + self.context[two] * self.weights[1]
        return ((guess * self.target[word]).sum(1) + self.bias[word] - normalisers[one, two]) / np.log(10)


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[rows[order][first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _stream(batches: Iterator[pa.RecordBatch], words: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Context and target classes of all tokens, some ten thousand at a time."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        data, offsets = K.buffers(batch.column(0))
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            classes = np.append(token_classes(split(raw[a:b]), words)[1], END)
            held.append((*contexts(classes), classes))
            size += len(classes)
            if size >= 8 * BATCH:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def spread_places(n: int) -> np.ndarray:
    """All places of a text of up to ``WARM_TOKENS`` tokens, else as many, spread evenly over the whole of it."""
    return np.arange(n) if n <= WARM_TOKENS else np.linspace(0, n - 1, WARM_TOKENS).astype(np.int64)


def train(docs: DataFrame, words: Vocabulary, id: str = "doc_id", text: str = "text") -> LogBilinear:
    """Warm start on a bounded sample, one averaged pass over all rows of ``docs``."""
    share = words.shares()
    model = LogBilinear.fresh(share)
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(words)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            raw = data.tobytes()
            made = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                classes = np.append(token_classes(split(raw[a:b]), known.value)[1], END)
                at = spread_places(len(classes))
                made.append(np.stack([*contexts(classes), classes])[:, at].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["classes"])

    own = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    ids = own.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(WARM_DOCS)
    sample = own.join(F.broadcast(ids), "id", "left_semi").select("text").mapInArrow(first, "classes binary").orderBy(F.xxhash64("classes"), "classes").limit(WARM_DOCS).collect()
    texts = [np.frombuffer(bytes(r.classes), "<i2").astype(np.int64).reshape(3, -1) for r in sample]
    if texts:
        parts = list(np.concatenate(texts, axis=1))
        for epoch in range(3):
            at = np.random.default_rng(epoch).permutation(len(parts[0]))
            model.fit(*[p[at] for p in parts], share, WARM_RATE, seed=epoch)
    warm = sc.broadcast(model.parameters())
    columns = [f"d{i}" for i in range(DIMENSIONS)]

    def one_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tokens = LogBilinear(*[p.copy() for p in warm.value]), 0
        for i, (one, two, word) in enumerate(_stream(batches, known.value)):
            own.fit(one, two, word, share, RATE, seed=i)
            tokens += len(word)
        if tokens:
            side = np.zeros((-(-CLASSES // DIMENSIONS) * DIMENSIONS,), np.float32)
            side[:CLASSES] = own.bias
            flat = np.concatenate([own.context, own.target, own.weights, side.reshape(-1, DIMENSIONS)]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), float(tokens))), *map(pa.array, flat.T)], names=["row", "tokens", *columns])

    passed = own.select("text").mapInArrow(one_pass, "row long, tokens double, " + ", ".join(f"{c} double" for c in columns))
    mean = passed.groupBy("row").agg(*[(F.sum(F.col(c) * F.col("tokens")) / F.sum("tokens")).alias(c) for c in columns]).collect()  # a fixed number of rows
    if mean:
        flat = np.array([[r[c] for c in columns] for r in sorted(mean, key=lambda r: r.row)], np.float32)
        n = CLASSES
        model = LogBilinear(flat[:n], flat[n : 2 * n], flat[2 * n + 2 :].ravel()[:n], flat[2 * n : 2 * n + 2])
    return model


def score(docs: DataFrame, teaches: Column, keep: tuple[str, ...] = ("doc_id",), id: str = "doc_id", text: str = "text") -> DataFrame:
    """Kept columns, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    The model learns from all rows where ``teaches`` holds.
    """
    training = docs.where(teaches)
    counts = settle(count_words(training, text), "words")
    words = vocabulary(counts, training.count())
    sc = docs.sparkSession.sparkContext
    if words.total:
        model = train(training, words, id, text)
    else:
        model = LogBilinear.fresh(words.shares())
    known, table = sc.broadcast(words), sc.broadcast((model, model.normalisers()))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("__body"))
    kept = rows.columns[:-1]
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    rare_type = pa.struct([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (model, normalisers) = known.value, table.value
        sizes = np.log10(words.bucket_total + ALPHA * (words.bucket_distinct + 1))
        own = np.log10(words.counts + ALPHA) if len(words.counts) else np.zeros(1)
        for batch in batches:
            data, offsets = K.buffers(batch.column(len(kept)))
            for a, b in K.chunks(offsets):
                base, neural, tokens, n_known, rare, ends = [], [], [], [], [], [0]
                for i in range(a, b):
                    texts = split(data[offsets[i] : offsets[i + 1]].tobytes())
                    place, classes = token_classes(texts, words)
                    classes = np.append(classes, END)
                    seen = np.maximum(place[place >= 0], 0)
                    log_counts = own[seen]
                    drawn = classes[:-1] >= SHORTLIST
                    y = model.log10(normalisers, *contexts(classes), classes).sum(dtype=np.float64)
                    y += log_counts[drawn[place >= 0]].sum() - sizes[classes[:-1][drawn] - SHORTLIST].sum()
                    others = Counter(texts[j] for j in np.flatnonzero(place < 0).tolist())
                    rare.extend(others.items())
                    ends.append(len(rare))
                    base.append(log_counts.sum() + np.log10(words.ends + ALPHA))
                    neural.append(y)
                    tokens.append(len(classes))
                    n_known.append(len(seen) + (words.ends > 0))
                listed = pa.StructArray.from_arrays([pa.array([w for w, _ in rare], pa.binary()), pa.array([n for _, n in rare], pa.int64())], fields=list(rare_type))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(a, b - a) for i in range(len(kept))], pa.array(tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(neural, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed)],
                    names=[*kept, "n_tokens", "known", "base", "neural", "rare"],
                )

    made = rows.mapInArrow(run, f"{kinds}n_tokens long, known long, base double, neural double, rare array<struct<word: binary, n: long>>")
    made = settle(made.withColumn("__row", F.monotonically_increasing_id()), "scores")
    rare = made.select("__row", F.explode("rare").alias("r")).select("__row", "r.word", "r.n")
    met = rare.join(counts.withColumnRenamed("n", "c"), "word", "left").groupBy("__row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + ALPHA)).alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known")
    )
    logs = F.coalesce("rare_logs", F.lit(0.0))
    base = F.col("base") + logs - F.col("n_tokens") * F.lit(float(np.log10(words.below)))
    return made.join(met, "__row", "left").select(
        *[F.col(k).alias(c) for k, c in zip(kept, keep)],
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (F.col("neural") + logs if words.total else base).alias("score"),
    )
