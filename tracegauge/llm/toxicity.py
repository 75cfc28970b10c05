"""Toxicity with gradient-boosted trees over dense text features and isotonic calibration.

A lexicon of terms (whole words, and word beginnings of 4, 5 and 7 bytes) is learned from
labelled documents by log-odds; features are the densities of its bands, their nearness
to second-person words, and the rates of capitals, punctuation and obfuscation. Trees
are Spark ML's; their scores are calibrated by isotonic regression.

Training looks at a bounded sample: the ``SAMPLE`` labelled documents with the least
hashes of their ids, dealt by hash into a part for the lexicon, one for the trees and one
for the calibration, so that no part is judged on terms learned from itself. Every whole
text is scored.

Cases: a null text is empty and an empty one has features zero and a score like any other; labels with a null
toxic or doc_id teach nothing, and of contradicting labels of one doc_id the toxic one
counts; without training rows every score is 0, with one class only it is that class;
every row gives a row, repeated ones too; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K
from .common import map_texts, settle

SAMPLE, LEAST_DOCS, BANDS, NEAR = 20_000, 4, (16, 64, 256), 6
STEMS = (4, 5, 7)
TREES, DEPTH, RATE = 20, 4, 0.3
PARTS, LEXICON_PARTS, TREE_PARTS = 10, 5, 8
# Second-person words of the languages of the corpus, lower case.
SECOND_PERSON = "you your yours yourself u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
# Signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
SIGNS = K.LOWER.copy()
for _sign, _letter in LEET.items():
    SIGNS[ord(_sign)] = ord(_letter)
FEATURES = (
    *[f"{kind}_{band}" for kind in ("word", *[f"stem{n}" for n in STEMS]) for band in BANDS],
    "any_count", "near_second_person", "second_person", "hidden", "hidden_count",
    "capitals", "all_caps", "exclamations", "questions", "punctuation", "repeated_signs", "mixed", "repeated_letters", "log_words", "word_length",
)


def _terms(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings (a shorter word has none: zero)."""
    prefix = K.prefix_hash(low)
    size = ends - starts
    return [K.span_hash(prefix, starts, ends), *[np.where(size > n, K.span_hash(prefix, starts, np.minimum(starts + n, ends)), 0) for n in STEMS]]


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(K.span_hash(K.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])


@dataclass
class Lexicon:
    """Term hashes per kind with their rank (0: the most telling)."""

    terms: list[np.ndarray]  # sorted, one array per kind
    ranks: list[np.ndarray]

    def rank(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """Rank of each hash, or a number past all bands."""
        own = self.terms[kind]
        if not len(own):
            return np.full(len(hashes), BANDS[-1])
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        return np.where(own[at] == hashes, self.ranks[kind][at], BANDS[-1])


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


PERSON = np.sort(np.array([word_hash(w) for w in SECOND_PERSON], np.uint64))
LETTER = K.byte_set((65, 90), (97, 122), (128, 255))
CAPITAL, SMALL, DIGIT, SIGN = K.byte_set((65, 90)), K.byte_set((97, 122), (128, 255)), K.byte_set((48, 57)), K.byte_set((33, 47), (58, 64), (91, 96), (123, 126))


def features(lexicon: Lexicon, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, len(FEATURES)) of a chunk of texts."""
    low = K.LOWER[data]
    starts, ends, counts = K.spans(low, offsets, K.NOT_WORD)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    words, size = np.maximum(counts, 1), np.maximum(np.diff(offsets), 1)
    hashes = _terms(low, starts, ends)
    ranks = [lexicon.rank(k, h) for k, h in enumerate(hashes)]
    made = [_per_row(r < band, bounds) / words for r in ranks for band in BANDS]
    hit = np.min(ranks, axis=0) < BANDS[1]
    person = np.isin(hashes[0], PERSON)
    row = np.repeat(np.arange(len(counts)), counts)
    near = np.zeros(len(hit), bool)
    for step in range(1, NEAR + 1):
        near[step:] |= person[:-step] & (row[step:] == row[:-step])
        near[:-step] |= person[step:] & (row[step:] == row[:-step])
    made += [np.log1p(_per_row(hit, bounds)), _per_row(hit & near, bounds) / words, _per_row(person, bounds) / words]
    s2, e2, n2 = K.spans(SIGNS[data], offsets, K.NOT_WORD)
    b2 = np.concatenate([[0], np.cumsum(n2)])
    changed = np.concatenate([[0], np.cumsum(SIGNS[data] != low)])
    odd = np.flatnonzero(changed[e2] > changed[s2])
    hidden = np.zeros(len(s2), bool)
    if len(odd):
        masked = _terms(SIGNS[data], s2[odd], e2[odd])
        hidden[odd] = np.min([lexicon.rank(k, h) for k, h in enumerate(masked)], axis=0) < BANDS[1]
    n_hidden = _per_row(hidden, b2)
    made += [n_hidden / words, np.log1p(n_hidden)]
    letters = np.maximum(_per_row(LETTER[data], offsets), 1)
    big, digits = np.concatenate([[0], np.cumsum(CAPITAL[data])]), np.concatenate([[0], np.cumsum(DIGIT[data])])
    long = ends - starts
    shouted = (big[ends] - big[starts] == long) & (long > 1)
    n_digits = digits[ends] - digits[starts]
    sign = SIGN[data]
    twice = np.zeros(len(data), bool)
    thrice = np.zeros(len(data), bool)
    if len(data) > 2:
        twice[1:] = sign[1:] & (data[1:] == data[:-1])
        thrice[2:] = LETTER[data[2:]] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
        for flags, back in ((twice, 1), (thrice, 2)):
            for k in range(back):
                at = offsets[:-1] + k
                flags[at[at < len(flags)]] = False
    made += [_per_row(CAPITAL[data], offsets) / letters, _per_row(shouted, bounds) / words, _per_row(data == 33, offsets) / size, _per_row(data == 63, offsets) / size, _per_row(sign, offsets) / size]
    made += [_per_row(twice, offsets) / size, _per_row((n_digits > 0) & (n_digits < long), bounds) / words, _per_row(thrice, offsets) / size, np.log1p(counts), letters / words * (counts > 0)]
    return np.stack(made, 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, teaches: Column, id: str, text: str, label: str, most: int = SAMPLE) -> DataFrame:
    """(text, label, part) of the bounded training sample; its ids are broadcast, so no text is shuffled to find it."""
    own = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    ids = docs.where(teaches).select(F.col(f"`{id}`").alias("id")).where("id is not null").distinct().join(own, "id")
    # a share a little over what is wanted goes on to the sort, however many labels there are
    share = min(1.0, 1.3 * most / max(1, ids.count()))
    ids = ids.where(F.xxhash64("id") <= F.lit(min((1 << 63) - 1, int((2 * share - 1) * (1 << 63))))).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.where(teaches).select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return texts.join(F.broadcast(ids), "id").select("text", "label", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(PARTS)).cast("int").alias("part"))


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """The most telling terms of the rows (text, label): at most the last band of each kind reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            toxic = batch.column(1).to_numpy()
            for a, b in K.chunks(offsets):
                low = K.LOWER[data[offsets[a] : offsets[b]]]
                starts, ends, counts = K.spans(low, offsets[a : b + 1] - offsets[a], K.NOT_WORD)
                row = np.repeat(np.arange(b - a), counts)
                for kind, hashes in enumerate(_terms(low, starts, ends)):
                    pair = np.unique(np.stack([row.astype(np.uint64), hashes], 1)[hashes > 0], axis=0)
                    term, at = np.unique(pair[:, 1], return_inverse=True)
                    y = toxic[a:b][pair[:, 0].astype(int)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(term), kind, np.int32)), pa.array(term.view(np.int64)), pa.array(np.bincount(at, y == 1, len(term)).astype(np.int64)), pa.array(np.bincount(at, y != 1, len(term)).astype(np.int64))],
                        names=["kind", "term", "bad", "good"],
                    )

    n_bad, n_good = (float(x or 0) for x in rows.agg(F.sum((F.col("label") == 1).cast("int")), F.sum((F.col("label") != 1).cast("int"))).first())
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1) * (n_good + 1) / (F.col("good") + 0.5))
    counted = rows.select("text", "label").mapInArrow(count, "kind int, term long, bad long, good long").groupBy("kind", "term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    told = counted.where(F.col("bad") >= LEAST_DOCS).withColumn("weight", F.col("bad") * odds).where(odds > np.log(8.0))
    best = {k: told.where(F.col("kind") == k).orderBy(F.desc("weight"), "term").limit(BANDS[-1]).select("term").collect() for k in range(1 + len(STEMS))}
    terms, ranks = [], []
    for k in range(1 + len(STEMS)):
        hashes = np.array([r.term for r in best[k]], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        terms.append(hashes[order])
        ranks.append(order)
    return Lexicon(terms, ranks)


@dataclass
class Model:
    """A fitted scorer; ``constant`` where the sample had no two classes."""

    lexicon: Lexicon | None = None
    trees: object = None
    calibration: object = None
    constant: float = 0.0

    def raw(self, rows: DataFrame, keep: list[str], text: str) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self.lexicon)

        def run(data, offsets):
            made = features(shared.value, data, offsets)
            return [pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))]

        made = map_texts(rows, keep, text, run, "__features array<double>")
        return made.withColumn("features", array_to_vector("__features")).drop("__features")

    def margin(self, rows: DataFrame) -> DataFrame:
        scored = self.trees.transform(rows)
        return scored.withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction", "features")

    def score(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
        """Kept columns and ``score`` (0 to 1) of every row."""
        names = [f"__keep{i}" for i in range(len(keep))]
        body = names[keep.index(text)] if text in keep else "__body"
        named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], *([] if text in keep else [F.col(f"`{text}`").alias("__body")]))
        back = [F.col(n).alias(c) for c, n in zip(keep, names)]
        if self.trees is None:
            return named.select(*back, F.lit(self.constant).alias("score"))
        made = self.calibration.transform(self.margin(self.raw(named, names, body)))
        return made.select(*back, F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def train(docs: DataFrame, labels: DataFrame, teaches: Column, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit lexicon, trees and calibration on the bounded sample of rows where ``teaches`` holds."""
    rows = settle(labelled_sample(docs, labels, teaches, id, text, label), "sample")
    held = {(r.label, r.role): r.n for r in rows.groupBy("label", (F.col("part") >= LEXICON_PARTS).cast("int").alias("role")).agg(F.count("*").alias("n")).collect()}
    classes = {k[0] for k in held}
    if len(classes) < 2 or len([k for k in held if k[1]]) < 2:
        n = sum(held.values())
        return Model(constant=float(sum(v for k, v in held.items() if k[0] == 1) / n) if n else 0.0)
    model = Model(learn_lexicon(rows.where(F.col("part") < LEXICON_PARTS)))
    # a bounded sample: few partitions keep the many small jobs of the fit short
    ready = settle(model.raw(rows.where(F.col("part") >= LEXICON_PARTS).withColumn("y", F.col("label").cast("double")), ["y", "part"], "text").coalesce(2), "features")
    fit = ready.where(F.col("part") < TREE_PARTS)
    if fit.select("y").distinct().count() < 2:
        fit = ready
    model.trees = GBTClassifier(featuresCol="features", labelCol="y", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, maxBins=64, seed=1).fit(fit)
    last = ready.where(F.col("part") >= TREE_PARTS)
    judged = model.margin(last if last.head(1) else ready)
    model.calibration = IsotonicRegression(featuresCol="margin", labelCol="y").fit(judged.select("margin", "y"))
    return model
