"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of ``STEPS`` bytes in both directions, labels every position,
and a document's probabilities are the mean over all of its positions. It is trained in
numpy by backpropagation through time on a bounded sample: at most ``SAMPLE_DOCS``
documents of each language (the least hashes of their ids) and ``SAMPLE_WINDOWS`` windows spread over each,
however many languages there are, so that no language is crowded out. Every byte of every document is labelled.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows with a null
lang, or a null doc_id, teach nothing; without training rows every text is ``und``; every
row gives a row, repeated ones too; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import kernels as K
from .common import map_texts

STEPS, HIDDEN = 64, 8
SAMPLE_DOCS, SAMPLE_WINDOWS = 400, 6
SAMPLE_SPARE = 1.5
EPOCHS, BATCH, RATE = 5, 128, 0.02
SCORE_BATCH = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """One table of byte inputs and one recurrence per direction and gate, and a layer over both states.

    Gates are update, reset and candidate. The first two are clipped to 0..1 and the
    candidate is x / (1 + |x|), which numpy evaluates far faster than exponentials.
    """

    inputs: np.ndarray  # (2 directions, 3 gates, 256, H)
    recur: np.ndarray  # (2, 3, H, H)
    out: np.ndarray  # (2H, L)
    bias: np.ndarray  # (L,)
    labels: list[str]

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.3).astype(np.float32)
        inputs, recur = draw(2, 3, 256, hidden), draw(2, 3, hidden, hidden)
        inputs[:, :2] = 0.3 * inputs[:, :2] + 0.5
        recur[:, :2] *= 0.3
        return cls(inputs, recur, draw(2 * hidden, len(labels)), np.zeros(len(labels), np.float32), labels)

    def states(self, x: np.ndarray, way: int, kept: list | None = None) -> np.ndarray:
        """States after each step (steps, batch, H); x is (steps, batch) and way 1 reads backwards."""
        steps, batch = x.shape
        at = x.astype(np.intp)
        (in_z, in_r, in_n), (to_z, to_r, to_n) = self.inputs[way], self.recur[way]
        state = np.zeros((batch, to_z.shape[0]), np.float32)
        out = np.empty((steps, *state.shape), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            z = np.take(in_z, at[t], axis=0)
            z += state @ to_z
            np.clip(z, 0, 1, out=z)
            r = np.take(in_r, at[t], axis=0)
            r += state @ to_r
            np.clip(r, 0, 1, out=r)
            drive = state @ to_n
            new = np.take(in_n, at[t], axis=0)
            new += r * drive
            new /= 1 + np.abs(new)
            before, state = state, new + z * (state - new)
            out[t] = state
            if kept is not None:
                kept.append((t, before, z, r, new, drive))
        return out

    def probabilities(self, x: np.ndarray, both: tuple | None = None) -> np.ndarray:
        """(steps, batch, L) probabilities of every position."""
        h = self.out.shape[0] // 2
        forward, backward = both or (self.states(x, 0), self.states(x, 1))
        y = forward @ self.out[:h]
        y += backward @ self.out[h:]
        y += self.bias
        y -= y.max(-1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(-1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, seen: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over the seen positions and its gradients, through time."""
        h = self.out.shape[0] // 2
        kept: tuple[list, list] = ([], [])
        both = tuple(self.states(x, way, kept[way]) for way in (0, 1))
        y = self.probabilities(x, both)
        weight = (seen / max(seen.sum(), 1)).astype(np.float32)
        place = np.broadcast_to(label[None, :, None], (*x.shape, 1))
        own = np.take_along_axis(y, place, 2)
        loss = float(-(weight * np.log(own[..., 0] + 1e-9)).sum())
        np.put_along_axis(y, place, own - 1, 2)
        y *= weight[..., None]
        flat = y.reshape(-1, y.shape[-1])
        d_out = np.concatenate([b.reshape(-1, h).T @ flat for b in both])
        d_in, d_recur = np.zeros_like(self.inputs), np.zeros_like(self.recur)
        for way in (0, 1):
            towards = y @ self.out[way * h : way * h + h].T
            back = np.zeros(towards.shape[1:], np.float32)
            deltas: tuple[list, list, list] = ([], [], [])
            for t, before, z, r, new, drive in reversed(kept[way]):
                back = back + towards[t]
                d_new = back * (1 - z) * (1 - np.abs(new)) ** 2
                d_z = back * (before - new) * ((z > 0) & (z < 1))
                d_r = d_new * drive * ((r > 0) & (r < 1))
                d_drive = d_new * r
                back = back * z
                for gate, (d, through) in enumerate(((d_z, d_z), (d_r, d_r), (d_new, d_drive))):
                    d_recur[way, gate] += before.T @ through
                    back += through @ self.recur[way, gate].T
                    deltas[gate].append(d)
            code = np.concatenate([x[k[0]] for k in reversed(kept[way])])
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order].astype(int), prepend=-1))
            for gate in range(3):
                d_in[way, gate][code[order][first]] = np.add.reduceat(np.concatenate(deltas[gate])[order], first, axis=0)
        return loss, [d_in, d_recur, d_out, flat.sum(0)]

    def fit(self, x: np.ndarray, sizes: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> list[float]:
        """Adam over shuffled batches; x is (windows, steps). Returns the loss of each epoch."""
        r = np.random.default_rng(seed)
        own = [self.inputs, self.recur, self.out, self.bias]
        first, second, step, losses = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own], 0, []
        for epoch in range(epochs):
            total, batches = 0.0, np.array_split(r.permutation(len(x)), max(1, -(-len(x) // BATCH)))
            for at in batches:
                loss, grads = self.gradients(x[at].T, np.arange(x.shape[1])[:, None] < sizes[at][None, :], label[at])
                total, step = total + loss, step + 1
                scale = min(1.0, 1.0 / (sum(float((g * g).sum()) for g in grads) ** 0.5 + 1e-9))
                rate = RATE * (0.5**epoch) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, g, m, v in zip(own, grads, first, second):
                    g = g * scale
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            losses.append(total / len(batches))
        return losses


def windows(data: np.ndarray, offsets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, sizes, row) of the consecutive windows that cut each row."""
    sizes = np.diff(offsets)
    n = -(-sizes // steps)
    row = np.repeat(np.arange(len(n)), n)
    starts = offsets[row] + steps * (np.arange(len(row)) - (np.cumsum(n) - n)[row])
    return starts, np.minimum(steps, offsets[row + 1] - starts), row


def _cut(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, steps: int) -> np.ndarray:
    at = np.minimum(starts[:, None] + np.arange(steps), len(data) - 1)
    return np.where(np.arange(steps) < sizes[:, None], K.LOWER[data[at]], 0)


def sample(docs: DataFrame, teaches: Column, id: str, text: str, lang: str) -> DataFrame:
    """The bounded training sample: (lang, text) of the documents with the least hashes in each language."""
    rows = docs.where(teaches & F.col(f"`{lang}`").isNotNull() & F.col(f"`{id}`").isNotNull())
    ids = rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang")).distinct()
    # a share a little over what is wanted goes on to the sort, however many documents a language has
    share = F.lit(2.0 * SAMPLE_SPARE * SAMPLE_DOCS) / F.col("n") - 1.0
    near = ids.join(ids.groupBy("lang").agg(F.count("*").alias("n")), "lang").where(F.xxhash64("id") / float(1 << 63) <= share)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))).where(F.col("rank") <= SAMPLE_DOCS)
    chosen = ranked.select("id", "lang")
    own = rows.select(F.col(f"`{id}`").alias("id"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    return own.join(F.broadcast(chosen), ["id", "lang"])


def train(docs: DataFrame, teaches: Column, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network fitted on the sample of the rows where ``teaches`` holds; None without any."""

    def cut(batches):
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            starts, sizes, row = windows(data, offsets)
            n = np.bincount(row, minlength=batch.num_rows)
            nth = np.arange(len(row)) - (np.cumsum(n) - n)[row] if len(row) else row
            spread = (nth * SAMPLE_WINDOWS) // np.maximum(n[row], 1) != ((nth - 1) * SAMPLE_WINDOWS) // np.maximum(n[row], 1)
            made = _cut(data, starts[spread], sizes[spread], STEPS) if spread.any() else np.zeros((0, STEPS), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[spread])), pa.array([w.tobytes() for w in made.astype(np.uint8)], pa.binary()), pa.array(sizes[spread].astype(np.int32))], names=["lang", "bytes", "size"])

    pieces = sample(docs, teaches, id, text, lang).select("lang", "text").mapInArrow(cut, "lang string, bytes binary, size int")
    rows = pieces.orderBy(F.xxhash64("bytes"), "bytes", "lang").collect()  # at most 160 KB a language
    if not rows:
        return None
    labels = sorted({r.lang for r in rows})
    net = Network.fresh(labels)
    x = np.frombuffer(b"".join(bytes(r.bytes) for r in rows), np.uint8).reshape(-1, STEPS)
    net.fit(x, np.array([r.size for r in rows]), np.array([labels.index(r.lang) for r in rows]))
    return net


def label_texts(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, L) mean probabilities over all bytes of each row; zero for an empty one."""
    starts, sizes, row = windows(data, offsets)
    total = np.zeros((len(offsets) - 1, len(net.labels)))
    for i in range(0, len(starts), SCORE_BATCH):
        own = slice(i, i + SCORE_BATCH)
        p = net.probabilities(np.ascontiguousarray(_cut(data, starts[own], sizes[own], STEPS).T))
        p *= (np.arange(STEPS)[:, None] < sizes[own][None, :])[..., None]
        np.add.at(total, row[own], p.sum(0))
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Kept columns, ``lang_pred`` and ``score`` of every row."""
    letters = F.coalesce(F.col(f"`{text}`").cast("string").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(data, offsets):
        own = shared.value
        p = label_texts(own, data, offsets)
        best = p.argmax(1)
        return [pa.array([own.labels[i] for i in best], pa.string()), np.clip(p[np.arange(len(p)), best], 0.0, 1.0)]

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`"), letters.alias("__letters"))
    made = map_texts(rows, [*keep, "__letters"], text, run, "lang_pred string, score double")
    return made.select(*[F.col(f"`{c}`") for c in keep], F.when(F.col("__letters"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("__letters"), F.col("score")).otherwise(0.0).alias("score"))
