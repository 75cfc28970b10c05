"""Bootstrap draws per distinct (scores, outcome) group instead of per row.

Rows that share their scores and outcome are one group with a count, so a replicate is one
multinomial draw over groups. The draw is split recursively: a node of cells gives its left half
a binomial share of its draws, down to a cell of at most ``CELL`` groups, where one multinomial
finishes it. The generator of a node is seeded by (seed, chunk of replicates, node), so every task that
passes a node draws the same numbers there, and no task needs more than the way to its
own cell. The cost is groups x replicates, whatever the number of rows.

Each cell sends its draws to parts of the rank order of each arm; a second small table has what was drawn before each of those, and each
adds its part of every metric. Both arms of a pair share each draw. No arm, and no replicate of
one, meets in one task.

One arm alone needs no such exchange: its cells follow the rank order, positives and negatives
are split down two trees of their own, and the left halves passed on the way to a cell are what
was drawn before it. So a cell gives its part of every metric by itself, and draws are never
written. A Poisson resample is the same with Poisson totals, whose parts are independent counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .running import running_totals, score_cells

CELL, PART = 4096, 4096
CHUNK = 256
PARTS = {"auprc": "area", "auroc": "lost", "recall_at_budget": "caught"}


def folded_groups(rows: DataFrame, keys: Sequence[str], arms: Sequence[str]) -> DataFrame:
    """(keys, y, arms, n): one row per distinct scores and outcome."""
    return settle(rows.groupBy(*keys, "y", *arms).agg(F.count(F.lit(1)).alias("n")), "groups")


def packed_cells(groups: DataFrame, keys: Sequence[str], arms: Sequence[str]) -> DataFrame:
    """(keys, cell, groups, sizes, edges of each arm): the groups of a cell in one row.

    Groups are dealt into cells by their digests. Beside each cell go the sizes of all cells
    of its key and, per arm, scores that cut the rank order into parts; any cuts are right, so
    approximate quantiles do. Both have one number per ``CELL`` or ``PART`` groups.
    """
    most = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    own = groups.withColumn("cell", F.pmod(F.xxhash64("y", *arms), F.lit(1 + most // CELL)))
    entry = F.struct(F.col("y").cast("int").alias("y"), "n", *arms)
    packed = own.groupBy(*keys, "cell").agg(F.array_sort(F.collect_list(entry)).alias("groups"))
    sizes = own.groupBy(*keys, "cell").agg(F.sum("n").alias("size")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "size"))).alias("sizes"))
    packed = packed.join(sizes, list(keys))
    parts = 1 + most // PART
    if parts == 1:
        return packed.withColumns({f"edges_{a}": F.array().cast("array<double>") for a in arms})
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    edges = groups.groupBy(*keys).agg(*[F.array_distinct(F.percentile_approx(a, shares, F.lit(20 * parts))).alias(f"edges_{a}") for a in arms])
    return packed.join(edges, list(keys))


def way_to(cell: int, upto: np.ndarray, draws: np.ndarray, seed: int, chunk: int) -> np.ndarray:
    """Draws of a cell in each replicate: binomial splits from the root down. ``upto`` counts rows before each cell, and all at the end."""
    low, high = 0, len(upto) - 1
    while high - low > 1:
        middle = (low + high) // 2
        whole = upto[high] - upto[low]
        share = (upto[middle] - upto[low]) / whole
        left = np.random.default_rng([seed, chunk, low, high]).binomial(draws, share)
        draws, low, high = (left, low, middle) if cell < middle else (draws - left, middle, high)
    return draws


def cell_draws(n: np.ndarray, draws: np.ndarray, seed: int, chunk: int, cell: int, poisson: bool = False) -> np.ndarray:
    """(replicates, groups): one multinomial per replicate over the groups of a cell, or a Poisson count of each group's own."""
    rng = np.random.default_rng([seed, chunk, cell, cell, 1])
    return rng.poisson(n, (len(draws), len(n))) if poisson else rng.multinomial(draws, n / n.sum())


def folded_by_score(score: np.ndarray, y: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, best first; rows drawn; positives drawn), the last two (scores, replicates)."""
    order = np.argsort(-score, kind="stable")
    score, drawn, y = score[order], drawn[:, order].T, y[order]
    first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
    return score[first], np.add.reduceat(drawn, first, axis=0), np.add.reduceat(drawn * y[:, None], first, axis=0)


def draw_rows(packed: DataFrame, keys: Sequence[str], arms: Sequence[str], resamples: int, seed: int, poisson: bool = False) -> DataFrame:
    """(keys, chunk, side, part, scores, n, pos, sum_n, sum_pos): what each cell draws for each cell of an arm's rank order."""
    chunks = -(-resamples // CHUNK)
    spread = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    spread = spread.repartition(*[*keys, "cell", "chunk"]).select(*keys, "chunk", "cell", "groups", "sizes", *[f"edges_{a}" for a in arms])
    kept = list(keys)
    kinds = "".join(f"`{k}` {packed.schema[k].dataType.simpleString()}, " for k in kept)
    schema = f"{kinds}chunk int, side int, part long, scores binary, n binary, pos binary, sum_n binary, sum_pos binary"
    names = [*kept, "chunk", "side", "part", "scores", "n", "pos", "sum_n", "sum_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                chunk, cell = batch.column(at["chunk"])[i].as_py(), batch.column(at["cell"])[i].as_py()
                groups, sizes = batch.column(at["groups"])[i].values, batch.column(at["sizes"])[i].values
                upto = np.concatenate([[0], np.cumsum(sizes.field("size").to_numpy())])
                y, n = groups.field("y").to_numpy().astype(np.int64), groups.field("n").to_numpy()
                replicates = min(CHUNK, resamples - chunk * CHUNK)
                at_cell = int(np.searchsorted(sizes.field("cell").to_numpy(), cell))
                draws = way_to(at_cell, upto, np.full(replicates, upto[-1]), seed, chunk)
                drawn = cell_draws(n, draws, seed, chunk, cell, poisson)
                for side, arm in enumerate(arms):
                    score, all_, pos = folded_by_score(groups.field(arm).to_numpy(), y, drawn)
                    edge = batch.column(at[f"edges_{arm}"])[i].values.to_numpy()
                    part = len(edge) - np.searchsorted(edge, score)
                    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        data = [score[a:b], all_[a:b].astype(np.int32), pos[a:b].astype(np.int32), all_[a:b].sum(axis=0), pos[a:b].sum(axis=0)]
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(at[k]).slice(i, 1) for k in kept], pa.array([chunk], pa.int32()), pa.array([side], pa.int32()), pa.array([int(part[a])]), *[pa.array([x.tobytes()], pa.binary()) for x in data]],
                            names=names,
                        )

    return settle(spread.mapInArrow(run, schema), "draws")


def before_parts(drawn: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, chunk, side, part, before_n, before_pos, total_n, total_pos): counts drawn ahead of each part, per replicate."""
    by = [*keys, "chunk", "side"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drawn.select(*by, "part").schema)

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part").to_numpy()
        parts, at = np.unique(part, return_inverse=True)
        sums = []
        for c in ("sum_n", "sum_pos"):
            own = np.stack([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()])
            total = np.zeros((len(parts), own.shape[1]), np.int64)
            np.add.at(total, at, own)
            sums.append(total)
        before = [np.cumsum(s, axis=0) - s for s in sums]
        head = {k: pa.array([table.column(k)[0].as_py()] * len(parts), table.schema.field(k).type) for k in by}
        body = {"part": pa.array(parts)} | {name: pa.array([x.tobytes() for x in rows], pa.binary()) for name, rows in zip(("before_n", "before_pos"), before)}
        whole = {name: pa.array([s.sum(axis=0).tobytes()] * len(parts), pa.binary()) for name, s in zip(("total_n", "total_pos"), sums)}
        return pa.table(head | body | whole)

    return drawn.select(*by, "part", "sum_n", "sum_pos").groupBy(*by).applyInArrow(run, f"{kinds}, before_n binary, before_pos binary, total_n binary, total_pos binary")


def part_sums(drawn: DataFrame, before: DataFrame, keys: Sequence[str], budget: float) -> DataFrame:
    """(keys, side, replicate, n, pos, area, lost, caught) of each part of a rank order."""
    by = [*keys, "chunk", "side", "part"]
    kinds = "".join(f"`{k}` {drawn.schema[k].dataType.simpleString()}, " for k in keys)

    def run(table: pa.Table) -> pa.Table:
        def column(name, kind=np.int64):
            return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]

        before_n, before_pos, total_n, total_pos = (np.frombuffer(table.column(c)[0].as_py(), np.int64) for c in ("before_n", "before_pos", "total_n", "total_pos"))
        replicates = len(before_n)
        worst, at = np.unique(-np.concatenate(column("scores", np.float64)), return_inverse=True)
        n, pos = np.zeros((2, len(worst), replicates))
        for out, name in ((n, "n"), (pos, "pos")):
            np.add.at(out, at, np.concatenate([x.reshape(-1, replicates) for x in column(name, np.int32)]))
        seen, hits = before_n + np.cumsum(n, axis=0), before_pos + np.cumsum(pos, axis=0)
        area = (pos * np.divide(hits, seen, out=np.zeros_like(seen), where=seen > 0)).sum(axis=0)
        neg = n - pos
        lost = (pos * ((seen - n) - (hits - pos) + 0.5 * neg)).sum(axis=0)
        most = np.maximum(1, np.ceil(budget * total_n))
        room = np.clip(most - (seen - n), 0, n)
        caught = (pos * np.divide(room, n, out=np.zeros_like(n), where=n > 0)).sum(axis=0)
        caught = np.where(most >= total_n, pos.sum(axis=0), caught)
        first = table.column("chunk")[0].as_py() * CHUNK
        head = {k: pa.array([table.column(k)[0].as_py()] * replicates, table.schema.field(k).type) for k in keys}
        own = {"side": np.full(replicates, table.column("side")[0].as_py(), np.int32), "replicate": np.arange(first, first + replicates, dtype=np.int32)}
        return pa.table(head | own | {"n": total_n.astype(np.float64), "pos": total_pos.astype(np.float64), "area": area, "lost": lost, "caught": caught})

    rows = drawn.drop("sum_n", "sum_pos").join(before, by)
    return rows.groupBy(*by).applyInArrow(run, f"{kinds}side int, replicate int, n double, pos double, area double, lost double, caught double")


def ranked_cells(groups: DataFrame, keys: Sequence[str], arm: str) -> DataFrame:
    """(keys, cell, scores, sizes): up to ``CELL`` distinct scores in a row, best first, and the sizes of all cells of the key."""
    pos = F.sum(F.col("n") * F.col("y")).cast("long")
    scores = groups.groupBy(*keys, F.col(arm).alias("score")).agg((F.sum("n") - pos).alias("neg"), pos.alias("pos"), F.lit(1).cast("long").alias("one"))
    placed = running_totals(scores, keys, ["score"], ["one"], score_cells(), descending=True)
    own = placed.withColumn("cell", F.floor(F.col("before_one") / CELL).cast("int"))
    entry = F.struct((-F.col("score")).alias("down"), "neg", "pos")
    cells = settle(own.groupBy(*keys, "cell").agg(F.array_sort(F.collect_list(entry)).alias("scores"), F.sum("neg").alias("neg"), F.sum("pos").alias("pos")), "cells")
    sizes = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "neg", "pos"))).alias("sizes"))
    return cells.drop("neg", "pos").join(sizes, list(keys))


def share_and_before(cell: int, upto: np.ndarray, draws: np.ndarray, seed: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(draws of a cell, draws of all cells before it) in each replicate, by the splits of ``way_to``."""
    low, high, before = 0, len(upto) - 1, np.zeros_like(draws)
    while high - low > 1:
        middle = (low + high) // 2
        share = (upto[middle] - upto[low]) / max(1, upto[high] - upto[low])
        left = np.random.default_rng([*seed, low, high]).binomial(draws, share)
        if cell < middle:
            draws, high = left, middle
        else:
            before, draws, low = before + left, draws - left, middle
    return draws, before


def among(n: np.ndarray, draws: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """(groups, replicates): each replicate's draws dealt over groups of ``n`` rows."""
    rows, replicates = int(n.sum()), len(draws)
    if not rows:
        return np.zeros((len(n), replicates), np.int64)
    if rows > 4 * len(n):
        return rng.multinomial(draws, n / rows).T
    of = np.repeat(np.arange(len(n)), n)[rng.integers(0, rows, int(draws.sum()))]
    return np.bincount(of * replicates + np.repeat(np.arange(replicates), draws), minlength=len(n) * replicates).reshape(len(n), replicates)


def cell_parts(neg: np.ndarray, pos: np.ndarray, before: Sequence[np.ndarray], most: np.ndarray, wanted: Sequence[str]) -> list[np.ndarray]:
    """A cell's part of each wanted sum: ``neg`` and ``pos`` (scores, replicates), best first, after what was drawn ``before``."""
    misses, hits = before[0] + np.cumsum(neg, axis=0), before[1] + np.cumsum(pos, axis=0)
    out = []
    for part in wanted:
        if part == "area":
            out.append((pos * (hits / np.maximum(misses + hits, 1))).sum(axis=0))
        elif part == "lost":
            out.append((pos * (misses - 0.5 * neg)).sum(axis=0))
        else:
            n = neg + pos
            room = np.clip(most - (misses + hits - n), 0, n)
            out.append((pos * (room / np.maximum(n, 1))).sum(axis=0))
    return out


def ranked_sums(cells: DataFrame, keys: Sequence[str], resamples: int, seed: int, budget: float, poisson: bool, wanted: Sequence[str]) -> DataFrame:
    """(keys, replicate, n, pos, wanted sums) of each cell; replicates of one cell are dealt over tasks while cells are few."""
    context = cells.sparkSession.sparkContext
    chunks, count = -(-resamples // CHUNK), cells.count()
    shares = max(1, min(chunks, 4 * context.defaultParallelism // max(1, count)))
    parts = max(4 * context.defaultParallelism, count * shares // 8)
    spread = cells.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(parts, *keys, "cell", "share")
    kinds = "".join(f"`{k}` {cells.schema[k].dataType.simpleString()}, " for k in keys)
    own_names = ["replicate", "n", "pos", *wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                scores, sizes = batch.column(at["scores"])[i].values, batch.column(at["sizes"])[i].values
                neg, pos = (scores.field(c).to_numpy() for c in ("neg", "pos"))
                upto = [np.concatenate([[0], np.cumsum(sizes.field(c).to_numpy())]) for c in ("neg", "pos")]
                cell, q, p = batch.column(at["cell"])[i].as_py(), int(upto[0][-1]), int(upto[1][-1])
                for chunk in range(batch.column(at["share"])[i].as_py(), chunks, shares):
                    replicates, root = min(CHUNK, resamples - chunk * CHUNK), np.random.default_rng([seed, chunk])
                    if poisson:
                        drawn = [root.poisson(q, replicates), root.poisson(p, replicates)]
                    else:
                        hits = root.binomial(q + p, p / (q + p), replicates)
                        drawn = [q + p - hits, hits]
                    n = drawn[0] + drawn[1]
                    ways = [share_and_before(cell, upto[k], drawn[k], [seed, chunk, k]) for k in (0, 1)]
                    rng = np.random.default_rng([seed, chunk, cell, 2])
                    dealt = [among(g, way[0], rng) for g, way in zip((neg, pos), ways)]
                    sums = cell_parts(*dealt, [way[1] for way in ways], np.maximum(1, np.ceil(budget * n)), wanted)
                    head = [pa.array([batch.column(at[k])[i].as_py()] * replicates, batch.schema.field(at[k]).type) for k in keys]
                    first = chunk * CHUNK
                    body = [np.arange(first, first + replicates, dtype=np.int32), n.astype(float), drawn[1].astype(float), *[x.astype(float) for x in sums]]
                    yield pa.RecordBatch.from_arrays([*head, *map(pa.array, body)], names=[*keys, *own_names])

    return spread.mapInArrow(run, f"{kinds}replicate int, n double, pos double" + "".join(f", {c} double" for c in wanted))


def replicate_values(rows: DataFrame, keys: Sequence[str], arms: Sequence[str], metrics: Sequence[str], resamples: int, seed: int, budget: float, poisson: bool = False) -> DataFrame:
    """(keys, arm, replicate, metrics); one-class resamples give no row."""
    unknown = sorted(set(metrics) - set(PARTS))
    if unknown:
        raise ValueError(f"unknown metric {unknown[0]!r}; known: {sorted(PARTS)}")
    by = list(keys) or ["_all"]
    rows = rows.select(*keys, "y", *arms) if keys else rows.select(F.lit(0).alias("_all"), "y", *arms)
    groups = folded_groups(rows, by, arms)
    if len(arms) == 1:
        wanted = [PARTS[m] for m in metrics]
        sums = ranked_sums(ranked_cells(groups, by, arms[0]), by, resamples, seed, budget, poisson, wanted).withColumn("side", F.lit(0))
    else:
        wanted = list(PARTS.values())
        drawn = draw_rows(packed_cells(groups, by, arms), by, arms, resamples, seed, poisson)
        sums = part_sums(drawn, before_parts(drawn, by), by, budget)
    whole = sums.groupBy(*keys, "side", "replicate").agg(F.max("n").alias("_n"), F.max("pos").alias("_pos"), *[F.sum(c).alias(c) for c in wanted])
    values = {
        "auprc": F.col("area") / F.col("_pos"),
        "auroc": 1.0 - F.col("lost") / (F.col("_pos") * (F.col("_n") - F.col("_pos"))),
        "recall_at_budget": F.col("caught") / F.col("_pos"),
    }
    name = F.element_at(F.array(*[F.lit(a) for a in arms]), F.col("side") + 1)
    both = whole.where((F.col("_pos") > 0) & (F.col("_pos") < F.col("_n")))
    return both.select(*keys, name.alias("arm"), "replicate", *[values[m].alias(m) for m in metrics])
