"""Bootstrap intervals as one job over (arm, replicate).

Draws depend only on the seed, the replicate and what is drawn from, so two arms of a pair
share every resample, and a lost task redraws the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from . import draws, folded
from .ranking import metric_by_name
from .running import integer_cells, running_totals, score_cells

# The percentile interval.
LOWER, UPPER = 0.025, 0.975


def hash32(text: Column) -> Column:
    """A 32-bit hash that any SQL engine with md5 can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def numbered(rows: DataFrame, keys: Sequence[str], tie: str) -> DataFrame:
    """Dense 0-based ``idx`` in ``tie`` order and the arm size ``n_rows``."""
    ones = rows.withColumn("one", F.lit(1).cast("bigint"))
    return running_totals(ones, keys, [tie], ["one"], integer_cells(tie)).withColumnsRenamed(
        {"before_one": "idx", "total_one": "n_rows"}
    ).drop("one")


def exact_weights(
    rows: DataFrame, keys: Sequence[str], values: Sequence[str], resamples: int, seed: int, portable: bool
) -> DataFrame:
    """(keys, chunk, replicate, values, w): draws with replacement, counted per row.

    Every row is one slot of every replicate and draws one row number. A slot sends
    itself (weight 0, with its values) and its draw (weight 1, no values); summing by
    row number joins the two without a join. Replicates are dealt into chunks and the
    one shuffle moves rows by chunk, so everything after it stays where it is.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    chunks = min(resamples, 8 * parts)
    slots = (
        rows.select(*keys, *values, F.col("idx").alias("slot"), "n_rows", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        .repartition(min(parts, chunks), "chunk")
        .withColumn("replicate", F.explode(F.sequence(F.col("chunk"), F.lit(resamples - 1), F.lit(chunks))))
    )
    if portable:
        text = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col("slot").cast("string"))
        drawn = hash32(text) % F.col("n_rows")
    else:
        drawn = F.pmod(F.xxhash64(F.lit(seed), "replicate", "slot"), F.col("n_rows"))
    own = F.struct(F.col("slot").alias("idx"), F.lit(0).alias("w"), *[F.col(v) for v in values])
    draw = F.struct(drawn.alias("idx"), F.lit(1).alias("w"), *[F.lit(None).cast(rows.schema[v].dataType).alias(v) for v in values])
    return (
        slots.select(*keys, "chunk", "replicate", F.explode(F.array(own, draw)).alias("s"))
        .groupBy(*keys, "chunk", "replicate", "s.idx")
        .agg(F.sum("s.w").alias("w"), *[F.max(f"s.{v}").alias(v) for v in values])
        .where("w > 0")
    )


def resampled_groups(rows: DataFrame, keys: Sequence[str], arms: Sequence[str], tie: str, resamples: int, seed: int, portable: bool) -> DataFrame:
    """(keys, chunk, replicate, arm, score) with resampled row and positive counts, drawn row by row."""
    values = ["y", *arms]
    weighted = exact_weights(numbered(rows.select(*keys, *values, tie), keys, tie), keys, values, resamples, seed, portable)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(a).alias("score")) for i, a in enumerate(arms)])).alias("s")
    return (
        weighted.select(*keys, "chunk", "replicate", "y", "w", sides)
        .groupBy(*keys, "chunk", "replicate", "s.side", "s.score")
        .agg(F.sum("w").cast("bigint").alias("n"), F.sum(F.col("w") * F.col("y")).cast("bigint").alias("pos"))
    )


def replicate_values(
    rows: DataFrame,
    keys: Sequence[str],
    arms: Sequence[str],
    metrics: Sequence[str],
    resamples: int,
    seed: int,
    tie: str = "ord",
    budget: float = 0.05,
    mode: str = "folded",
    portable: bool = False,
) -> DataFrame:
    """Metric values per (keys, arm, replicate); one-class resamples give no row.

    Folded mode draws per group of equal scores and cuts both the draw and the ranking
    into cells; Poisson mode does the same with an independent count for each group, so
    replicates differ in size. Exact mode draws row by row, with one window per (arm,
    replicate): with ``portable`` hashes, which imply it, any SQL engine can repeat it.
    Those are counted in arrays where a key has at most ``draws.DENSE_ROWS`` rows, which a
    task then holds; beyond that the same draws are rows of a join that can spill.
    """
    if mode not in ("folded", "poisson", "exact"):
        raise ValueError(f"unknown resampling mode {mode!r}")
    if mode != "exact" and not portable:
        return folded.replicate_values(rows, keys, arms, metrics, resamples, seed, budget, mode == "poisson")
    if portable:
        slots = settle(numbered(rows.select(*keys, "y", *arms, tie), keys, tie), "slots")
        if (slots.agg(F.max("n_rows")).first()[0] or 0) <= draws.DENSE_ROWS:
            return draws.replicate_values(slots, keys, arms, metrics, resamples, seed, budget)
    groups = resampled_groups(rows, keys, arms, tie, resamples, seed, portable)
    by = [*keys, "chunk", "replicate", "side"]
    ranked = running_totals(groups, by, ["score"], ["n", "pos"], [], descending=True)
    values = ranked.groupBy(*by).agg(
        F.sum("n").alias("_n"),
        F.sum("pos").alias("_pos"),
        *[metric_by_name(m, budget=budget).alias(m) for m in metrics],
    )
    both = values.where((F.col("_pos") > 0) & (F.col("_pos") < F.col("_n")))
    name = F.element_at(F.array(*[F.lit(a) for a in arms]), F.col("side") + 1)
    return both.select(*keys, name.alias("arm"), "replicate", *metrics)


def percentile_interval(values: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    long = values.unpivot(list(keys) + ["replicate"], list(metrics), "metric", "value").where("value IS NOT NULL")
    return long.groupBy(*keys, "metric").agg(
        F.percentile("value", LOWER).alias("lower"),
        F.percentile("value", UPPER).alias("upper"),
        F.count("value").alias("resamples_used"),
    )


def point_values(rows: DataFrame, keys: Sequence[str], arms: Sequence[str], metrics: Sequence[str], budget: float) -> DataFrame:
    """The metrics of each arm on the rows as they are."""
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a).alias("score")) for a in arms])).alias("side")
    groups = (
        rows.select(*keys, "y", sides)
        .groupBy(*keys, F.col("side.arm").alias("arm"), F.col("side.score").alias("score"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos"))
    )
    by = [*keys, "arm"]
    ranked = running_totals(groups, by, ["score"], ["n", "pos"], score_cells(), descending=True)
    return ranked.groupBy(*by).agg(*[metric_by_name(m, budget=budget).alias(m) for m in metrics])


def bootstrap_interval(
    scored: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str] = ("auprc", "auroc"),
    resamples: int = 10_000,
    seed: int = 0,
    tie: str = "ord",
    budget: float = 0.05,
    mode: str = "folded",
    portable: bool = False,
) -> DataFrame:
    """Point, lower and upper of each metric for every arm at once."""
    values = replicate_values(scored, keys, ["score"], metrics, resamples, seed, tie, budget, mode, portable)
    spread = percentile_interval(values.drop("arm"), keys, metrics)
    point = point_values(scored, keys, ["score"], metrics, budget).drop("arm")
    long = point.unpivot(list(keys), list(metrics), "metric", "point")
    return long.join(spread, [*keys, "metric"], "left")


def difference(values: DataFrame, keys: Sequence[str], metrics: Sequence[str], per: Sequence[str]) -> DataFrame:
    """metric(score_a) - metric(score_b) per (keys, per)."""
    a, b = F.col("arm") == "score_a", F.col("arm") == "score_b"
    return values.groupBy(*keys, *per).agg(
        *[(F.max(F.when(a, F.col(m))) - F.max(F.when(b, F.col(m)))).alias(m) for m in metrics]
    )


def paired_bootstrap(
    pairs: DataFrame,
    keys: Sequence[str] = (),
    metrics: Sequence[str] = ("auprc", "recall_at_budget"),
    resamples: int = 10_000,
    seed: int = 20_260_919,
    tie: str = "ord",
    budget: float = 0.05,
    mode: str = "folded",
    portable: bool = False,
) -> DataFrame:
    """Interval of the difference of two arms under the same resamples."""
    arms = ["score_a", "score_b"]
    values = replicate_values(pairs, keys, arms, metrics, resamples, seed, tie, budget, mode, portable)
    spread = percentile_interval(difference(values, keys, metrics, ["replicate"]), keys, metrics)
    point = difference(point_values(pairs, keys, arms, metrics, budget), keys, metrics, [])
    long = point.unpivot(list(keys), list(metrics), "metric", "point")
    return long.join(spread, [*keys, "metric"], "left")
