"""Run headers, run choice, error guard and review orders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window as W, functions as F

from ..schemas import ratio
from .running import integer_cells


def run_headers(manifests: DataFrame, progress: DataFrame) -> DataFrame:
    """Manifest where it exists, else the progress row; newest first."""
    m = manifests.select("run_id", *[F.col(c).alias(f"m_{c}") for c in manifests.columns if c != "run_id"])
    p = progress.select("run_id", *[F.col(c).alias(f"p_{c}") for c in progress.columns if c != "run_id"])
    both = m.join(p, "run_id", "full_outer")
    shared = [c for c in manifests.columns if c != "run_id" and c in progress.columns and c != "status"]
    only_m = [c for c in manifests.columns if c not in progress.columns and c != "status"]
    return both.select(
        "run_id",
        *[F.coalesce(f"m_{c}", f"p_{c}").alias(c) for c in shared],
        *[F.col(f"m_{c}").alias(c) for c in only_m],
        F.coalesce("p_status", F.lit("complete")).alias("status"),
    )


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("created_utc").desc(), F.col("run_id").desc())


def latest_run(runs: DataFrame, keys: Sequence[str] = ("provider",)) -> DataFrame:
    """Newest run per key, later id on a tie, as an aggregate rather than a sort."""
    rest = [c for c in runs.columns if c not in keys]
    return (
        runs.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct("created_utc", "run_id")).alias("r"))
        .select(*keys, "r.*")
    )


def current_runs(runs: DataFrame, split: str, dataset_id: str) -> DataFrame:
    return runs.where((F.col("split") == split) & (F.col("dataset_id") == dataset_id))


def stale_runs(runs: DataFrame, split: str, dataset_id: str) -> DataFrame:
    return runs.where((F.col("split") != split) | (F.col("dataset_id") != dataset_id))


def union_headers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both header sets; where both have a run, the first set's row wins."""
    extra = second.join(first.select("run_id"), "run_id", "left_anti")
    return first.unionByName(extra, allowMissingColumns=True)


def sibling_arms(runs: DataFrame, provider: str, split: str) -> DataFrame:
    return runs.where((F.col("provider") == provider) & (F.col("split") == split)).orderBy(
        "concurrency", "created_utc", "run_id"
    )


def error_rate_guard(
    predictions: DataFrame, keys: Sequence[str], arrival: str = "arrival", max_rate: float = 0.05, min_samples: int = 20
) -> DataFrame:
    """Per key, the first arrival at which the running error rate breaks the budget.

    Arrivals are cut into nested cells. A cell is kept while the rate may break in it: even its first arrival
    would break with all its failures, and no earlier cell has broken at its end. So finer cells, and in the end
    arrivals, are counted in kept cells alone; a window holds the cells of one coarser cell.
    """
    rows = predictions.select(*keys, arrival, F.col("error").isNotNull().cast("bigint").alias("failed"))
    kept, cells = None, []
    for cell in [*integer_cells(arrival), F.col(arrival)]:
        outer, cells = cells, [*cells, f"_cell{len(cells)}"]
        rows = rows.withColumn(cells[-1], cell)
        counts = rows.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("total"), F.sum("failed").alias("failed"))
        if kept is None:
            counts = counts.withColumns({"_seen": F.lit(0).cast("bigint"), "_failed": F.lit(0).cast("bigint")})
        else:
            same = reduce(and_, [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) for c in [*keys, *outer]])
            counts = counts.alias("c").join(kept.alias("k"), same).select("c.*", "k._seen", "k._failed")
        earlier = W.partitionBy(*keys, *outer).orderBy(F.col(cells[-1]).asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
        before = {n: F.col(f"_{'seen' if n == 'total' else n}") + F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in ("total", "failed")}
        placed = counts.select(*keys, *cells, "total", "failed", before["total"].alias("_seen"), before["failed"].alias("_failed"))
        seen, failed = F.col("_seen") + F.col("total"), F.col("_failed") + F.col("failed")
        enough = seen >= min_samples
        may = enough & (ratio(failed, F.greatest(F.col("_seen") + 1, F.lit(min_samples))) > max_rate)
        marked = placed.where(may).withColumn("_does", enough & (ratio(failed, seen) > max_rate))
        marked = marked.withColumn("_done", F.coalesce(F.bool_or("_does").over(earlier), F.lit(False)))
        kept = marked.where("NOT _done")
    return (
        kept.where("_does")
        .select(*keys, F.struct(seen.alias("seen"), failed.alias("failed")).alias("at"))
        .groupBy(*keys)
        .agg(F.min("at").alias("at"))
        .select(*keys, "at.seen", "at.failed")
    )


def recent_errors(predictions: DataFrame, keys: Sequence[str], arrival: str = "arrival", last: int = 8) -> DataFrame:
    """The last few errors of each key in arrival order; a top-k per key that each task trims first."""
    order = W.partitionBy(*keys).orderBy(F.desc(arrival), F.desc("trace_id"))
    failed = predictions.where(F.col("error").isNotNull()).select(*keys, "trace_id", "error", arrival)
    return failed.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= last).drop("_place")
