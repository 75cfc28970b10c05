"""Data-set and run verification as rows of problems."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import LABELS
from . import sets


def problem(check: str, severity: str, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.alias("detail")]


def balance_problems(truth: DataFrame, severity: str = "fail") -> DataFrame:
    """Labels whose count is not a quarter of the rows."""
    counts = truth.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(F.when(F.col("label") == n, 1)).alias(n) for n in LABELS]
    )
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("n")) for n in LABELS])).alias("e")
    return (
        counts.select("total", each)
        .where(F.col("e.n") != F.floor(F.col("total") / len(LABELS)))
        .select(*problem("label_balance", severity, F.concat_ws("=", "e.label", F.col("e.n").cast("string"))))
    )


def validate_dataset(
    truth: DataFrame,
    split_unit: DataFrame,
    expected_faults: Sequence[str],
    real: bool,
    fingerprint_matches: bool = True,
) -> DataFrame:
    """All checks on a data set; on a real corpus balance and diversity are notes."""
    soft = "note" if real else "fail"
    parts = [
        balance_problems(truth, soft),
        sets.fault_gaps(truth, expected_faults).select(
            F.concat(F.lit("fault_"), "problem").alias("check"), F.lit("fail").alias("severity"), F.col("fault").alias("detail")
        ),
        sets.split_overlap(split_unit).select(*problem("split_overlap", "fail", F.col("template_family"))),
        sets.uncovered_units(truth, split_unit).select(*problem("uncovered_unit", "fail", F.col("template_family"))),
        sets.label_diversity(truth).select(*problem("one_label_unit", soft, F.col("template_family"))),
        sets.duplicate_ids(truth).select(*problem("duplicate_id", "fail", F.col("trace_id"))),
    ]
    if not fingerprint_matches:
        parts.append(
            truth.sparkSession.range(1).select(*problem("fingerprint", "fail", F.lit("data set fingerprint differs")))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def balance_contract(truth: DataFrame, faults: Sequence[str]) -> DataFrame:
    """The generated-set contract: equal labels, mixed units, unique ids, every fault."""
    missing = sets.fault_gaps(truth, faults).where("problem = 'missing'")
    return (
        balance_problems(truth)
        .unionByName(sets.label_diversity(truth).select(*problem("one_label_unit", "fail", F.col("template_family"))))
        .unionByName(sets.duplicate_ids(truth).select(*problem("duplicate_id", "fail", F.col("trace_id"))))
        .unionByName(missing.select(*problem("fault_missing", "fail", F.col("fault"))))
    )


def cost_problems(recorded: DataFrame, recomputed: str = "expected_usd", tolerance: float = 1e-12) -> DataFrame:
    """Rows whose recorded cost is invented, missing, or off by more than the tolerance."""
    got, want = F.col("cost_usd"), F.col(recomputed)
    kind = F.when(want.isNull() & got.isNotNull(), "invented_cost").when(
        want.isNotNull() & (got.isNull() | (F.abs(got - want) > tolerance)), "cost_mismatch"
    )
    return recorded.withColumn("problem", kind).where(F.col("problem").isNotNull()).select("run_id", "trace_id", "problem")


def rollup_problems(stored: DataFrame, recomputed: DataFrame, key: str = "run_id") -> DataFrame:
    """Stored run totals against recomputed ones, for every run at once.

    A run known on one side only is a problem too.
    """
    joined = stored.alias("s").join(recomputed.alias("r"), key, "full_outer")
    s, r = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"r.{c}"))
    checks = {
        "n_predictions": ~s("n_predictions").eqNullSafe(r("n_predictions")),
        "total_input_tokens": ~s("total_input_tokens").eqNullSafe(r("total_input_tokens")),
        "total_cost_missing": s("total_cost_usd").isNull() & r("total_cost_usd").isNotNull(),
        "total_cost": s("total_cost_usd").isNotNull()
        & r("total_cost_usd").isNotNull()
        & (F.abs(s("total_cost_usd") - r("total_cost_usd")) > 1e-9),
    }
    found = F.filter(
        F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]), lambda x: x.isNotNull()
    )
    return joined.select(key, F.explode(found).alias("problem"))


def account_problems(stored: DataFrame, rows: DataFrame, column: str, key: str = "run_id") -> DataFrame:
    """Stored account sizes (truncations, deviations) against the rows on disk."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return (
        stored.join(counts, key, "left")
        .where(F.col(column) != F.coalesce("_rows", F.lit(0)))
        .select(key, F.lit(column).alias("problem"))
    )


def price_chain(prices: DataFrame) -> DataFrame:
    """A superseding price list may add a model but never reprice one."""
    w = Window.partitionBy("model_id").orderBy("manifest_date", "revision")
    before = lambda c: F.lag(c).over(w)
    moved = ~F.col("in_rate").eqNullSafe(F.col("_in")) | ~F.col("out_rate").eqNullSafe(F.col("_out"))
    return (
        prices.withColumns(
            {"_in": before("in_rate"), "_out": before("out_rate"), "_nth": F.row_number().over(w)}
        )
        .where((F.col("_nth") > 1) & moved)
        .select("model_id", "manifest_date", "revision", F.col("_in").alias("old_in_rate"), "in_rate",
                F.col("_out").alias("old_out_rate"), "out_rate")
    )


# -- digests ---------------------------------------------------------------------------


def row_lanes(columns: Sequence[str]) -> list[Column]:
    """A row's SHA-256 as eight unsigned 32-bit numbers; sums of them do not depend on any order."""
    row = F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
    return [F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)").alias(f"l{i}") for i in range(8)]


def digests(tables: dict[str, DataFrame], key: str = "run_id") -> DataFrame:
    """(key, part, digest, n_rows): one digest per key and table, all in one aggregate.

    A digest is the multiset of a key's rows in a table: order-free, so partial sums merge, and a
    repeated row counts. Columns are taken in the order of their names.
    """
    rows = None
    for part, table in tables.items():
        own = table.select(F.col(key).alias("key"), F.lit(part).alias("part"), *row_lanes([c for c in table.columns if c != key]))
        rows = own if rows is None else rows.unionByName(own)
    summed = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(f"l{i}").alias(f"l{i}") for i in range(8)])
    text = F.concat_ws(":", F.col("n_rows").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(8)])
    return summed.select(F.col("key").alias(key), "part", F.sha2(text, 256).alias("digest"), "n_rows")


def shared_digests(runs: DataFrame, found: DataFrame, name: str, key: str = "run_id") -> DataFrame:
    """(key, part, digest, n_rows) of a table that many runs share, such as a data set or a price list: ``found`` has one row per ``name``."""
    return runs.select(key, name).join(found, name, "left").select(key, "part", "digest", "n_rows")


def digest_problems(stored: DataFrame, found: DataFrame, skipped_when_archived: Sequence[str] = ("dataset",), key: str = "run_id") -> DataFrame:
    """Stored digests (key, part, digest, n_rows, archived) against found ones, for every run at once.

    A part with a digest on record and no rows is missing, unless it was recorded as empty; an
    unequal digest is a mismatch, and only where digests agree is the recorded count looked at. A part with rows
    but no record is foreign. Archived runs keep the record of a data set that has since been replaced, so that part of
    theirs is left out.
    """
    s, r = stored.alias("s"), found.alias("r")
    both = s.join(r, [key, "part"], "full_outer")
    recorded, present = F.col("s.digest").isNotNull(), F.col("r.digest").isNotNull()
    kind = (
        F.when(recorded & ~present, F.when(F.col("s.n_rows") > 0, "missing"))
        .when(~recorded & present, "foreign")
        .when(F.col("s.digest") != F.col("r.digest"), "mismatch")
        .when(F.col("s.n_rows") != F.col("r.n_rows"), "count")
    )
    left_out = F.coalesce(F.col("s.archived"), F.lit(False)) & F.col("part").isin(*skipped_when_archived)
    return both.where(~left_out).select(key, F.concat_ws("_", "part", kind).alias("problem"), kind.alias("kind")).where("kind is not null").drop("kind")


def verify_runs(
    stored: DataFrame,
    recomputed: DataFrame,
    stored_digests: DataFrame,
    found_digests: DataFrame,
    recorded_costs: DataFrame | None = None,
    key: str = "run_id",
) -> DataFrame:
    """(key, problem): rollups, digests and, where given, the cost of each prediction, for all runs in one pass each."""
    out = rollup_problems(stored, recomputed, key).unionByName(digest_problems(stored_digests, found_digests, key=key))
    if recorded_costs is not None:
        costs = cost_problems(recorded_costs).groupBy(key, "problem").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(costs.select(key, "problem"))
    return out
