"""The table of runnable queries: a Spark plan and, where SQL can say it, a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
SCALE = 1e6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits at the edge, so sums taken in another order compare equal."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`") * SCALE, 0) / SCALE).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, check: str | None = None):
    """Register a query under an inventory key, with its check SQL if there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if check is not None:
            CHECKS[name] = check
        return fn

    return add
