"""Exact quantiles of many keys at once, without a buffer of a key's values.

Values fold to distinct ones with counts. Their order is cut into nested cells; the counts of coarse
cells say in which cells the wanted ranks lie, only those are cut again, and only values in the last
cells are ordered. A cell level adds at most two cells per key and quantile, however many rows or
distinct values a key has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

# Cells per doubling of the value, as powers of two: the last ones span about one part in 2 ** 27.
LEVELS = (8, 27)


def value_cells(value: str) -> list[Column]:
    """Nested cells of any finite double, even in its logarithm on both sides of zero; never decreasing."""
    v = F.col(value)
    size = F.log2(F.lit(1.0) + F.abs(v) * float(1 << 20))
    signed = F.when(v < 0, -size).otherwise(size)
    return [F.floor(signed * float(1 << bits)).cast("bigint") for bits in LEVELS]


def wanted_ranks(totals: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(keys, total, i, rank): the two ranks (from 0) that each share lies between."""
    both = []
    for i, q in enumerate(shares):
        at = F.lit(float(q)) * (F.col("total") - 1)
        both += [F.struct(F.lit(2 * i).alias("i"), F.floor(at).alias("rank")), F.struct(F.lit(2 * i + 1).alias("i"), F.ceil(at).alias("rank"))]
    return totals.select("*", F.explode(F.array(*both)).alias("w")).select(*totals.columns, "w.*")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(keys, names, total, sum): linearly interpolated quantiles per key, with its count and sum.

    Nulls are left out. Values are to be finite.
    """
    if not keys:
        return quantiles(rows.select(F.lit(0).alias("_all"), value), ["_all"], value, shares, names).drop("_all")
    keys = list(keys)
    flat = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cells = [f"_c{i}" for i in range(len(LEVELS))]
    folded = settle(flat.withColumns(dict(zip(cells, value_cells("value"), strict=True))), "values")
    totals = folded.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("value") * F.col("n")).alias("sum"))
    wanted = wanted_ranks(totals, shares).withColumn("before", F.lit(0).cast("bigint"))
    inside = folded
    for depth, cell in enumerate(cells):
        by = [*keys, *cells[:depth]]
        counts = inside.groupBy(*by, cell).agg(F.sum("n").alias("m"))
        placed = counts.withColumn("ahead", F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        start = F.col("before") + F.col("ahead")
        # the few ranks of a key meet the cells of its own coarser cell only
        wanted = wanted.join(placed, by).where((F.col("rank") >= start) & (F.col("rank") < start + F.col("m"))).select(*by, cell, "i", "rank", "total", "sum", start.alias("before"))
        wanted = settle(wanted, "ranks")
        inside = inside.join(wanted.select(*by, cell).distinct(), [*by, cell], "left_semi")
    by = [*keys, *cells]
    ordered = inside.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.col("before") + F.col("ahead")
    found = wanted.join(ordered, by).where((F.col("rank") >= start) & (F.col("rank") < start + F.col("n")))
    at = {i: F.max(F.when(F.col("i") == i, F.col("value"))) for i in range(2 * len(shares))}
    out = []
    for i, (q, name) in enumerate(zip(shares, names, strict=True)):
        place = F.lit(float(q)) * (F.max("total") - 1)
        part = place - F.floor(place)
        out.append(F.when(at[2 * i] == at[2 * i + 1], at[2 * i]).otherwise(at[2 * i] * (1.0 - part) + at[2 * i + 1] * part).alias(name))
    return found.groupBy(*keys).agg(*out, F.max("total").alias("total"), F.max("sum").alias("sum"))
