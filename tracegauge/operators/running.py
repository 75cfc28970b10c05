"""Running totals over an order that may be far larger than one task.

A window without enough partitioning keys puts a whole arm into one task. Here the
order is cut into nested cells instead: a cell is a non-decreasing function of the
order column, so "everything before this row" is the sum over earlier coarse cells,
plus earlier finer cells inside the same coarse cell, plus earlier rows inside the
same finest cell. Each of those is a window over a bounded number of rows, and the
cell tables are aggregated on the map side before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle


def score_cells(score: str = "score") -> list[Column]:
    """Nested cells of a score, even in log-odds so both saturated ends are spread.

    Scores at 0.5 +- 40 log-odds fill at most 330 000 coarse cells, each holds at most
    32 768 fine cells, and a fine cell spans at most 17 million distinct doubles: the
    largest sort any one task can meet, whatever the skew.
    """
    s = F.col(score)
    odds = (
        F.when(s <= 0, F.lit(-800.0))
        .when(s >= 1, F.lit(800.0))
        .otherwise(F.ln(s / (F.lit(1.0) - s)))
    )
    return [F.floor(odds * float(2**bits)).cast("bigint") for bits in (12, 27)]


def integer_cells(column: str) -> list[Column]:
    """Nested cells of a BIGINT position: at most 2**20 positions in the finest."""
    return [F.shiftright(F.col(column), 40), F.shiftright(F.col(column), 20)]


def hash_cells(column: str) -> list[Column]:
    """Nested cells of a lower-case hex digest; digests are even by construction."""
    return [F.conv(F.substring(F.col(column), 1, n), 16, 10).cast("bigint") for n in (3, 6)]


def running_totals(
    table: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    cells: Sequence[Column],
    descending: bool = False,
) -> DataFrame:
    """Add ``before_<s>`` (sum over strictly earlier rows) and ``total_<s>`` per key.

    ``table`` holds one row per (keys, order); ``cells`` go from coarse to fine and
    must never decrease as the first ``order`` column grows.
    """
    keys, order = list(keys), list(order)
    names = [f"_cell{i}" for i in range(len(cells))]
    rows = table.withColumns(dict(zip(names, cells, strict=True)))

    def way(columns: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]

    def earlier(by: Sequence[str], columns: Sequence[str]):
        part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        return part.orderBy(*way(columns)).rowsBetween(Window.unboundedPreceding, -1)

    tables = []
    level = rows
    for depth in range(len(names), 0, -1):
        by = keys + names[:depth]
        level = level.groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])
        tables.insert(0, level)

    above: DataFrame | None = None
    for depth, level in enumerate(tables):
        by = keys + names[:depth]
        frame = earlier(by, [names[depth]])
        placed = level.select(
            *keys,
            *names[: depth + 1],
            *[F.coalesce(F.sum(s).over(frame), F.lit(0)).alias(f"_b_{s}") for s in sums],
            *(
                []
                if above is not None
                else [
                    F.sum(s).over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).alias(f"_t_{s}")
                    for s in sums
                ]
            ),
        )
        if above is not None:
            placed = placed.join(
                above.withColumnsRenamed({f"_b_{s}": f"_a_{s}" for s in sums}), by, "inner"
            ).select(
                *keys,
                *names[: depth + 1],
                *[(F.col(f"_b_{s}") + F.col(f"_a_{s}")).alias(f"_b_{s}") for s in sums],
                *[f"_t_{s}" for s in sums],
            )
        above = placed

    frame = earlier(keys + names, order)
    placed = rows.withColumns(
        {f"before_{s}": F.coalesce(F.sum(s).over(frame), F.lit(0)) for s in sums}
    )
    if above is None:
        whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        return placed.withColumns({f"total_{s}": F.sum(s).over(whole) for s in sums})
    return (
        placed.join(above, keys + names, "inner")
        .withColumns({f"before_{s}": F.col(f"before_{s}") + F.col(f"_b_{s}") for s in sums})
        .withColumnsRenamed({f"_t_{s}": f"total_{s}" for s in sums})
        .drop(*names, *[f"_b_{s}" for s in sums])
    )


def sliced_sums(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: str,
    sums: Sequence[str],
    slice_of: Callable[[Column, Column], Column],
) -> DataFrame:
    """Sum ``sums`` and count rows per slice of the rank order (value, tie) within keys.

    ``slice_of(rank, total)`` maps a 1-based rank to a slice number and must never
    decrease with rank. Rows are first folded to one row per distinct value; a value
    whose rows all land in one slice is added whole. Only values that straddle a slice
    edge (fewer than there are slices, per key) are ranked row by row, again over
    bounded cells of the tie column, so a value holding a third of all rows is split
    over many tasks.
    """
    keys = list(keys)
    # Several branches start from the distinct values, so they are written once.
    folded = settle(
        rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(s) for s in sums]), "values"
    )
    placed = running_totals(folded, keys, [value], ["n"], score_cells(value))
    first = slice_of(F.col("before_n") + 1, F.col("total_n"))
    last = slice_of(F.col("before_n") + F.col("n"), F.col("total_n"))
    placed = placed.withColumns({"first_slice": first, "last_slice": last})
    whole = placed.where("first_slice = last_slice").select(
        *keys, F.col("first_slice").alias("slice"), "n", *sums, "total_n"
    )
    split = placed.where("first_slice <> last_slice").select(
        *keys, value, F.col("before_n").alias("_base"), F.col("total_n").alias("_size")
    )
    # Fewer rows than slices per key: an edge lies inside one value only.
    inside = rows.join(F.broadcast(split), keys + [value], "inner").withColumn(
        "n", F.lit(1).cast("bigint")
    )
    ranked = running_totals(inside, keys + [value], [tie], ["n"], integer_cells(tie))
    pieces = ranked.select(
        *keys,
        slice_of(F.col("_base") + F.col("before_n") + 1, F.col("_size")).alias("slice"),
        "n",
        *sums,
        F.col("_size").alias("total_n"),
    )
    return (
        whole.unionByName(pieces)
        .groupBy(*keys, "slice")
        .agg(
            F.sum("n").alias("n"),
            *[F.sum(s).alias(s) for s in sums],
            F.max("total_n").alias("total_n"),
        )
    )
