"""Cumulative sums in the order of a number, without a window that holds all rows in one task.

Numbers fall into cells that keep their order: CELLS per doubling of the absolute value, so the cells depend on
no sample and no other row. Sums run within each cell, in parallel, and the totals of the cells before it are
added. Only the totals of cells meet in one task: 1,024 rows per doubling that occurs, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells per doubling; exponents of doubles lie above -1,100.
CELLS, LEAST = 1024, 1100


def cell_of(x: Column) -> Column:
    """A whole number that never falls as x rises. Rounding of the logarithm moves no bound: both sides of a power of 2 count alike."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    cell = (power + LEAST) * CELLS + F.floor(size / F.pow(F.lit(2.0), power) * CELLS)
    far = F.lit((2 * LEAST + 2) * CELLS)
    return F.when(F.isnan(x) | (x == float("inf")), far).when(x == float("-inf"), -far).when(size == 0, F.lit(0).cast("long")).when(x > 0, cell).otherwise(-cell)


def running(df: DataFrame, order: str, sums: Mapping[str, Column], keys: Sequence[str] = (), descending: bool = False, before: Sequence[str] = (), then: Sequence[str] = (), previous: Mapping[str, str] | None = None) -> DataFrame:
    """df with the cumulative sum of each of `sums` in the order of a double, up to and with the row; those in `before` without it.

    keys: groups that are summed apart, nulls being a group; then: columns that order rows of one value.
    previous: name -> column, the column's value in the row before. Sums over no row are 0, the value before the first row is null.
    """
    previous = previous or {}
    turn = F.desc if descending else F.asc
    df = df.withColumn("_cell", cell_of(F.col(order)))
    #: Reading all columns keeps both uses of df alike, so that Spark computes it once and reads its exchange twice.
    whole = F.hash(*df.columns) >= -(1 << 31)
    last = F.min_by if descending else F.max_by
    totals = df.groupBy(*keys, "_cell").agg(*[F.sum(F.when(whole, c)).alias(f"_o{i}") for i, c in enumerate(sums.values())], *[last(c, order).alias(f"_q{i}") for i, c in enumerate(previous.values())])
    across = Window.partitionBy(*keys).orderBy(turn("_cell"))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_at"), *[F.coalesce(F.sum(f"_o{i}").over(earlier), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))], *[F.lag(f"_q{i}").over(across).alias(f"_q{i}") for i in range(len(previous))])
    inside = Window.partitionBy(*keys, "_cell").orderBy(turn(order), *then)
    upto, upto_last = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({n: F.coalesce(F.sum(c).over(upto_last if n in before else upto), F.lit(0)) for n, c in sums.items()} | {n: F.lag(c).over(inside) for n, c in previous.items()} | ({"_first": F.row_number().over(inside) == 1} if previous else {}))
    same = F.col("_cell").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(totals, same).withColumns({n: F.col(n) + F.col(f"_o{i}") for i, n in enumerate(sums)} | {n: F.when(F.col("_first"), F.col(f"_q{i}")).otherwise(F.col(n)) for i, n in enumerate(previous)})
    return out.drop("_cell", "_at", "_first", *totals.columns)
