"""Places in a global order without one task that sorts a group.

Both helpers count rows in hash cells or value ranges, add up the counts of earlier cells and
number rows inside a cell only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftgrid.session import lookup_join, materialize

_CELL_BITS = 12


def dealt(data: DataFrame, strata: Sequence[str], key: str = "user_id") -> DataFrame:
    """``data`` with ``position``: 0, 1, 2 ... in every stratum, in the order of the key's hash.

    The hash is the first 60 bits of the key's md5, so other engines deal alike. A position is
    the number of rows in earlier hash cells plus the place inside the row's own cell.
    """
    digits = F.substring(F.md5(F.col(key).cast("string")), 1, 15)
    hashed = data.withColumn("_hash", F.conv(digits, 16, 10).cast("bigint")).withColumn(
        "_cell", F.shiftright("_hash", 60 - _CELL_BITS).cast("int")
    )
    cells = hashed.groupBy(*strata, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*strata).orderBy("_cell")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = cells.select(
        *strata, "_cell", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*strata, "_cell").orderBy("_hash", key)
    return (
        lookup_join(hashed, offsets, [*strata, "_cell"])
        .withColumn("position", F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_hash", "_cell", "_offset")
    )


def running_below(counts: DataFrame, by: Sequence[str], value: str, n: str) -> DataFrame:
    """``counts`` (one row per group and value) with ``below``: sum of ``n`` over smaller values.

    Values are range-partitioned, and each range adds the sums of the ranges below it. A value
    shared by many rows is one counted row.
    """
    # Written out, so the sampled range bounds are the same for both uses below.
    ranges = materialize(
        counts.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()), "ranges"
    )
    lower_ranges = (
        Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        ranges.groupBy(*by, "_range")
        .agg(F.sum(n).alias("_n"))
        .select(*by, "_range", F.coalesce(F.sum("_n").over(lower_ranges), F.lit(0)).alias("_offset"))
    )
    lower_values = (
        Window.partitionBy(*by, "_range").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        lookup_join(ranges, offsets, [*by, "_range"])
        .withColumn("below", F.col("_offset") + F.coalesce(F.sum(n).over(lower_values), F.lit(0)))
        .drop("_range", "_offset")
    )
