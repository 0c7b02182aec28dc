"""Ordered operations on groups of any size.

A window partitioned by product puts a whole product into one task. Groups above a size limit are first
cut into consecutive slices of about equal numbers of rows along their order, however many such groups
there are and however their rows cluster; the slices are then linked through one small row each.
"""

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetrail.plans.lineage import cut_lineage

SLICE_ROWS = 1_000_000


def large_groups(df: DataFrame, keys: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Keys (as `_key_<name>`) and size of all groups above `slice_rows`."""
    sizes = df.groupBy(*(F.col(k).alias(f"_key_{k}") for k in keys))
    return sizes.agg(F.count("*").alias("_size")).filter(F.col("_size") > slice_rows)


def sliced_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add `_slice`, which grows along `order` within each group, with `slice_rows` rows at most.

    Sorting by range cuts at any row, so a group's slices hold what one task can take even where
    all its rows fall into one moment. Sampled ranges differ in size: they are made half as
    large, and cut again by number.
    """
    ranges = max(ceil(2 * rows / slice_rows), 1)
    ranged = df.repartitionByRange(ranges, *keys, *order).withColumn(
        "_range", F.spark_partition_id()
    )
    # Ranges are drawn anew whenever they are computed again, so they are written down.
    ranged = cut_lineage(ranged)
    number = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)) - 1
    part = F.floor(number / slice_rows)
    return ranged.withColumn("_slice", F.struct("_range", part.alias("part"))).drop("_range")


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    name: str = "previous",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Add struct column `name` with `values` of the preceding row of the group.

    The struct is NULL on a group's first row only. Group sizes are counted first, one narrow
    aggregate, so that the usual case, without any large group, stays a plan with one shuffle.
    """
    keys, value = list(keys), F.struct(*values)
    plain = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    large = cut_lineage(large_groups(df, keys, slice_rows))
    rows = large.agg(F.sum("_size")).head()[0]
    if rows is None:
        return df.withColumn(name, plain)
    same = reduce(
        Column.__and__, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys)
    )
    ordinary = df.join(large, same, "left_anti").withColumn(name, plain)
    # Slices are read twice, for their rows and for their ends.
    sliced = cut_lineage(
        sliced_rows(df.join(large, same, "left_semi"), keys, order, rows, slice_rows)
    )
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    # One row per slice: the last value of the slice before it.
    ends = sliced.groupBy(*keys, "_slice").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_slice")
    carried = ends.select(
        *(F.col(k).alias(f"_key_{k}") for k in keys),
        F.col("_slice").alias("_after"),
        F.lag("_end").over(across).alias("_carried"),
    )
    follows = same & (F.col("_slice") == F.col("_after"))
    linked = (
        sliced.withColumn(name, F.lag(value).over(in_slice))
        .join(carried, follows, "left")
        .withColumn(name, F.coalesce(name, "_carried"))
    )
    return ordinary.unionByName(linked.select(*ordinary.columns))
