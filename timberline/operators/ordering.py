"""Running numbers and neighbours over long ordered inputs.

A window over a whole dataset, source or hot key would sort it in one task.
Here the ordering column (a long) is cut into fixed-width blocks: the window
runs per (keys, block), and one summary row per block carries what crosses a
block edge. Group size is bounded by the block width whatever the skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timberline.session import cut

BLOCK = 1 << 20


def block_of(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("long")


def with_offsets(counts: DataFrame, keys: Sequence[str], block: Sequence[str], n: str, name: str) -> DataFrame:
    """Rows before each block: prefix sum over the (small) table of block counts."""
    before = (
        Window.partitionBy(*keys)
        .orderBy(*block)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumn(name, F.coalesce(F.sum(n).over(before), F.lit(0)))


def number_densely(
    df: DataFrame, keys: Sequence[str], order: str, name: str, start: int = 1, width: int = BLOCK
) -> DataFrame:
    """Gap-free numbers per ``keys`` in ``order`` (unique within the keys)."""
    keys = list(keys)
    df = df.withColumn("_block", block_of(order, width))
    counts = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = with_offsets(counts, keys, ["_block"], "_n", "_before").drop("_n")
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        df.withColumn("_rank", F.row_number().over(inner))
        .join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_rank") + F.col("_before") + F.lit(start - 1))
        .drop("_rank", "_before", "_block")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    fields: Sequence[str],
    name: str = "prev",
    width: int = BLOCK,
) -> DataFrame:
    """Adds struct ``name`` with the ``fields`` of the row before, null for the first."""
    keys = list(keys)
    df = df.withColumn("_block", block_of(order, width)).withColumn("_here", F.struct(*fields))
    inner = Window.partitionBy(*keys, "_block").orderBy(order)
    lasts = df.groupBy(*keys, "_block").agg(F.max_by("_here", order).alias("_last"))
    carried = lasts.withColumn(
        "_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))
    ).drop("_last")
    return (
        df.withColumn("_within", F.lag("_here").over(inner))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_within", "_carried"))
        .drop("_block", "_here", "_within", "_carried")
    )


def with_last(
    df: DataFrame, keys: Sequence[str], order: str, field: str, name: str, width: int = BLOCK
) -> DataFrame:
    """Adds ``name``: the last non-null ``field`` among the rows before (``order`` is unique within the keys)."""
    keys = list(keys)
    df = df.withColumn("_block", block_of(order, width))
    lasts = df.groupBy(*keys, "_block").agg(F.max_by(field, F.when(F.col(field).isNotNull(), F.col(order))).alias("_last"))
    above = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.withColumn("_carried", F.last("_last", ignorenulls=True).over(above)).drop("_last")
    inner = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_within", F.last(field, ignorenulls=True).over(inner))
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.coalesce("_within", "_carried"))
        .drop("_block", "_within", "_carried")
    )


def number_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Gap-free numbers from 1 per ``keys`` in a composite order, written once.

    Rows are dealt by range, so a hot key spreads over tasks; a row's number is
    its place in its range plus the rows of its key in lower ranges.
    """
    keys = list(keys)
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "ranges")
    counts = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = with_offsets(counts, keys, ["_part"], "_n", "_before").drop("_n")
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        ranged.withColumn("_rank", F.row_number().over(inner))
        .join(before, [*keys, "_part"])
        .withColumn(name, F.col("_rank") + F.col("_before"))
        .drop("_rank", "_before", "_part")
    )


def ordinal_by_sort(df: DataFrame, order: Sequence[Column | str], name: str, label: str) -> DataFrame:
    """Order-preserving long for a composite order, fixed by writing the table once.

    A global sort is range-partitioned, so a hot key spreads over many tasks;
    the number (partition, position) grows along the sorted rows.
    """
    return cut(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), label)
