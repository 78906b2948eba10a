"""Shared helpers of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are limited by bytes too, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def part_offsets(rows: DataFrame, part: str, size: Column) -> DataFrame:
    """``(part, before)``: total ``size`` of all lower parts. One row per partition meets in the last window."""
    sums = rows.groupBy(part).agg(F.sum(size).alias("own"))
    running = F.sum("own").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    return sums.select(part, F.coalesce(running, F.lit(0)).cast("long").alias("before"))
