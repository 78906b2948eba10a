"""Text lines with positions."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from timberline.functions.text import strip
from timberline.operators.ordering import with_offsets


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def require_path(spark: SparkSession, path: str) -> str:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return path


def valid_text(value: Column) -> Column:
    """UTF-8 with invalid bytes dropped and the line end cut."""
    repaired = F.regexp_replace(F.make_valid_utf8(value), "�", "")
    return F.rtrim(F.when(F.is_valid_utf8(value), value).otherwise(repaired), F.lit("\r\n"))


def scan_text(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """``dataset, file, block, offset, line``: one row per line.

    ``block`` and ``offset`` keep the order inside a file: the start of the split
    a line was read from and its place in it. The dataset defaults to the file
    stem, or to a ``dataset=`` folder where the path has one.
    """
    require_path(spark, path)
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    raw = spark.read.text(path)
    if dataset is not None:
        name = F.lit(dataset)
    elif "dataset" in raw.columns:
        name = F.col("dataset")
    else:
        name = F.lit(stem)
    return raw.select(
        name.alias("dataset"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("offset"),
        valid_text(F.col("value")).alias("line"),
    )


def number_lines(
    scanned: DataFrame, source_id: str | None = None, line_offset: int = 0, start_id: int = 1,
    max_lines: int | None = None, per_file: bool = False,
) -> DataFrame:
    """``source_line`` over all lines and dense ``id`` over the non-blank ones, per dataset.

    A dataset's files follow each other by name. Rows are ranked inside their
    read split only; splits are put in order through a table of their counts.
    Blank lines are dropped after they are counted. ``per_file`` starts the line
    numbers anew in each file and names the file as source; ids run on.
    """
    keys = ["dataset", "file", "block"]
    filled = strip(F.col("line")) != ""
    counts = scanned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_lines"), F.count_if(filled).alias("_filled")
    )
    within = ["dataset", "file"] if per_file else ["dataset"]
    offsets = with_offsets(counts, within, ["file", "block"], "_lines", "_before")
    offsets = with_offsets(offsets, ["dataset"], ["file", "block"], "_filled", "_filled_before")
    here = Window.partitionBy(*keys).orderBy("offset")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = (
        scanned.withColumn("_at", F.row_number().over(here))
        .withColumn("_id", F.sum(filled.cast("long")).over(upto))
        .join(offsets.drop("_lines", "_filled"), keys)
        .withColumn("_line_no", F.col("_at") + F.col("_before"))
    )
    if max_lines is not None:
        df = df.filter(F.col("_line_no") <= max_lines)
    name = F.lit(source_id) if source_id is not None else F.col("file" if per_file else "dataset")
    return df.filter(filled).select(
        "dataset", name.alias("source_id"),
        (F.col("_line_no") + line_offset).alias("source_line"),
        (F.col("_id") + F.col("_filled_before") + (start_id - 1)).alias("id"),
        "line",
    )


def load_file(
    spark: SparkSession, path: str, max_lines: int | None = None, dataset: str | None = None
) -> DataFrame:
    """Numbered lines of one file or folder, its path as source."""
    return number_lines(scan_text(spark, path, dataset), source_id=os.path.abspath(path), max_lines=max_lines)


def raw_bytes(events: DataFrame, per_line: int = 0) -> DataFrame:
    """UTF-8 bytes of the kept text per dataset; ``per_line`` adds line ends (bulk rule: 1)."""
    return events.groupBy("dataset").agg(
        F.sum(F.octet_length("raw") + per_line).alias("raw_bytes"), F.count(F.lit(1)).alias("row_count")
    )
