"""A directory of a stored event table: what each data file holds.

One row per (file, source): rows, lowest and highest line and id. It answers two questions without reading the
store: which files can hold a given line's identity (an append reads those, not all), and in which files the
rows from a given place on are (a deep page opens those, and nothing is sorted).

The directory lies in ``_directory`` below the store, where table readers do not look. It is only ever a copy of
what the files say: :func:`refresh` adds files written since and leaves out files that are gone, so a job that failed
between writing rows and describing them, or a store without a directory, costs one look into the files
that are not described yet.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from timberline.session import cut
from timberline.sources.text import path_exists

ENTRY = "dataset string, file string, source_id string, rows long, low_line long, high_line long, low_id long, high_id long"
_STORED = "id long, source_id string, source_line long, event_id string"
#: What an identity made of source, line and text looks like; others (``legacy-...``) may be in any file.
DERIVED = r"^[0-9a-f]{64}$"


def _relative(path: Column) -> Column:
    """A file's place below the store, as its location names it."""
    return F.regexp_extract(path, r"(dataset=[^/]+/[^/]+)$", 1)


def _files(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    at = [f"{root}/{unquote(f)}" for f in files]
    return spark.read.schema(_STORED + ", dataset string").option("basePath", root).parquet(*at)


def refresh(spark: SparkSession, path: str) -> DataFrame:
    """The directory (``ENTRY``) of the store as it is now. Reads three columns of the files not described yet."""
    root, place = path.rstrip("/"), f"{path.rstrip('/')}/_directory"
    there = [(f"dataset={f.rpartition('/dataset=')[2]}",) for f in spark.read.schema(_STORED).parquet(root).inputFiles()]
    if not there:
        return spark.createDataFrame([], ENTRY)
    there = spark.createDataFrame(there, "file string")
    if path_exists(spark, place):
        known = spark.read.schema(ENTRY).parquet(place)
        new = [r.file for r in there.join(known.select("file"), "file", "left_anti").collect()]
    else:
        new = [r.file for r in there.collect()]
    if new:
        rows = _files(spark, root, new).select("dataset", _relative(F.col("_metadata.file_path")).alias("file"),
                                               F.coalesce("source_id", F.lit("")).alias("source_id"), "source_line", "id")
        entries = rows.groupBy("dataset", "file", "source_id").agg(
            F.count(F.lit(1)).alias("rows"), F.min("source_line").alias("low_line"), F.max("source_line").alias("high_line"),
            F.min("id").alias("low_id"), F.max("id").alias("high_id"))
        entries.coalesce(8).write.mode("append").parquet(place)
    # Two refreshes at a time may describe a file twice.
    return spark.read.schema(ENTRY).parquet(place).distinct().join(there, "file", "left_semi")


def files_that_may_hold(spark: SparkSession, path: str, rows: DataFrame) -> list[str]:
    """Files of the store in which an identity of ``rows(event_id, source_id, source_line)`` may stand.

    A derived identity stands for its source and line, so only files with lines of that source in that range count. If any other
    identity is among ``rows``, all files do.
    """
    entries = refresh(spark, path)
    asked = rows.groupBy(F.coalesce("source_id", F.lit("")).alias("source_id")).agg(
        F.min("source_line").alias("_low"), F.max("source_line").alias("_high"),
        F.count_if(F.col("event_id").isNull() | ~F.col("event_id").rlike(DERIVED)).alias("_odd"))
    asked = cut(asked, "asked")
    if not asked.filter("_odd > 0").isEmpty():
        return sorted(r.file for r in entries.select("file").distinct().collect())
    near = (F.col("low_line") <= F.col("_high")) & (F.col("high_line") >= F.col("_low"))
    return sorted(r.file for r in entries.join(asked, "source_id").filter(near).select("file").distinct().collect())


def identities(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``(event_id)`` of the stored rows that ``rows`` may repeat; reads only the files that may hold one."""
    files = files_that_may_hold(spark, path, rows)
    if not files:
        return spark.createDataFrame([], "event_id string")
    found = _files(spark, path.rstrip("/"), files)
    # Rows of older tables have no identity of their own; readers give them one by number.
    return found.select(F.coalesce("event_id", F.concat(F.lit("legacy-"), F.col("id").cast("string"))).alias("event_id"))


def not_stored(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``event_id`` the store does not hold. Evaluates ``rows`` once to find their sources."""
    if not path_exists(spark, path):
        return rows
    return rows.join(identities(spark, path, rows), "event_id", "left_anti").select(*rows.columns)


def page_files(spark: SparkSession, path: str, offset: int, limit: int) -> tuple[list[dict], int]:
    """The stretches of files that hold rows [offset, offset + limit) in the order of dataset and id, and how many
    rows come before the first.

    Ids are unique within a dataset. Files of one dataset whose ids overlap are one stretch. The windows run over the
    directory, one row per file.
    """
    files = refresh(spark, path).groupBy("dataset", "file").agg(
        F.sum("rows").alias("rows"), F.min("low_id").alias("low"), F.max("high_id").alias("high"))
    order = Window.partitionBy("dataset").orderBy("low", "file")
    above = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(above.isNull() | (F.col("low") > above), 1).otherwise(0)
    files = files.withColumn("_begins", begins).withColumn("_stretch", F.sum("_begins").over(order))
    stretches = files.groupBy("dataset", "_stretch").agg(
        F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list("file").alias("files"))
    before = F.sum("rows").over(Window.orderBy("dataset", "low").rowsBetween(Window.unboundedPreceding, -1))
    stretches = stretches.withColumn("before", F.coalesce(before, F.lit(0)))
    hit = (F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)
    found = [r.asDict() for r in stretches.filter(hit).orderBy("before").collect()]
    return found, found[0]["before"] if found else 0
