"""The stored event table: write, append, scan, slice, measure."""

from __future__ import annotations

import time
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.parsing import ENTITY_TYPE
from timberline.functions.text import half_up
from timberline.sources.directory import not_stored, page_files
from timberline.sources.text import path_exists, require_path

STORED_SCHEMA = (
    "id long, source_id string, source_line long, event_id string, timestamp string, timestamp_epoch double, "
    "level string, service string, host string, pid string, message string, template_id string, "
    "template string, params array<string>, entities_json string, anomaly_score float, is_anomaly boolean"
)
STORED_COLUMNS = tuple(part.split()[0] for part in STORED_SCHEMA.split(", "))


def to_stored(events: DataFrame) -> DataFrame:
    """The 17 stored columns (plus ``dataset``) with their defaults."""

    def text(name: str, other):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), other).alias(name)

    return events.select(
        "dataset", "id",
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        F.coalesce("source_line", F.lit(0)).cast("long").alias("source_line"),
        text("event_id", F.concat(F.lit("legacy-"), F.col("id").cast("string"))),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
        F.coalesce("timestamp_epoch", F.lit(0.0)).alias("timestamp_epoch"),
        "level", text("service", F.lit("unknown")), text("host", F.lit("local")),
        F.coalesce("pid", F.lit("")).alias("pid"), "message", "template_id", "template",
        F.coalesce("params", F.array().cast("array<string>")).alias("params"),
        F.to_json("entities").alias("entities_json"),
        F.col("anomaly_score").cast("float").alias("anomaly_score"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
    )


def save_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per dataset, zstd (identities are hexadecimal text, which it halves). Files show up only when the job commits."""
    (
        to_stored(events)
        .write.mode(mode)
        .option("compression", "zstd")
        .partitionBy("dataset")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored events; columns an older file lacks get their defaults."""
    require_path(spark, path)
    return upgrade(spark.read.option("mergeSchema", "true").parquet(path))


def upgrade(stored: DataFrame) -> DataFrame:
    """Fill the identity columns that older tables do not have."""
    for name, kind in (("source_id", "string"), ("source_line", "long"), ("event_id", "string")):
        if name not in stored.columns:
            stored = stored.withColumn(name, F.lit(None).cast(kind))
    return stored.select(
        "dataset",
        *[
            {
                "source_id": F.coalesce("source_id", F.lit("")).alias("source_id"),
                "source_line": F.coalesce("source_line", F.lit(0)).alias("source_line"),
                "event_id": F.coalesce(
                    "event_id", F.concat(F.lit("legacy-"), F.col("id").cast("string"))
                ).alias("event_id"),
            }.get(name, F.col(name))
            for name in STORED_COLUMNS
        ],
    )


def unstored(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose ``event_id`` is not stored yet."""
    return incoming.join(stored.select("event_id"), "event_id", "left_anti").select(*incoming.columns)


def append_events(events: DataFrame, path: str) -> None:
    """Add rows whose identity is new; stored rows keep their place and values.

    Stored identities are read from the files that may hold one of the new ones (:mod:`timberline.sources.directory`),
    however large the store has grown.
    """
    save_events(not_stored(events.sparkSession, path, events), path, mode="append")


def parse_entities(stored: DataFrame) -> DataFrame:
    """Decode ``entities_json``; text that does not parse gives an empty struct."""
    empty = F.from_json(F.lit("{}"), ENTITY_TYPE)
    return stored.withColumn("entities", F.coalesce(F.from_json("entities_json", ENTITY_TYPE), empty))


def flag_scan(spark: SparkSession, path: str) -> DataFrame:
    """Rows and anomalies per dataset; reads the flag column only."""
    require_path(spark, path)
    return spark.read.parquet(path).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_rows_scanned"), F.count_if("is_anomaly").alias("anomalies_found")
    )


def timed_flag_scan(spark: SparkSession, path: str) -> dict:
    """The scan as numbers, with latency and rate."""
    require_path(spark, path)
    began = time.perf_counter()
    rows, found = spark.read.parquet(path).agg(F.count(F.lit(1)), F.count_if("is_anomaly")).first()
    millis = (time.perf_counter() - began) * 1000
    return {
        "total_rows_scanned": rows, "anomalies_found": found, "scan_latency_ms": round(millis, 3),
        "scan_rows_per_sec": int(rows / max(0.0001, millis / 1000)),
    }


#: Up to so many rows, a page is put in order by one task.
PAGE_ROWS = 100_000


def read_slice(spark: SparkSession, path: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows [offset, offset + limit) in stored order, entities decoded; none past the end.

    The directory names the files that hold them. Where their ids have no gaps, the rows are those of a range of
    ids, which the scan skips to; else the rows of those files (and of no others) are sorted.
    """
    stretches, first = page_files(spark, path, offset, limit) if path_exists(spark, path) else ([], 0)
    if not stretches:
        return parse_entities(spark.createDataFrame([], "dataset string, " + STORED_SCHEMA))
    at = [f"{path.rstrip('/')}/{unquote(f)}" for s in stretches for f in s["files"]]
    rows = upgrade(spark.read.option("mergeSchema", "true").option("basePath", path.rstrip("/")).parquet(*at))
    if all(s["high"] - s["low"] + 1 == s["rows"] for s in stretches):
        wanted = F.lit(False)
        for s in stretches:
            low = s["low"] + max(0, offset - s["before"])
            wanted = wanted | ((F.col("dataset") == s["dataset"]) & F.col("id").between(low, s["low"] + offset + limit - s["before"] - 1))
        rows = rows.filter(wanted)
        rows = rows.coalesce(1).sortWithinPartitions("dataset", "id") if limit <= PAGE_ROWS else rows.orderBy("dataset", "id")
    else:
        rows = rows.orderBy("dataset", "id").offset(offset - first).limit(limit)
    return parse_entities(rows)


def storage_stats(raw: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Stored against raw bytes per dataset; ``raw(dataset, raw_bytes, row_count)``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(require_path(spark, path))
        .select(F.regexp_extract("path", r"dataset=([^/]+)/", 1).alias("dataset"), "length")
        .groupBy("dataset")
        .agg(F.sum("length").alias("binary_bytes"))
    )
    raw_size = F.greatest(F.lit(1), F.col("raw_bytes"))
    return raw.join(files, "dataset").select(
        "dataset", "row_count", "raw_bytes", "binary_bytes",
        F.greatest(F.lit(0.0), half_up((1 - F.col("binary_bytes") / raw_size) * 100, 2)).alias("compression_ratio_pct"),
        half_up(F.col("raw_bytes") / F.greatest(F.lit(1), F.col("binary_bytes")), 1).alias("storage_reduction_factor"),
    )
