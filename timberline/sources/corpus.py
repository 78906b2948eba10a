"""Raw corpora, file inventories, ground truth and corpus growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.ordering import BLOCK, number_densely
from timberline.sources.text import load_file, path_exists, require_path

TRUTH_SCHEMA = "LineId long, Time string, Level string, Content string, EventTemplate string"
TRUTH_TEMPLATE_SCHEMA = "EventId string, EventTemplate string"


def read_raw(
    spark: SparkSession, dataset: str, path: str, max_lines: int | None = None, other_paths: tuple[str, ...] = ()
) -> DataFrame:
    """Numbered lines of a corpus: of the first of ``other_paths`` that is there (a full file), else of ``path``."""
    found = next((p for p in other_paths if path_exists(spark, p)), path)
    return load_file(spark, require_path(spark, found), max_lines, dataset)


def list_bulk_files(spark: SparkSession, folder: str) -> DataFrame:
    """``name, bytes`` of the .log, .txt and .csv files; contents are never read."""
    require_path(spark, folder)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{log,txt,csv}")
        .load(folder)
        .select(
            "path", F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes")
        )
        .orderBy(F.lower("name"), "path")
    )


def _read_truth(
    spark: SparkSession, corrected: str | None, plain: str | None, use_corrected: bool, schema: str
) -> DataFrame:
    for path in ([corrected] if use_corrected else []) + [plain]:
        if path and path_exists(spark, path):
            return spark.read.csv(path, header=True, schema=schema)
    return spark.createDataFrame([], schema)


def read_structured(
    spark: SparkSession, plain: str | None, corrected: str | None = None, use_corrected: bool = True
) -> DataFrame:
    """Ground-truth lines: corrected file first, then the plain one, else an empty table."""
    return _read_truth(spark, corrected, plain, use_corrected, TRUTH_SCHEMA)


def read_truth_templates(
    spark: SparkSession, plain: str | None, corrected: str | None = None, use_corrected: bool = True
) -> DataFrame:
    return _read_truth(spark, corrected, plain, use_corrected, TRUTH_TEMPLATE_SCHEMA)


def expand_lines(
    lines: DataFrame, factor: int, blocks: int = 500, requests: int = 200, nodes: int = 100, width: int = BLOCK
) -> DataFrame:
    """Repeat each dataset ``factor`` times with fresh ids -> ``dataset, n, line``.

    ``n`` is the 0-based position in the grown corpus. Block ids come from a
    pool, kept over runs of ten rows for seven rows in ten; request ids and
    nodes come from pools too. Picks are hashes of the position, so the result
    repeats and needs no shuffle beyond numbering the base lines.
    """
    base = number_densely(lines.select("dataset", "id", "line"), ["dataset"], "id", "pos", 0, width)
    totals = lines.groupBy("dataset").agg(F.count(F.lit(1)).alias("total"))
    grown = (
        base.join(totals, "dataset")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
        .withColumn("n", F.col("copy") * F.col("total") + F.col("pos"))
    )
    n = F.col("n")

    def pick(size: int, salt: str):
        digits = F.substring(F.md5(F.concat(n.cast("string"), F.lit(f":{salt}"))), 1, 8)
        return F.conv(digits, 16, 10).cast("long") % size

    block = F.when(n % 10 < 7, F.floor(n / 10) % blocks).otherwise(pick(blocks, "block"))
    request = pick(requests, "request")
    node = pick(nodes, "node")

    def two(value):
        return F.lpad(value.cast("string"), 2, "0")

    block_text = F.concat(F.lit("blk_"), (block * 17 + 1000000000000000).cast("string"))
    request_text = F.concat(
        F.lit("req-"), (request * 31 + 10000000).cast("string"), F.lit("-"), (request % 9000 + 1000).cast("string")
    )
    node_text = F.concat(
        F.lit("R"), two(node % 16), F.lit("-M"), (node % 4).cast("string"), F.lit("-N"), (node % 8).cast("string"),
        F.lit("-C:J"), two(node * 7 % 16), F.lit("-U"), two(node * 5 % 16),
    )
    line = F.col("line")
    for test, pattern, value in (
        ("blk_", r"blk_-?\d+", block_text),
        ("req-", r"req-[0-9a-fA-F-]+", request_text),
        ("R0", r"R\d{2}-M\d-N\w-C:J\d{2}-U\d{2}", node_text),
    ):
        line = F.when(line.contains(test), F.regexp_replace(line, F.lit(pattern), value)).otherwise(line)
    return grown.select("dataset", "n", line.alias("line"))
