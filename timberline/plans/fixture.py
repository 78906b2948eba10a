"""Log lines rendered by Spark from the ``events`` table.

Eight datasets, one per dialect, in event order. Rules are deterministic and
row-wise; only the packed events are dealt out, since a file of them holds lines for many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import prepare

DATASETS = ("hdfs", "syslog", "openstack", "bgl", "zookeeper", "hadoop", "spark", "generic")
YEAR = 2024
#: Lines of one task or landed file: a line takes far longer to parse than its packed event to read.
LINES_A_TASK = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def parts_of(events: DataFrame) -> int:
    """Tasks for the lines of ``events``; the rows are counted from the file footers."""
    return max(1, -(-events.count() // LINES_A_TASK))


def _two(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def log_lines(spark: SparkSession, sf_dir: str, single: bool = False) -> DataFrame:
    """``dataset, dialect, source_id, source_line, id, line``.

    ``single`` puts every row into one dataset ``all`` in event order.
    """
    ev = table(spark, sf_dir, "events")
    if (parts := parts_of(ev)) > 1:
        ev = ev.repartition(parts)
    eid, uid = F.col("event_id"), F.col("user_id")
    ts = F.col("ts").cast("timestamp")

    def text(number: Column) -> Column:
        return number.cast("string")

    dialect = F.element_at(F.array(*[F.lit(d) for d in DATASETS]), (eid % 8 + 1).cast("int"))
    kind = F.col("event_type")
    lvl = (
        F.when(kind == "error", "ERROR")
        .when((kind == "signup") & (F.col("value") >= 200), "WARN")
        .when(kind == "view", "DEBUG")
        .otherwise("INFO")
    )
    ip = F.concat(F.lit("10.0."), text(uid % 8), F.lit("."), text(eid % 250))
    body = (
        F.when(
            kind == "error",
            F.concat(
                F.lit("request req-"), F.substring(F.md5(text(uid)), 1, 8), F.lit(" failed for user u"),
                text(uid), F.lit(" from "), ip, F.lit(" after "), text(eid % 7), F.lit(" retries"),
            ),
        )
        .when(kind == "signup", F.concat(F.lit("user u"), text(uid), F.lit(" registered from "), ip))
        .when(
            kind == "purchase",
            F.concat(
                F.lit("stored block blk_"), text(uid % 40 + 1000), F.lit(" of size "),
                text(F.floor(F.col("value") * 100)), F.lit(" at 0x"), F.substring(F.md5(text(eid)), 1, 8),
            ),
        )
        .when(kind == "click", F.concat(F.lit("opened /var/data/u"), text(uid), F.lit("/page"), text(eid % 20)))
        .otherwise(F.concat(F.lit("heartbeat ok seq "), text(eid)))
    )
    node = F.concat(
        F.lit("R"), _two(uid % 16), F.lit("-M"), text(uid % 2), F.lit("-N"), text(uid % 8),
        F.lit("-C:J"), _two(uid % 18), F.lit("-U"), _two(uid % 12),
    )
    df = ev.select(
        "event_id", "user_id", ts.alias("ts"), dialect.alias("dialect"), lvl.alias("lvl"),
        body.alias("body"), node.alias("node"),
    )
    lvl, body, node, ts = F.col("lvl"), F.col("body"), F.col("node"), F.col("ts")

    def at(pattern: str) -> Column:
        return F.date_format(ts, pattern)

    day_time, milli = at("yyyy-MM-dd HH:mm:ss"), at("SSS")
    d = F.col("dialect")
    line = (
        F.when(d == "hdfs", F.concat(at("yyMMdd HHmmss"), F.lit(" "), text(uid + 100), F.lit(" "), lvl,
                                     F.lit(" dfs.DataNode$Worker: "), body))
        .when(d == "syslog", F.concat(at("MMM dd HH:mm:ss"), F.lit(" host"), text(uid % 5), F.lit(" sshd["),
                                      text(uid + 1000), F.lit("]: "), lvl, F.lit(" "), body))
        .when(d == "openstack", F.concat(day_time, F.lit("."), milli, F.lit(" "), text(uid + 2000), F.lit(" "),
                                         lvl, F.lit(" nova.compute.manager "), body))
        .when(d == "bgl", F.concat(F.lit("- "), text(F.unix_timestamp(ts)), F.lit(" "), at("yyyy.MM.dd"),
                                   F.lit(" "), node, F.lit(" "), at("yyyy-MM-dd-HH.mm.ss.SSSSSS"), F.lit(" "),
                                   node, F.lit(" RAS KERNEL "), lvl, F.lit(" "), body))
        .when(d == "zookeeper", F.concat(day_time, F.lit(","), milli, F.lit(" - "), lvl,
                                         F.lit("  [main:QuorumPeer@101] - "), body))
        .when(d == "hadoop", F.concat(day_time, F.lit(","), milli, F.lit(" "), lvl,
                                      F.lit(" [main] org.apache.hadoop.mapreduce.v2.app.MRAppMaster: "), body))
        .when(d == "spark", F.concat(at("yy/MM/dd HH:mm:ss"), F.lit(" "), lvl, F.lit(" executor.Executor: "), body))
        .otherwise(F.concat(at("yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), lvl, F.lit(" api: "), body))
    )
    dataset = F.lit("all") if single else d
    number = (eid + 1) if single else (F.floor(eid / 8) + 1)
    return df.select(
        dataset.alias("dataset"), d.alias("dialect"), dataset.alias("source_id"),
        number.cast("long").alias("source_line"), number.cast("long").alias("id"),
        line.alias("line"), "event_id",
    )
