"""Lines -> typed events, coverage and dialect votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions import masking as M
from timberline.functions import parsing as X
from timberline.functions import patterns as P
from timberline.functions.dialects import dialect_of
from timberline.functions.text import half_up, pin, strip

def syslog_year(dataset: Column, prefix_rule: bool = False) -> Column:
    """Year of syslog lines by dataset name; null means the current year.

    ``prefix_rule`` is the bulk-file rule: every name that starts with linux.
    """
    name = F.lower(dataset)
    if prefix_rule:
        return F.when(name.startswith("linux"), F.lit(P.SYSLOG_YEARS["linux"]))
    year = F.lit(None).cast("int")
    for known, value in P.SYSLOG_YEARS.items():
        year = F.when(name == known, F.lit(value)).otherwise(year)
    return year


def normalize(
    lines: DataFrame, dialect: Column | str = "dialect", year: Column | int | None = None, where: Column | str | None = None
) -> DataFrame:
    """Parse a table of lines (batch or stream) into events, in one projection.

    Needs ``dataset, source_id, source_line, id, line``; ``dialect`` is a column
    or a column name, so one job can parse corpora of several dialects. A
    condition ``where`` on those columns reaches the scan; filters above the
    parsed events do not, as they would repeat every parsing step.
    """
    if where is not None:
        lines = lines.filter(where)
    dialect = F.col(dialect) if isinstance(dialect, str) else dialect
    year = syslog_year(F.col("dataset")) if year is None else year
    year = F.lit(year) if isinstance(year, int) else year
    host = F.col("_host")
    given = [F.col(name) for name in ("dataset", "id", "source_id", "source_line")]
    df = lines.select(
        *given,
        strip(F.col("line")).alias("_line"),
        dialect.alias("_dialect"),
        *X.redaction_steps("_line", "raw"),
        *X.timestamp_steps("raw", year),
        *X.level_steps(),
        *X.header_steps(F.col("_dialect")),
        *X.message_steps(),
        *X.entity_steps(),
        F.when(host == "local", F.coalesce("entities.bgl_node", host)).otherwise(host).alias("host"),
        *M.template_steps(),
        X.event_identity(F.col("source_id"), F.col("source_line"), F.col("_line")).alias("event_id"),
        X.initially_anomalous(F.col("level")).alias("is_anomaly"),
        F.when(F.col("is_anomaly"), F.lit(0.8)).otherwise(F.lit(0.0)).alias("anomaly_score"),
    )
    return df.select(*given, *[pin(name) for name in EVENT_COLUMNS[4:]])


EVENT_COLUMNS = (
    "dataset", "id", "source_id", "source_line", "event_id", "timestamp", "timestamp_epoch", "level",
    "service", "host", "pid", "message", "template_id", "template", "params", "entities", "raw",
    "anomaly_score", "is_anomaly", "ts_format",
)


def coverage(events: DataFrame) -> DataFrame:
    """Per dataset: how much of it each parsing rule reached."""

    def hits(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    formats = ("iso", "slash", "syslog", "compact", "epoch", "synthetic")
    levels = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "CRITICAL")
    ent = F.col("entities")
    return events.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[hits(F.col("ts_format") == name, f"n_ts_{name}") for name in formats],
        *[hits(F.col("level") == name, f"n_{name.lower()}") for name in levels],
        hits(F.col("host") != "local", "n_host"),
        hits(F.col("service") != "system", "n_service"),
        hits(F.col("pid").isNotNull(), "n_pid"),
        hits(ent["block_id"].isNotNull(), "n_block"),
        hits(ent["req_id"].isNotNull(), "n_request"),
        hits(ent["bgl_node"].isNotNull(), "n_node"),
        hits(ent["ips"].isNotNull(), "n_ip"),
        hits(ent["user"].isNotNull(), "n_user"),
        hits(ent["memory_registers"].isNotNull(), "n_register"),
    )


def head_sample(lines: DataFrame, limit: int = 100) -> DataFrame:
    """First ``limit`` non-blank lines per dataset (ids are dense over those)."""
    return lines.filter((F.col("id") <= limit) & (strip(F.col("line")) != ""))


def dialect_vote(lines: DataFrame, voters: int | None = None, floor: float = 0.3) -> DataFrame:
    """Winning dialect per dataset from all its non-blank lines, or from the first ``voters``.

    One aggregate without a sort; votes are counted before they are shuffled.
    """
    asked = lines.filter(strip(F.col("line")) != "") if voters is None else head_sample(lines, voters)
    sample = asked.select("dataset", dialect_of(strip(F.col("line"))).alias("_vote"))
    names = P.DIALECT_VOTE_ORDER
    counts = sample.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("sample_count"),
        *[F.count_if(F.col("_vote") == name).alias(f"n_{name}") for name in names],
    )
    best = F.greatest(*[F.col(f"n_{name}") for name in names])
    winner = F.lit(None).cast("string")
    for name in reversed(names):
        winner = F.when(F.col(f"n_{name}") == F.col("_best"), name).otherwise(winner)
    share = F.col("_best") / F.col("sample_count")
    return (
        counts.withColumn("_best", best)
        .withColumn("dialect", F.when(share >= floor, winner).otherwise("generic"))
        .withColumn("confidence", F.when(share >= floor, half_up(share, 2)).otherwise(0.5))
        .drop("_best")
    )


def detect_and_normalize(lines: DataFrame, year: Column | int | None = None) -> DataFrame:
    """Vote per dataset, then parse each line with its dataset's dialect."""
    votes = dialect_vote(lines).select("dataset", F.col("dialect").alias("_voted"))
    voted = lines.join(votes, "dataset", "left").withColumn(
        "dialect", F.coalesce("_voted", F.lit("generic"))
    )
    return normalize(voted, "dialect", year)
