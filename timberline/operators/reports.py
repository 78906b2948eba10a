"""Filters, pages, counts and KPI reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from timberline.functions import patterns as P
from timberline.functions.text import half_up
from timberline.operators.scoring import bucket_index

MANUAL_SECONDS = 15.0
TRIAGE_SECONDS = 1.2


def by_severity(events: DataFrame, severity: str) -> DataFrame:
    return events.filter(F.upper("level") == severity.upper())


def anomalies_only(events: DataFrame) -> DataFrame:
    return events.filter("is_anomaly")


def by_template(events: DataFrame, template_id: str) -> DataFrame:
    return events.filter(F.col("template_id") == template_id)


def text_search(events: DataFrame, text: str) -> DataFrame:
    needle = text.lower()

    def holds(column: Column) -> Column:
        return F.lower(column).contains(needle)

    return events.filter(
        holds(F.col("message")) | holds(F.col("service")) | holds(F.to_json("entities"))
    )


def log_search(
    events: DataFrame, severity: str | None = None, anomalies: bool = False,
    template_id: str | None = None, text: str | None = None,
) -> DataFrame:
    if severity:
        events = by_severity(events, severity)
    if anomalies:
        events = anomalies_only(events)
    if template_id:
        events = by_template(events, template_id)
    if text:
        events = text_search(events, text)
    return events


def log_page(events: DataFrame, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(number of matches, one page in log order); at most 500 rows a page."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1-500 and offset not negative")
    total = events.agg(F.count(F.lit(1)).alias("total"))
    return total, events.orderBy("dataset", "id").offset(offset).limit(limit)


def level_breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy("dataset", "level").agg(F.count(F.lit(1)).alias("n"))


def timeline(events: DataFrame, spans: DataFrame, buckets: int = 30) -> DataFrame:
    """Equal-width buckets over each dataset's time, empty ones included.

    ``spans`` is the one-row-per-dataset table of ``time_spans``.
    """
    spans = spans.select(
        "dataset", "min_epoch", (F.col("span") / F.lit(buckets)).alias("width")
    )
    indexed = events.select("dataset", "id", "timestamp", "timestamp_epoch", "is_anomaly").join(
        spans, "dataset"
    ).withColumn(
        "bucket_idx",
        bucket_index(F.col("timestamp_epoch"), F.col("min_epoch"), F.col("width"), F.lit(buckets)),
    )
    label = F.substring(F.substring_index("timestamp", "T", -1), 1, 8)
    counted = indexed.groupBy("dataset", "bucket_idx").agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if("is_anomaly").alias("anomaly_count"),
        F.min(F.when(F.col("timestamp") != "", F.struct(F.col("id"), label.alias("label")))).alias("_first"),
    )
    spine = spans.withColumn("bucket_idx", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return spine.join(counted, ["dataset", "bucket_idx"], "left").select(
        "dataset", "bucket_idx",
        (F.col("min_epoch") + F.col("bucket_idx") * F.col("width")).alias("start_epoch"),
        F.coalesce("total_count", F.lit(0)).alias("total_count"),
        F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
        F.coalesce("_first.label", F.lit("")).alias("timestamp_label"),
    )


def kpi_metrics(events: DataFrame, incidents: DataFrame, elapsed: float = 0.5) -> DataFrame:
    """Triage numbers per dataset; ``elapsed`` is the pipeline's run time in seconds."""
    logs = events.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("raw_logs_count"), F.count_if("is_anomaly").alias("anomalies_count")
    )
    templates = events.select("dataset", "template_id").distinct().groupBy("dataset").agg(
        F.count(F.lit(1)).alias("templates_count")
    )
    found = incidents.groupBy("dataset").agg(F.count(F.lit(1)).alias("_inc"))
    df = logs.join(templates, "dataset").join(found, "dataset", "left").withColumn(
        "incidents_count", F.coalesce("_inc", F.lit(0))
    )
    anomalies, inc = F.col("anomalies_count"), F.col("incidents_count")
    noise = half_up((1.0 - inc / F.greatest(F.lit(1), anomalies)) * 100, 2)
    manual = half_up(anomalies * MANUAL_SECONDS, 1)
    assisted = half_up(F.lit(elapsed) + inc * TRIAGE_SECONDS, 2)
    df = df.withColumn("manual_sec", manual).withColumn("assisted_sec", assisted)
    return df.select(
        "dataset", "raw_logs_count", "templates_count", "anomalies_count", "incidents_count",
        F.greatest(F.lit(0.0), F.least(F.lit(99.9), noise)).alias("noise_reduction_ratio"),
        "manual_sec", "assisted_sec",
        half_up(F.col("manual_sec") / F.greatest(F.lit(0.1), F.col("assisted_sec")), 1).alias("triage_speedup"),
    )


TRIAGE_NOTE = (
    "Manual review is modeled at 15 seconds per anomalous log; it is not a human-timed study."
)


def overview(events: DataFrame, incidents: DataFrame, formats: DataFrame, elapsed: float = 0.5) -> DataFrame:
    """KPIs, detected format and counts per level, one row per dataset."""
    levels = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "CRITICAL")
    counts = events.groupBy("dataset").agg(
        *[F.count_if(F.col("level") == name).alias(f"n_{name.lower()}") for name in levels]
    )
    return (
        kpi_metrics(events, incidents, elapsed)
        .join(counts, "dataset")
        .join(formats.select("dataset", F.col("dialect").alias("detected_format")), "dataset", "left")
        .withColumn("triage_baseline", F.lit(TRIAGE_NOTE))
    )


def precision_at_k(events: DataFrame, k: int = 20) -> DataFrame:
    """Share of the ``k`` best-scored events per dataset that look like true failures."""
    order = Window.partitionBy("dataset").orderBy(F.desc("anomaly_score"), "id")
    top = events.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    message = F.lower("message")
    hit = (
        F.col("level").isin(*P.HOT_LEVELS, "WARN")
        | message.contains("fail")
        | message.contains("exception")
    )
    return top.groupBy("dataset").agg(half_up(F.avg(hit.cast("double")), 3).alias("precision_at_k"))


def benchmark_summary(
    events: DataFrame, incidents: DataFrame, narratives: DataFrame, formats: DataFrame,
    elapsed: float = 0.5, k: int = 20,
) -> DataFrame:
    """One row per dataset over the whole pipeline output."""
    told = narratives.select("dataset", "incident_id", F.col("title").alias("told"), "probable_root_cause")
    lead = (
        incidents.filter(F.col("number") == 101).select("dataset", "incident_id")
        .join(told, ["dataset", "incident_id"], "left")
    )
    return (
        kpi_metrics(events, incidents, elapsed)
        .join(precision_at_k(events, k).withColumnRenamed("precision_at_k", "precision_at_20"), "dataset")
        .join(formats.select("dataset", F.col("dialect").alias("detected_dialect")), "dataset", "left")
        .join(lead, "dataset", "left")
        .select(
            F.upper("dataset").alias("dataset"), "detected_dialect",
            F.col("raw_logs_count").alias("total_logs"),
            F.col("templates_count").alias("templates_discovered"),
            F.col("anomalies_count").alias("anomalies_flagged"),
            F.col("incidents_count").alias("incidents_formed"),
            F.col("noise_reduction_ratio").alias("noise_reduction_pct"), "precision_at_20",
            F.col("manual_sec").alias("manual_triage_sec"), F.col("assisted_sec").alias("assisted_triage_sec"),
            F.concat(F.format_string("%.1f", "triage_speedup"), F.lit("x")).alias("speedup_factor"),
            F.coalesce("told", F.lit("None")).alias("top_incident_title"),
            F.coalesce("probable_root_cause", F.lit("N/A")).alias("top_incident_root_cause"),
        )
    )


def incident_page(rollup: DataFrame, offset: int = 0, limit: int = 12) -> DataFrame:
    """Board order: severity, confidence, size, start; one page of at most 100 rows."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be 1-100 and offset not negative")
    rank = F.lit(4)
    for at, name in reversed(list(enumerate(("CRITICAL", "HIGH", "MEDIUM", "LOW")))):
        rank = F.when(F.upper("severity") == name, at).otherwise(rank)
    return (
        rollup.withColumn("severity_rank", rank)
        .orderBy(
            "severity_rank", F.desc("confidence"), F.desc("event_count"),
            F.coalesce("start_time", F.lit("")), "dataset", "incident_id",
        )
        .offset(offset)
        .limit(limit)
    )
