"""Filter, count and KPI queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import reports as RP
from timberline.operators import scoring as SC
from timberline.operators.normalize import dialect_vote
from timberline.plans.oracle_base import chain, half_up, q
from timberline.plans.queries_correlate import NARRATIVE, six
from timberline.plans.queries_parse import _BEST, _VOTES, _WIN, DIALECT_SQL
from timberline.plans.registry import query

TOP_TEMPLATE = "(SELECT template_id FROM parsed GROUP BY 1 ORDER BY count(*) DESC, template_id LIMIT 1)"
SEARCH = "contains(lower(message), 'u12') OR contains(lower(service), 'u12') OR contains(lower(coalesce(ent_user, '')), 'u12')"


def top_template(t) -> str:
    """Id of the most frequent template (one row reaches the driver)."""
    counts = t.events.groupBy("template_id").count().orderBy(F.desc("count"), "template_id")
    return counts.first()["template_id"]


@query("log_severity", chain("SELECT dataset, id, level FROM scored WHERE level = 'ERROR'", "scored"))
def log_severity(t):
    return RP.by_severity(t.scored, "error").select("dataset", "id", "level")


@query("log_anomalies_only", chain("SELECT dataset, id, anomaly_score FROM scored WHERE is_anomaly", "scored"))
def log_anomalies_only(t):
    return RP.anomalies_only(t.scored).select("dataset", "id", "anomaly_score")


@query("log_by_template", chain(f"SELECT dataset, id, template_id FROM parsed WHERE template_id = {TOP_TEMPLATE}", "parsed"))
def log_by_template(t):
    return RP.by_template(t.events, top_template(t)).select("dataset", "id", "template_id")


@query("log_text_search", chain(f"SELECT dataset, id, message FROM parsed WHERE {SEARCH}", "parsed"))
def log_text_search(t):
    return RP.text_search(t.events, "U12").select("dataset", "id", "message")


@query("log_search", chain(f"SELECT dataset, id, message FROM scored WHERE level = 'ERROR' AND is_anomaly AND ({SEARCH})", "scored"))
def log_search(t):
    """Searched while it is scored: level and text are tested before a line moves to its template's rarity."""
    return RP.log_search(SC.score_core(t.events), severity="ERROR", anomalies=True, text="u12").select("dataset", "id", "message")


@query("log_page", chain("""
SELECT dataset, id, message, (SELECT count(*) FROM scored WHERE is_anomaly) AS total FROM scored WHERE is_anomaly ORDER BY dataset, id LIMIT 50 OFFSET 100""", "scored"))
def log_page(t):
    total, page = RP.log_page(RP.anomalies_only(t.scored), offset=100, limit=50)
    return page.select("dataset", "id", "message", F.lit(total.first()["total"]).cast("long").alias("total"))


@query("level_breakdown", chain("SELECT dataset, level, count(*) AS n FROM parsed GROUP BY 1, 2", "parsed"))
def level_breakdown(t):
    return RP.level_breakdown(t.events)


@query("timeline", chain(f"""
SELECT dataset, b::BIGINT AS bucket_idx, {half_up('min_epoch + b * width', 6)} AS start_epoch, coalesce(total_count, 0) AS total_count, coalesce(anomaly_count, 0) AS anomaly_count,
 coalesce(label, '') AS timestamp_label FROM (SELECT dataset, min_epoch, span / 30 AS width, unnest(range(30)) AS b FROM spans)
LEFT JOIN (SELECT dataset, b, count(*) AS total_count, count(*) FILTER (is_anomaly) AS anomaly_count,
  arg_min(substr(split_part(timestamp, 'T', -1), 1, 8), id) AS label FROM (
   SELECT *, least(29, floor((timestamp_epoch - min_epoch) / (span / 30))::INT) AS b FROM scored JOIN spans USING (dataset)) GROUP BY 1, 2)
USING (dataset, b)""", "spans", "scored"))
def timeline(t):
    df = RP.timeline(t.scored, SC.time_spans(t.scored))
    return df.select(
        "dataset", F.col("bucket_idx").cast("long").alias("bucket_idx"), six("start_epoch"), "total_count",
        "anomaly_count", "timestamp_label",
    )


@query("kpi_metrics", chain("SELECT * FROM kpis", "kpis"))
def kpi_metrics(t):
    return RP.kpi_metrics(t.scored, t.correlation.incidents)


_FORMATS = f"""
SELECT dataset, CASE WHEN best / sample_count >= 0.3 THEN {_WIN} ELSE 'generic' END AS dialect FROM (SELECT *, {_BEST} AS best FROM (
 SELECT dataset, count(*) AS sample_count, {_VOTES} FROM (SELECT dataset, {DIALECT_SQL} AS d FROM log_lines) GROUP BY 1))"""
_LEVELS = ", ".join(f"count(*) FILTER (level = '{n}') AS n_{n.lower()}" for n in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "CRITICAL"))


@query("overview", chain(f"""
SELECT k.*, l.* EXCLUDE (dataset), f.dialect AS detected_format, {q(RP.TRIAGE_NOTE)} AS triage_baseline
FROM kpis k JOIN (SELECT dataset, {_LEVELS} FROM scored GROUP BY 1) l USING (dataset) JOIN ({_FORMATS}) f USING (dataset)""", "kpis", "scored", "log_lines"))
def overview(t):
    return RP.overview(t.scored, t.correlation.incidents, dialect_vote(t.lines))


_PRECISION = f"""
SELECT dataset, {half_up("avg(hit::INT)", 3)} AS p FROM (
 SELECT dataset, level IN ('ERROR', 'FATAL', 'CRITICAL', 'WARN') OR contains(lower(message), 'fail') OR contains(lower(message), 'exception') AS hit,
  row_number() OVER (PARTITION BY dataset ORDER BY anomaly_score DESC, id) AS r FROM scored) WHERE r <= 20 GROUP BY 1"""


@query("precision_at_k", chain(f"SELECT dataset, p AS precision_at_k FROM ({_PRECISION})", "scored"))
def precision_at_k(t):
    return RP.precision_at_k(t.scored, 20)


@query("benchmark_summary", chain(f"""
SELECT upper(k.dataset) AS dataset, f.dialect AS detected_dialect, raw_logs_count AS total_logs, templates_count AS templates_discovered,
 anomalies_count AS anomalies_flagged, incidents_count AS incidents_formed, noise_reduction_ratio AS noise_reduction_pct, p.p AS precision_at_20,
 manual_sec AS manual_triage_sec, assisted_sec AS assisted_triage_sec, printf('%.1f', triage_speedup) || 'x' AS speedup_factor,
 coalesce(n.title, 'None') AS top_incident_title, coalesce(n.probable_root_cause, 'N/A') AS top_incident_root_cause
FROM kpis k JOIN ({_PRECISION}) p USING (dataset) JOIN ({_FORMATS}) f USING (dataset)
LEFT JOIN incidents i ON i.dataset = k.dataset AND i.number = 101
LEFT JOIN ({NARRATIVE}) n ON n.dataset = i.dataset AND n.incident_id = i.incident_id""", "kpis", "scored", "log_lines", "incidents", "members"))
def benchmark_summary(t):
    return RP.benchmark_summary(t.scored, t.correlation.incidents, t.narratives, dialect_vote(t.lines))


@query("incident_page", chain("""
SELECT dataset, incident_id, title, severity, confidence, event_count, start_time FROM rollup
ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 4 END, confidence DESC, event_count DESC, start_time, dataset, incident_id
LIMIT 12 OFFSET 12""", "rollup"))
def incident_page(t):
    return RP.incident_page(t.rollup, offset=12, limit=12).select(
        "dataset", "incident_id", "title", "severity", "confidence", "event_count", "start_time"
    )


@query("failing_shapes", chain("""
SELECT dataset, template_id, min_by(template, id) AS template, count(*) AS n_failures, max(anomaly_score) AS peak
FROM stateless WHERE is_anomaly GROUP BY 1, 2""", "stateless"))
def failing_shapes(t):
    return failing_shapes_of(t.stateless)


def failing_shapes_of(events):
    """Which message shapes produce the failures?"""
    return RP.anomalies_only(events).groupBy("dataset", "template_id").agg(
        F.min_by("template", "id").alias("template"), F.count(F.lit(1)).alias("n_failures"),
        F.max("anomaly_score").alias("peak"),
    )


