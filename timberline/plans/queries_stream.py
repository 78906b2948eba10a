"""Streaming queries: each runs the stream over what is there and returns what it published."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.plans import oracle_pipeline as OP
from timberline.plans.fixture import YEAR, parts_of
from timberline.plans.oracle_base import chain, half_up
from timberline.plans.queries_ingest import _STORED, _flat
from timberline.plans.registry import query
from timberline.sources import parquet as PQ
from timberline.sources.published import read_published
from timberline.streaming import jobs as J
from timberline.streaming import runs as SR


def grain(t) -> int:
    """How many files land for one of a small table; a micro-batch takes as many more, so batches stay as they are."""
    return -(-parts_of(t.table("events")) // 4)


def landed(t, parts: int = 4, twice: bool = False) -> str:
    """Lines as files in a landing folder; ``twice`` delivers every line again."""
    path = t.new_path("landing")
    lines = t.lines.select("dataset", "dialect", "source_id", "source_line", "id", "line")
    parts = parts * grain(t)
    lines.repartition(parts).write.parquet(path)
    if twice:
        lines.repartition(parts).write.mode("append").parquet(path)
    return path


def stream_events(t, parts: int = 4):
    return J.parse_stream(J.read_lines(t.spark, landed(t, parts), files_per_trigger=2 * grain(t)), YEAR)


@query("stream_ingest", chain(_STORED, "stateless"))
def stream_ingest(t):
    out, mark = t.new_path("stream"), t.new_path("checkpoint")
    J.start_ingest(stream_events(t), out, mark).awaitTermination()
    return _flat(PQ.read_events(t.spark, out))


@query("stream_progress", chain("""
SELECT count(*) AS lines, (sum(strlen(raw) + 1))::BIGINT AS bytes, count(*) FILTER (is_anomaly) AS anomalies, 100.0::DOUBLE AS percent, true AS several_batches
FROM stateless""", "stateless"))
def stream_progress(t):
    """What the counters of a finished ingest add up to."""
    out, mark, watch = t.new_path("stream"), t.new_path("checkpoint"), t.new_path("progress")
    log = J.ProgressLog(t.spark, watch)
    t.spark.streams.addListener(log)
    try:
        run = J.start_ingest(J.observed(stream_events(t)), out, mark)
        run.awaitTermination()
        log.wait(run)
    finally:
        t.spark.streams.removeListener(log)
    total = t.stateless.agg(F.sum(F.octet_length("raw") + 1)).first()[0]
    return J.progress_numbers(t.spark, watch, total).select("lines", "bytes", "anomalies", "percent", (F.col("batches") > 1).alias("several_batches"))


cte_sql = f"""
SELECT dataset, template_id, {OP.ACTOR} AS actor, count(*) AS count, max(anomaly_score) AS peak_score, arg_min(timestamp, id) AS first_timestamp,
 arg_max(timestamp, id) AS last_timestamp, arg_min(service, id) AS service FROM stateless WHERE is_anomaly GROUP BY ALL"""


@query("incident_sketch", chain(cte_sql, "stateless"))
def incident_sketch(t):
    return J.incident_sketch(t.stateless)


@query("stream_sketch", chain(cte_sql, "stateless"))
def stream_sketch(t):
    out, mark = t.new_path("sketch"), t.new_path("checkpoint")
    J.start_sketch(stream_events(t), out, mark).awaitTermination()
    return read_published(t.spark, out, "sketch")


@query("sketch_evidence", chain(f"""
SELECT dataset, template_id, actor, place, id AS log_id, timestamp, level, message,
 'Streaming anomaly score ' || {OP.two_decimals('anomaly_score')} || ' - template ' || template_id AS reason FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset, template_id, actor ORDER BY (contains(level, 'ERROR') OR contains(level, 'FATAL')) DESC, id DESC) AS place
 FROM (SELECT *, {OP.ACTOR} AS actor FROM stateless WHERE is_anomaly)) WHERE place <= 8""", "stateless"))
def sketch_evidence(t):
    return J.sketch_evidence(t.stateless).withColumn("place", F.col("place").cast("long"))


@query("bulk_incidents", chain(f"""
SELECT dataset, 'STREAM-' || (100 + r) AS incident_id, severity[1] || lower(severity[2:]) || ' signal in ' || service AS title, severity,
 {half_up('least(0.98::DOUBLE, greatest(0.65::DOUBLE, peak_score))', 2)} AS confidence,
 format('{{:,}}', count) || ' streamed anomalous events grouped by template and ' || actor || '.' AS summary, template_id, actor,
 first_timestamp AS start_time, last_timestamp AS end_time, count AS event_count FROM (
 SELECT *, CASE WHEN peak_score >= 0.95 THEN 'CRITICAL' WHEN peak_score >= 0.80 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  row_number() OVER (PARTITION BY dataset ORDER BY peak_score DESC, count DESC, template_id, actor) AS r FROM ({cte_sql}))""", "stateless"))
def bulk_incidents(t):
    return J.bulk_incidents(J.incident_sketch(t.stateless))


@query("uniform_preview", chain("""
SELECT dataset, id, level FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5(id || ':42'), id) AS r FROM all_parsed) WHERE r <= 2000""", "all_parsed"))
def uniform_preview(t):
    return J.uniform_preview(t.all_events, most=2000).select("dataset", "id", "level")


@query("stream_dedupe", chain(_STORED, "stateless"))
def stream_dedupe(t):
    """The first slice is stored already and every line arrives twice: each ends up once."""
    out, mark = t.new_path("stream"), t.new_path("checkpoint")
    PQ.save_events(J.score_stateless(t.slice(False)), out)
    lines = J.read_lines(t.spark, landed(t, twice=True), files_per_trigger=4 * grain(t))
    J.start_dedupe(lines, out, mark, YEAR).awaitTermination()
    return _flat(PQ.read_events(t.spark, out))


def landed_in_order(t, slices: int = 4, files: int = 2) -> str:
    """Lines as files in a landing folder, slice after slice of every dataset by id."""
    path = t.new_path("landing")
    lines = t.lines.select("dataset", "dialect", "source_id", "source_line", "id", "line")
    width = F.ceil(t.events.agg(F.max("id")).first()[0] / F.lit(slices))
    for k in range(slices):
        lines.filter(F.ceil(F.col("id") / width) == k + 1).repartition(files * grain(t)).write.mode("append").parquet(path)
    return path


@query("stream_templates", chain("""
SELECT dataset, template, substr(md5(founder), 1, 10) AS template_id, cluster_template FROM clustered""", "clustered"))
def stream_templates(t):
    """Lines that land in order, four batches: the clusters are those of one pass over all of them."""
    out, mark = t.new_path("stream"), t.new_path("checkpoint")
    lines = J.read_lines(t.spark, landed_in_order(t), files_per_trigger=2 * grain(t))
    J.start_templates(J.parse_stream(lines, YEAR), out, mark).awaitTermination()
    return J.stream_templates(t.spark, out)


_QUARTERS = [f"_quarter{k}" for k in range(1, 5)]
for _k, _name in enumerate(_QUARTERS, 1):
    OP.cte(f"lines{_name}", f"SELECT * FROM parsed WHERE ceil(id / ceil((SELECT max(id) FROM parsed) / 4)) = {_k}", "parsed")
    OP.score_blocks(_name, f"lines{_name}")


@query("stream_scored", chain(
    " UNION ALL ".join(f"SELECT dataset, id, anomaly_score::FLOAT::DOUBLE AS anomaly_score, is_anomaly FROM scored{n}" for n in _QUARTERS),
    *(f"scored{n}" for n in _QUARTERS)))
def stream_scored(t):
    """Lines that land in order, four batches, each scored by its own statistics."""
    out, mark = t.new_path("stream"), t.new_path("checkpoint")
    lines = J.read_lines(t.spark, landed_in_order(t), files_per_trigger=2 * grain(t))
    J.start_scored(J.parse_stream(lines, YEAR), out, mark).awaitTermination()
    return PQ.read_events(t.spark, out).select("dataset", "id", F.col("anomaly_score").cast("double").alias("anomaly_score"), "is_anomaly")


OP.cte("scored_stream", "SELECT * FROM stateless", "stateless")
OP.correlate_blocks("_stream")


@query("stream_runs", chain("""
SELECT dataset, template_id, run_id, min(timestamp_epoch) AS start_epoch, max(timestamp_epoch) AS end_epoch, count(*) AS n_events, max(anomaly_score) AS peak
FROM runs_stream GROUP BY 1, 2, 3""", "runs_stream"))
def stream_runs(t):
    """Runs of lines that land in order, four batches; shared actors bridge gaps as in a batch job."""
    out, mark = t.new_path("stream"), t.new_path("checkpoint")
    lines = J.read_lines(t.spark, landed_in_order(t), files_per_trigger=2 * grain(t))
    SR.start_runs(J.parse_stream(lines, YEAR), out, mark).awaitTermination()
    return SR.stream_runs(t.spark, out).drop("is_open")


_SESSIONS = """
SELECT dataset, template_id, (min(timestamp_epoch) * 1000000)::BIGINT AS start_us, (max(timestamp_epoch) * 1000000)::BIGINT AS end_us,
 count(*) AS event_count, max(anomaly_score) AS peak FROM (
 SELECT *, sum(brk) OVER (PARTITION BY dataset, template_id ORDER BY timestamp_epoch, id) AS s FROM (
  SELECT *, CASE WHEN timestamp_epoch - lag(timestamp_epoch) OVER w <= 300 THEN 0 ELSE 1 END AS brk
  FROM stateless WHERE is_anomaly WINDOW w AS (PARTITION BY dataset, template_id ORDER BY timestamp_epoch, id))) GROUP BY dataset, template_id, s"""


@query("session_incidents", chain(_SESSIONS, "stateless"))
def session_incidents(t):
    out, mark = t.new_path("stream"), t.new_path("checkpoint")
    sessions = J.session_incidents(stream_events(t).filter("is_anomaly"))
    J.start_published(sessions, "sessions", out, mark).awaitTermination()
    return read_published(t.spark, out, "sessions")
