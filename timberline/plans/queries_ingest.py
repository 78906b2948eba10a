"""Source and sink queries: text, CSV, Parquet."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators.normalize import head_sample as head_sample_of
from timberline.operators.scoring import score_stateless
from timberline.operators.templates import templates_vs_truth
from timberline.plans.fixture import YEAR
from timberline.plans.oracle_base import chain, cte
from timberline.plans.registry import query
from timberline.sources import corpus as CO
from timberline.sources import directory as D
from timberline.sources import parquet as PQ
from timberline.sources import text as TX

cte("raw_text", """
SELECT dataset, id, unnest(CASE WHEN event_type = 'error' THEN ['', line] ELSE [line] END) AS line FROM log_lines""", "log_lines")
cte("numbered", """
SELECT dataset, source_line, row_number() OVER (PARTITION BY dataset ORDER BY id) AS id, line FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY id, line = '' DESC) AS source_line FROM raw_text) WHERE line <> ''""", "raw_text")


@query("scan_text", chain("SELECT dataset, line FROM raw_text", "raw_text"))
def scan_text(t):
    return TX.scan_text(t.spark, t.text_dir).select("dataset", "line")


@query("line_numbering", chain("SELECT dataset, source_line, id, line FROM numbered", "numbered"))
def line_numbering(t):
    return TX.number_lines(TX.scan_text(t.spark, t.text_dir)).select("dataset", "source_line", "id", "line")


@query("head_sample", chain("SELECT dataset, id, line FROM numbered WHERE id <= 100", "numbered"))
def head_sample(t):
    return head_sample_of(TX.number_lines(TX.scan_text(t.spark, t.text_dir))).select("dataset", "id", "line")


@query("capped_scan", chain("SELECT dataset, source_line, id, line FROM numbered WHERE source_line <= 500", "numbered"))
def capped_scan(t):
    scanned = TX.scan_text(t.spark, t.text_dir)
    return TX.number_lines(scanned, max_lines=500).select("dataset", "source_line", "id", "line")


def _truth_paths(t):
    """Ground truth written as CSV from the events: lines and templates."""
    kinds = t.table("events").select("event_id", "event_type")
    lines = t.lines.join(kinds, "event_id").select(
        F.col("id").alias("LineId"), F.lit("").alias("Time"), F.lit("").alias("Level"),
        F.col("line").alias("Content"), F.concat_ws("/", "dataset", "event_type").alias("EventTemplate"),
    )
    structured, templates = t.new_path("structured"), t.new_path("templates")
    lines.write.option("header", True).csv(structured)
    (
        lines.groupBy("EventTemplate").agg(F.md5("EventTemplate").alias("EventId"))
        .select("EventId", "EventTemplate").write.option("header", True).csv(templates)
    )
    return structured, templates


@query("truth_csv", chain("SELECT dataset || '/' || event_type AS template, count(*) AS n, min(id) AS first_line FROM log_lines GROUP BY 1", "log_lines"))
def truth_csv(t):
    structured, _ = _truth_paths(t)
    truth = CO.read_structured(t.spark, structured, corrected=structured + "-corrected")
    return truth.groupBy(F.col("EventTemplate").alias("template")).agg(
        F.count(F.lit(1)).alias("n"), F.min("LineId").alias("first_line")
    )


@query("template_vs_truth", chain("""
SELECT dataset, count(DISTINCT template_id) AS discovered, count(DISTINCT event_type) AS truth FROM parsed GROUP BY 1""", "parsed"))
def template_vs_truth(t):
    _, templates = _truth_paths(t)
    truth = CO.read_truth_templates(t.spark, templates).select(
        F.substring_index("EventTemplate", "/", 1).alias("dataset"), "EventTemplate"
    )
    return templates_vs_truth(t.events, truth)


_STORED = """
SELECT dataset, id, source_id, source_line, event_key AS event_id, timestamp, timestamp_epoch, level, service, host,
 coalesce(pid, '') AS pid, message, template_id, template, array_to_string(params, '|') AS params,
 anomaly_score::FLOAT::DOUBLE AS anomaly_score, is_anomaly FROM stateless"""


def _flat(stored):
    return stored.select(
        "dataset", "id", "source_id", "source_line", "event_id", "timestamp", "timestamp_epoch", "level",
        "service", "host", "pid", "message", "template_id", "template",
        F.array_join("params", "|").alias("params"), F.col("anomaly_score").cast("double").alias("anomaly_score"),
        "is_anomaly",
    )


@query("parquet_roundtrip", chain(_STORED, "stateless"))
def parquet_roundtrip(t):
    path = t.new_path("store")
    PQ.save_events(t.stateless, path)
    return _flat(PQ.read_events(t.spark, path))


@query("append_dedupe", chain(_STORED, "stateless"))
def append_dedupe(t):
    """The first slice is stored, then everything is appended: no row twice."""
    path = t.new_path("store")
    PQ.save_events(score_stateless(t.slice(False)), path)
    PQ.append_events(t.stateless, path)
    return _flat(PQ.read_events(t.spark, path))


@query("schema_evolution", chain("""
SELECT dataset, id, '' AS source_id, 0::BIGINT AS source_line, 'legacy-' || id AS event_id, level FROM parsed_1
UNION ALL SELECT dataset, id, source_id, source_line, event_key, level FROM parsed_2""", "parsed_1", "parsed_2"))
def schema_evolution(t):
    """An old table without identity columns next to a new one."""
    path = t.new_path("store")
    old = PQ.to_stored(t.slice(False)).drop("source_id", "source_line", "event_id")
    old.write.partitionBy("dataset").parquet(path)
    PQ.save_events(t.slice(True), path, mode="append")
    return PQ.read_events(t.spark, path).select("dataset", "id", "source_id", "source_line", "event_id", "level")


@query("flag_scan", chain("SELECT dataset, count(*) AS total_rows_scanned, count(*) FILTER (is_anomaly) AS anomalies_found FROM stateless GROUP BY 1", "stateless"))
def flag_scan(t):
    path = t.new_path("store")
    PQ.save_events(t.stateless, path)
    return PQ.flag_scan(t.spark, path)


@query("slice_read", chain("""
SELECT dataset, id, level, message, block_id, req_id, ent_user AS "user" FROM parsed ORDER BY dataset, id LIMIT 50 OFFSET 20""", "parsed"))
def slice_read(t):
    path = t.new_path("store")
    PQ.save_events(t.events, path)
    return PQ.read_slice(t.spark, path, 20, 50).select(
        "dataset", "id", "level", "message", "entities.block_id", "entities.req_id", "entities.user"
    )


@query("slice_read_deep", chain("""
SELECT dataset, id, level, message FROM parsed ORDER BY dataset, id LIMIT 50 OFFSET (SELECT count(*) * 9 // 10 FROM parsed)""", "parsed"))
def slice_read_deep(t):
    """A page at nine tenths of the store: one file or two are opened, and the ids skipped to."""
    path = t.new_path("store")
    PQ.save_events(t.events, path)
    return PQ.read_slice(t.spark, path, t.events.count() * 9 // 10, 50).select("dataset", "id", "level", "message")


@query("store_directory", chain("""
SELECT dataset, source_id, count(*) AS rows, min(source_line) AS low_line, max(source_line) AS high_line, min(id) AS low_id, max(id) AS high_id
FROM parsed GROUP BY 1, 2""", "parsed"))
def store_directory(t):
    path = t.new_path("store")
    PQ.save_events(t.slice(False), path)
    D.refresh(t.spark, path)
    PQ.save_events(t.slice(True), path, mode="append")
    return D.refresh(t.spark, path).groupBy("dataset", "source_id").agg(
        F.sum("rows").alias("rows"), F.min("low_line").alias("low_line"), F.max("high_line").alias("high_line"),
        F.min("low_id").alias("low_id"), F.max("high_id").alias("high_id"))


@query("raw_bytes", chain("SELECT dataset, sum(strlen(raw) + 1)::BIGINT AS raw_bytes, count(*) AS row_count FROM parsed GROUP BY 1", "parsed"))
def raw_bytes(t):
    return TX.raw_bytes(t.events, per_line=1)


@query("storage_stats")
def storage_stats(t):
    path = t.new_path("store")
    PQ.save_events(t.stateless, path)
    return PQ.storage_stats(TX.raw_bytes(t.events), t.spark, path)


@query("storage_rows", chain("SELECT dataset, count(*) AS row_count, sum(strlen(raw))::BIGINT AS raw_bytes, true AS stored FROM parsed GROUP BY 1", "parsed"))
def storage_rows(t):
    """The part of the storage statistics that does not depend on a file format."""
    stats = storage_stats(t)
    return stats.select("dataset", "row_count", "raw_bytes", (F.col("binary_bytes") > 0).alias("stored"))


def _pick(size: int, salt: str) -> str:
    return f"(('0x' || substr(md5(n || ':{salt}'), 1, 8))::BIGINT % {size})"


@query("amplify_corpus", chain(rf"""
SELECT dataset, n, CASE WHEN contains(l2, 'R0') THEN regexp_replace(l2, 'R\d{{2}}-M\d-N\w-C:J\d{{2}}-U\d{{2}}',
  'R' || lpad((node % 16)::VARCHAR, 2, '0') || '-M' || (node % 4) || '-N' || (node % 8) || '-C:J' || lpad((node * 7 % 16)::VARCHAR, 2, '0')
  || '-U' || lpad((node * 5 % 16)::VARCHAR, 2, '0'), 'g') ELSE l2 END AS line
FROM (SELECT *, CASE WHEN contains(l1, 'req-') THEN regexp_replace(l1, 'req-[0-9a-fA-F-]+', 'req-' || (request * 31 + 10000000) || '-' || (request % 9000 + 1000), 'g') ELSE l1 END AS l2
 FROM (SELECT *, CASE WHEN contains(line, 'blk_') THEN regexp_replace(line, 'blk_-?\d+', 'blk_' || (block * 17 + 1000000000000000), 'g') ELSE line END AS l1
  FROM (SELECT *, CASE WHEN n % 10 < 7 THEN (n // 10) % 500 ELSE {_pick(500, "block")} END AS block, {_pick(200, "request")} AS request, {_pick(100, "node")} AS node
   FROM (SELECT dataset, line, unnest(range(3)) * count(*) OVER (PARTITION BY dataset) + row_number() OVER (PARTITION BY dataset ORDER BY id) - 1 AS n FROM log_lines))))""", "log_lines"))
def amplify_corpus(t):
    return CO.expand_lines(t.lines, factor=3)


@query("load_and_detect", chain("""
SELECT n.dataset, n.id, n.source_line, p.level, p.template_id FROM numbered n JOIN parsed p ON p.dataset = n.dataset AND p.id = n.id""", "numbered", "parsed"))
def load_and_detect(t):
    """Text files to events: scan, number, vote on the dialect, parse."""
    from timberline.operators.normalize import detect_and_normalize

    lines = TX.number_lines(TX.scan_text(t.spark, t.text_dir))
    return detect_and_normalize(lines, YEAR).select("dataset", "id", "source_line", "level", "template_id")
