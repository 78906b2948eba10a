"""Parsing queries: dialects, redaction, timestamps, headers, entities, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import masking as M
from timberline.functions import parsing as X
from timberline.functions import patterns as P
from timberline.functions import scores as S
from timberline.functions.dialects import dialect_of
from timberline.functions.text import strip
from timberline.operators import normalize as N
from timberline.operators import templates as T
from timberline.plans import oracle_pipeline as OP
from timberline.plans.oracle_base import chain, half_up, mask_sql, parse_sql, q, redact_sql
from timberline.plans.registry import query

# --------------------------------------------------------------------------- #
# Dialects
# --------------------------------------------------------------------------- #


def _like(pattern: str) -> str:
    return f"regexp_matches(line, {q(pattern)})"


DIALECT_SQL = f"""CASE
 WHEN starts_with(line, '{{') AND ends_with(line, '}}') AND json_valid(line) THEN 'json'
 WHEN {_like(P.DIALECT_HDFS)} OR contains(line, 'dfs.DataNode') OR contains(line, 'dfs.FSNamesystem') THEN 'hdfs'
 WHEN {_like(P.DIALECT_BGL)} OR (contains(line, 'NULL') AND (contains(line, 'BGL') OR contains(line, 'RAS'))) THEN 'bgl'
 WHEN {_like(P.DIALECT_ZOOKEEPER)} OR contains(line, 'QuorumPeer') OR contains(lower(line), 'zookeeper') THEN 'zookeeper'
 WHEN {_like(P.DIALECT_HADOOP)} THEN 'hadoop'
 WHEN {_like(P.DIALECT_SPARK)} THEN 'spark'
 WHEN {_like(P.DIALECT_OPENSTACK)} OR contains(line, 'req-') THEN 'openstack'
 WHEN {_like(P.DIALECT_SYSLOG)} OR contains(line, 'sshd') THEN 'syslog' END"""


@query("dialect_per_line", f"""
WITH l AS (SELECT dataset, id, line FROM ({chain('SELECT * FROM log_lines', 'log_lines')})
 UNION ALL SELECT 'props', event_id, props FROM events)
SELECT dataset, id, {DIALECT_SQL} AS dialect FROM l""")
def dialect_per_line(t):
    props = t.table("events").select(F.lit("props").alias("dataset"), F.col("event_id").alias("id"), F.col("props").alias("line"))
    lines = t.lines.select("dataset", "id", "line").unionByName(props)
    return lines.select("dataset", "id", dialect_of(strip(F.col("line"))).alias("dialect"))


_VOTES = ", ".join(f"count(*) FILTER (d = '{n}') AS n_{n}" for n in P.DIALECT_VOTE_ORDER)
_BEST = "greatest(" + ", ".join(f"n_{n}" for n in P.DIALECT_VOTE_ORDER) + ")"
_WIN = "CASE " + " ".join(f"WHEN n_{n} = best THEN '{n}'" for n in P.DIALECT_VOTE_ORDER) + " END"


@query("dialect_vote", chain(f"""
SELECT * EXCLUDE (best), CASE WHEN best / sample_count >= 0.3 THEN {_WIN} ELSE 'generic' END AS dialect,
 CASE WHEN best / sample_count >= 0.3 THEN {half_up('best / sample_count', 2)} ELSE 0.5::DOUBLE END AS confidence
FROM (SELECT *, {_BEST} AS best FROM (
 SELECT dataset, count(*) AS sample_count, {_VOTES} FROM (SELECT dataset, {DIALECT_SQL} AS d FROM log_lines) GROUP BY 1))""", "log_lines"))
def dialect_vote(t):
    return N.dialect_vote(t.lines)


# --------------------------------------------------------------------------- #
# The whole table
# --------------------------------------------------------------------------- #
@query("normalize_events", chain("""
SELECT dataset, id, source_id, source_line, event_key AS event_id, timestamp, timestamp_epoch, level, service, host, pid, message, raw,
 template, template_id, array_to_string(params, '|') AS params, block_id, req_id, bgl_node, ent_user AS "user",
 array_to_string(ips, '|') AS ips, array_to_string(registers, '|') AS registers,
 CASE WHEN hot THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS anomaly_score, hot AS is_anomaly FROM parsed""", "parsed"))
def normalize_events(t):
    def joined(name):
        return F.coalesce(F.array_join(f"entities.{name}", "|"), F.lit(""))

    return t.parsed.select(
        "dataset", "id", "source_id", "source_line", "event_id", "timestamp", "timestamp_epoch", "level",
        "service", "host", "pid", "message", "raw", "template", "template_id",
        F.array_join("params", "|").alias("params"), "entities.block_id", "entities.req_id",
        "entities.bgl_node", "entities.user", joined("ips").alias("ips"),
        joined("memory_registers").alias("registers"), "anomaly_score", "is_anomaly",
    )


_COVER = ", ".join(
    [f"count(*) FILTER (ts_format = '{n}') AS n_ts_{n}" for n in ("iso", "slash", "syslog", "compact", "epoch", "synthetic")]
    + [f"count(*) FILTER (level = '{n}') AS n_{n.lower()}" for n in ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "CRITICAL")]
    + ["count(*) FILTER (host <> 'local') AS n_host", "count(*) FILTER (service <> 'system') AS n_service"]
    + [f"count(*) FILTER ({c}) AS {n}" for c, n in (
        ("pid IS NOT NULL", "n_pid"), ("block_id IS NOT NULL", "n_block"), ("req_id IS NOT NULL", "n_request"),
        ("bgl_node IS NOT NULL", "n_node"), ("len(ips) > 0", "n_ip"), ("ent_user IS NOT NULL", "n_user"),
        ("len(registers) > 0", "n_register"))]
)


@query("parse_coverage", chain(f"SELECT dataset, count(*) AS n_rows, {_COVER} FROM parsed GROUP BY 1", "parsed"))
def parse_coverage(t):
    return N.coverage(t.events)


@query("detect_and_normalize", chain("SELECT dataset, id, level, service, host, pid, template_id FROM parsed", "parsed"))
def detect_and_normalize(t):
    from timberline.plans.fixture import YEAR

    return N.detect_and_normalize(t.lines.drop("dialect"), YEAR).select(
        "dataset", "id", "level", "service", "host", "pid", "template_id"
    )


# --------------------------------------------------------------------------- #
# Redaction, compliance
# --------------------------------------------------------------------------- #
@query("redact", f"SELECT doc_id, md5(r) AS digest, length(r) AS n_chars FROM (SELECT doc_id, {redact_sql('text')} AS r FROM documents)")
def redact(t):
    docs = X.with_steps(t.table("documents"), *X.redaction_steps("text", "r"))
    return docs.select("doc_id", F.md5("r").alias("digest"), F.length("r").cast("long").alias("n_chars"))


@query("compliance_audit", f"""
SELECT source, count(*) AS n_docs, count(*) FILTER (NOT cred) AS credentials_safe, count(*) FILTER (NOT mail) AS pii_safe,
 count(*) FILTER (NOT cred AND NOT mail) AS governance_compliant
FROM (SELECT source, regexp_matches(text, {q('(?i)' + P.CLEAR_CREDENTIAL)}) AS cred, regexp_matches(text, {q(P.ANY_EMAIL)}) AS mail FROM documents)
GROUP BY 1""")
def compliance_audit(t):
    docs = t.table("documents").select(
        "source", X.clear_credential(F.col("text")).alias("cred"), X.any_email(F.col("text")).alias("mail")
    )
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(~F.col("cred")).alias("credentials_safe"),
        F.count_if(~F.col("mail")).alias("pii_safe"),
        F.count_if(~F.col("cred") & ~F.col("mail")).alias("governance_compliant"),
    )


# --------------------------------------------------------------------------- #
# Timestamps
# --------------------------------------------------------------------------- #
def _register_ts(name: str, fmt: str) -> None:
    @query(name, chain(f"SELECT dataset, id, timestamp, timestamp_epoch FROM parsed WHERE ts_format = '{fmt}'", "parsed"))
    def run(t):
        return t.events.filter(F.col("ts_format") == fmt).select("dataset", "id", "timestamp", "timestamp_epoch")


for _name, _fmt in (("ts_iso", "iso"), ("ts_slash", "slash"), ("ts_syslog", "syslog"), ("ts_hdfs", "compact"), ("ts_epoch", "epoch")):
    _register_ts(_name, _fmt)

_URLS = "SELECT 'pages' AS dataset, 'generic' AS dialect, 'pages' AS source_id, page_id AS source_line, page_id AS id, url AS line FROM pages"


def _urls(t):
    return t.table("pages").select(
        F.lit("pages").alias("dataset"), F.lit("generic").alias("dialect"), F.lit("pages").alias("source_id"),
        F.col("page_id").alias("source_line"), F.col("page_id").alias("id"), F.col("url").alias("line"),
    )


@query("ts_fallback", f"SELECT id, timestamp, timestamp_epoch, ts_format FROM ({parse_sql(_URLS)})")
def ts_fallback(t):
    return N.normalize(_urls(t)).select("id", "timestamp", "timestamp_epoch", "ts_format")


@query("ts_resolve", chain("SELECT dataset, id, ts_format, timestamp_epoch, remainder FROM parsed", "parsed"))
def ts_resolve(t):
    from timberline.plans.fixture import YEAR

    steps = [strip(F.col("line")).alias("_line"), *X.redaction_steps("_line", "raw"), *X.timestamp_steps("raw", F.lit(YEAR))]
    return X.with_steps(t.lines, *steps).select(
        "dataset", "id", "ts_format", "timestamp_epoch", "remainder"
    )


@query("level_extract", chain("SELECT dataset, id, level FROM parsed", "parsed"))
def level_extract(t):
    return t.events.select("dataset", "id", "level")


# --------------------------------------------------------------------------- #
# Headers
# --------------------------------------------------------------------------- #
def _register_header(name: str) -> None:
    @query(f"hdr_{name}", chain(f"SELECT id, service, host, pid, message FROM parsed WHERE dataset = '{name}'", "parsed"))
    def run(t):
        return t.events.filter(F.col("dataset") == name).select("id", "service", "host", "pid", "message")


for _name in ("hdfs", "syslog", "openstack", "bgl", "zookeeper", "hadoop", "spark", "generic"):
    _register_header(_name)


@query("message_clean", chain("SELECT dataset, id, message FROM parsed", "parsed"))
def message_clean(t):
    return t.events.select("dataset", "id", "message")


# --------------------------------------------------------------------------- #
# Entities
# --------------------------------------------------------------------------- #
def _register_entity(name: str, field: str, column: str) -> None:
    @query(name, chain(f"SELECT dataset, id, host, {column} AS entity FROM parsed WHERE {column} IS NOT NULL", "parsed"))
    def run(t):
        return t.events.select("dataset", "id", "host", F.col(f"entities.{field}").alias("entity")).filter(
            F.col("entity").isNotNull()
        )


for _name, _field, _column in (
    ("ent_block", "block_id", "block_id"), ("ent_req", "req_id", "req_id"),
    ("ent_node", "bgl_node", "bgl_node"), ("ent_user", "user", "ent_user"),
):
    _register_entity(_name, _field, _column)


def _register_list(name: str, field: str, column: str) -> None:
    @query(name, chain(f"SELECT dataset, id, array_to_string({column}, '|') AS entity FROM parsed WHERE len({column}) > 0", "parsed"))
    def run(t):
        return t.events.filter(F.col(f"entities.{field}").isNotNull()).select(
            "dataset", "id", F.array_join(f"entities.{field}", "|").alias("entity")
        )


_register_list("ent_ips", "ips", "ips")
_register_list("ent_registers", "memory_registers", "registers")


@query("initial_flag", chain("SELECT dataset, id, CASE WHEN hot THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS anomaly_score, hot AS is_anomaly FROM parsed", "parsed"))
def initial_flag(t):
    return t.events.select("dataset", "id", "anomaly_score", "is_anomaly")


@query("event_identity", chain("SELECT dataset, id, event_key AS event_id FROM parsed", "parsed"))
def event_identity(t):
    return t.events.select("dataset", "id", "event_id")


# --------------------------------------------------------------------------- #
# Masking
# --------------------------------------------------------------------------- #
@query("mask_params", chain("SELECT dataset, id, array_to_string(params, '|') AS params, len(params) AS n_params, template FROM parsed", "parsed"))
def mask_params(t):
    return t.events.select(
        "dataset", "id", F.array_join("params", "|").alias("params"),
        F.size("params").cast("long").alias("n_params"), "template",
    )


@query("mask_tokens", f"SELECT page_id, array_to_string(tokens, ' ') AS tokens, len(tokens) AS n_tokens FROM ({mask_sql('SELECT page_id, url FROM pages', 'url')})")
def mask_tokens(t):
    df = t.table("pages").withColumn("pieces", M.mask_pieces(F.col("url")))
    df = df.withColumn("tokens", M.mask_tokens(M.masked_text(F.col("pieces"))))
    return df.select("page_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n_tokens"))


@query("template_leaf", chain("SELECT dataset, template, first_id, n, n_tokens, key1, key2 FROM leaves", "leaves"))
def template_leaf(t):
    return t.leaves.select("dataset", "template", "first_id", "n", F.col("n_tokens").cast("long").alias("n_tokens"), "key1", "key2")


@query("template_similarity", chain("""
SELECT dataset, template, arg_max(o_template, {'s': sim, 'f': -o_first}) AS nearest, max(sim) AS similarity FROM (
 SELECT a.dataset, a.template, b.template AS o_template, b.first_id AS o_first,
  len(list_filter(range(1, a.n_tokens + 1), lambda i: a.toks[i] = b.toks[i] AND a.toks[i] <> '<*>')) / a.n_tokens AS sim
 FROM leaves a JOIN leaves b USING (dataset, n_tokens, key1, key2) WHERE b.first_id < a.first_id)
WHERE sim >= 0.5 GROUP BY 1, 2""", "leaves"))
def template_similarity(t):
    return T.similar_templates(t.leaves)


@query("template_cluster", chain("""
SELECT dataset, template, substr(md5(founder), 1, 10) AS template_id, cluster_template FROM clustered""", "clustered"))
def template_cluster(t):
    found = T.cluster_templates(t.leaves)
    return found.select(
        "dataset", "template", M.template_id_of(F.col("founder")).alias("template_id"), "cluster_template"
    )


@query("template_signature", chain("SELECT DISTINCT dataset, template, template_id FROM parsed", "parsed"))
def template_signature(t):
    return t.events.select("dataset", "template", "template_id").distinct()


@query("mined_catalog", chain("SELECT dataset, template_id, min_by(template, id) AS template, count(*) AS size, min(id) AS first_log_id FROM parsed_mined GROUP BY 1, 2", "parsed_mined"))
def mined_catalog(t):
    return T.template_catalog(t.mined)


@query("template_catalog", chain("SELECT dataset, template_id, min_by(template, id) AS template, count(*) AS size, min(id) AS first_log_id FROM parsed GROUP BY 1, 2", "parsed"))
def template_catalog(t):
    return T.template_catalog(t.events)


@query("template_union", chain("""
SELECT dataset, template_id, arg_min(template, g) AS template FROM (
 SELECT DISTINCT dataset, template_id, template, 0 AS g FROM parsed_1 UNION ALL SELECT DISTINCT dataset, template_id, template, 1 FROM parsed_2)
GROUP BY 1, 2""", "parsed_1", "parsed_2"))
def template_union(t):
    return T.template_union(T.template_catalog(t.slice(False)), T.template_catalog(t.slice(True)))


# --------------------------------------------------------------------------- #
# Row-wise scores and keys
# --------------------------------------------------------------------------- #
@query("keyword_signal", chain(f"SELECT dataset, id, {OP.KW} AS keyword FROM parsed", "parsed"))
def keyword_signal(t):
    return t.events.select("dataset", "id", S.has_keyword(F.col("message")).alias("keyword"))


@query("stateless_score", chain("SELECT dataset, id, anomaly_score, is_anomaly FROM stateless", "stateless"))
def stateless_score(t):
    return t.stateless.select("dataset", "id", "anomaly_score", "is_anomaly")


@query("actor_key", chain(f"SELECT dataset, id, {OP.ACTOR} AS actor FROM parsed", "parsed"))
def actor_key(t):
    return t.events.select("dataset", "id", S.actor_key(F.col("entities"), F.col("service")).alias("actor"))


@query("entity_keys", chain(f"""
SELECT dataset, id, array_to_string({OP.CONCRETE}, '|') AS concrete, array_to_string({OP.WIDE}, '|') AS wide FROM parsed""", "parsed"))
def entity_keys(t):
    ent = F.col("entities")
    return t.events.select(
        "dataset", "id", F.array_join(S.concrete_keys(ent), "|").alias("concrete"),
        F.array_join(S.wide_keys(ent, F.col("service"), F.col("host")), "|").alias("wide"),
    )
