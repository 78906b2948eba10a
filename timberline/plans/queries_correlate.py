"""Scoring, correlation, sequence and incremental queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import components as K
from timberline.operators import correlate as C
from timberline.operators import forest as FO
from timberline.operators import incremental as I
from timberline.operators import narrative as NA
from timberline.operators import scoring as SC
from timberline.operators import sequences as Q
from timberline.operators.detect import detect
from timberline.plans import oracle_pipeline as OP
from timberline.plans.oracle_base import chain, cte, half_up, q
from timberline.plans.registry import query
from timberline.session import cut
from timberline.sources import parquet as PQ


def six(column: str):
    """Six decimals: statistics agree across engines up to the order of sums."""
    return (F.floor(F.col(column) * 1e6 + 0.5) / 1e6).alias(column)


def six_sql(column: str) -> str:
    return f"{half_up(column, 6)} AS {column}"


# --------------------------------------------------------------------------- #
# Scores
# --------------------------------------------------------------------------- #
@query("template_rarity", chain(f"SELECT dataset, template_id, n, total, {six_sql('share')}, {six_sql('rarity')} FROM rarity", "rarity"))
def template_rarity(t):
    return SC.template_rarity(t.events).select("dataset", "template_id", "n", "total", six("share"), six("rarity"))


@query("mined_rarity", chain(f"SELECT dataset, template_id, n, total, {six_sql('share')}, {six_sql('rarity')} FROM rarity_mined", "rarity_mined"))
def mined_rarity(t):
    return SC.template_rarity(t.mined).select("dataset", "template_id", "n", "total", six("share"), six("rarity"))


@query("burst_buckets", chain(f"SELECT dataset, bucket::BIGINT AS bucket, n, {six_sql('mean')}, {six_sql('std')}, {six_sql('z')} FROM buckets", "buckets"))
def burst_buckets(t):
    return SC.burst_buckets(t.events).select("dataset", F.col("bucket").cast("long").alias("bucket"), "n", six("mean"), six("std"), six("z"))


@query("burst_weight", chain(f"SELECT dataset, id, {six_sql('burst')} FROM scored", "scored"))
def burst_weight(t):
    return SC.with_statistics(t.events).select("dataset", "id", six("burst"))


@query("time_delta", chain("""
SELECT dataset, id, greatest(0.0::DOUBLE, coalesce(timestamp_epoch - lag(timestamp_epoch) OVER (PARTITION BY dataset ORDER BY id), 0)) AS time_delta FROM parsed""", "parsed"))
def time_delta(t):
    return SC.with_time_delta(t.events).select("dataset", "id", "time_delta")


@query("feature_vector", chain(f"""
SELECT dataset, id, {OP.SEVNUM} AS severity_num, {six_sql('share')},
 greatest(0.0::DOUBLE, coalesce(timestamp_epoch - lag(timestamp_epoch) OVER (PARTITION BY dataset ORDER BY id), 0)) AS time_delta,
 len(params)::DOUBLE AS n_params, kw::INT::DOUBLE AS keyword, {six_sql('burst')} FROM scored""", "scored"))
def feature_vector(t):
    return SC.feature_vector(t.events).select("dataset", "id", "severity_num", six("share"), "time_delta", "n_params", "keyword", six("burst"))


@query("iforest_score")
def iforest_score(t):
    return FO.forest_scores(SC.feature_vector(t.events))


@query("anomaly_core_score", chain("SELECT dataset, id, anomaly_score, is_anomaly FROM scored", "scored"))
def anomaly_core_score(t):
    return SC.score_core(t.events).select("dataset", "id", "anomaly_score", "is_anomaly")


@query("anomaly_score")
def anomaly_score(t):
    return detect(t.events).select("dataset", "id", "anomaly_score", "is_anomaly")


# --------------------------------------------------------------------------- #
# Correlation
# --------------------------------------------------------------------------- #
@query("incident_candidates", chain("SELECT dataset, id, anomaly_score, is_anomaly FROM scored WHERE is_anomaly OR anomaly_score >= 0.60", "scored"))
def incident_candidates(t):
    return C.incident_candidates(t.scored).select("dataset", "id", "anomaly_score", "is_anomaly")


@query("signature_runs", chain("SELECT dataset, template_id, id, run_id FROM runs", "runs"))
def signature_runs(t):
    cands = C.with_entity_keys(C.incident_candidates(t.scored))
    return C.assign_runs(cands).select("dataset", "template_id", "id", "run_id")


@query("topology_edges", chain("SELECT dataset, run_a, run_b FROM links", "links"))
def topology_edges(t):
    return t.correlation.links.select("dataset", "run_a", "run_b")


@query("topology_components", chain("""
SELECT dataset, run_id, first_value(run_id) OVER (PARTITION BY dataset, root ORDER BY gidx) AS lead_id
FROM groups JOIN comps USING (gidx)""", "groups", "comps"))
def topology_components(t):
    runs = t.correlation.runs
    roots = K.connected_components(t.correlation.links.select("a", "b"))
    rooted = runs.drop("root").join(roots.withColumnRenamed("node", "gidx"), "gidx", "left").withColumn("root", F.coalesce("root", "gidx"))
    leads = runs.select(F.col("gidx").alias("root"), F.col("run_id").alias("lead_id"))
    return rooted.join(leads, "root").select("dataset", "run_id", "lead_id")


@query("incident_ranking", chain("SELECT dataset, incident_id, lead_id, peak, event_count FROM incidents", "incidents"))
def incident_ranking(t):
    return t.correlation.incidents.select("dataset", "incident_id", "lead_id", "peak", "event_count")


@query("correlate_incidents", chain("SELECT dataset, id, incident_id FROM members", "members"))
def correlate_incidents(t):
    return C.correlate(SC.score_core(t.events)).members.select("dataset", "id", "incident_id")


@query("mined_incidents", chain("SELECT dataset, id, incident_id FROM members_mined", "members_mined"))
def mined_incidents(t):
    """The whole way on mined templates: cluster, score, correlate."""
    return C.correlate(SC.score_core(t.mined)).members.select("dataset", "id", "incident_id")


@query("correlate_all", chain("SELECT id, incident_id FROM members_all", "members_all"))
def correlate_all(t):
    return C.correlate(SC.score_core(t.all_events, least=C.LEAST_SCORE)).members.select("id", "incident_id")


@query("incident_rollup", chain("""
SELECT dataset, incident_id, title, severity, confidence, summary, n_templates, n_services, start_time, end_time, event_count FROM rollup""", "rollup"))
def incident_rollup(t):
    return C.incident_rollup(t.members)


@query("incident_services", chain("SELECT DISTINCT dataset, incident_id, service FROM members WHERE service <> ''", "members"))
def incident_services(t):
    return C.incident_services(t.members)


@query("incident_entities", chain(f"SELECT DISTINCT dataset, incident_id, unnest({OP.LABELS}) AS entity FROM members", "members"))
def incident_entities(t):
    return C.incident_entities(t.members)


@query("top_evidence", chain(f"""
SELECT dataset, incident_id, rank, id AS log_id, timestamp, level, message,
 'Anomaly score ' || {OP.two_decimals('anomaly_score')} || ' - template ' || template_id AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY dataset, incident_id ORDER BY anomaly_score DESC, timestamp_epoch, id) AS rank FROM members) WHERE rank <= 8""", "members"))
def top_evidence(t):
    return C.top_evidence(t.members).withColumn("rank", F.col("rank").cast("long"))


@query("incident_evidence", chain("SELECT dataset, incident_id, id, timestamp, level, message FROM members", "members"))
def incident_evidence(t):
    return C.incident_evidence(t.members, t.events)


# --------------------------------------------------------------------------- #
# Narratives
# --------------------------------------------------------------------------- #
def _fill_sql(text: str) -> str:
    pieces = []
    while text:
        head, mark, rest = text.partition("{")
        if head:
            pieces.append(q(head))
        if not mark:
            break
        name, _, text = rest.partition("}")
        pieces.append(f"s_{name}")
    return " || ".join(pieces)


def _rule_case(field: str) -> str:
    out = []
    for n, rule in enumerate(NA.RULES):
        value = rule[field]
        sql = f"{value}::DOUBLE" if field == "confidence" else q(value) if field == "name" else _fill_sql(value)
        out.append(f"WHEN {n} THEN {sql}")
    return "CASE r " + " ".join(out) + " END"


_HAS = {w: f"bool_or(contains(lower(message), {q(w)}))" for w in NA.WORDS}
NARRATIVE = f"""
SELECT dataset, incident_id, {_rule_case('name')} AS rule, {_rule_case('title')} AS title, {_rule_case('summary')} AS summary,
 {_rule_case('cause')} AS probable_root_cause, {_rule_case('action')} AS recommended_action, {_rule_case('confidence')} AS confidence
FROM (SELECT dataset, incident_id,
 CASE WHEN {_HAS['packetresponder']} AND {_HAS['terminating']} THEN 0 WHEN {_HAS['authentication failure']} OR {_HAS['sshd']} THEN 1
  WHEN {_HAS['kernel']} OR {_HAS['ddr']} OR {_HAS['fatal']} THEN 2 WHEN {_HAS['openstack']} OR {_HAS['nova']} OR {_HAS['req-']} THEN 3 ELSE 4 END AS r,
 count(*)::VARCHAR AS s_n, arg_min(id, o) AS fid, arg_min(timestamp, o) AS s_first, arg_max(timestamp, o) AS s_last,
 '[Line ' || arg_min(id, o) || ' @ ' || arg_min(timestamp, o) || ']' AS s_ref,
 coalesce((list(block_id ORDER BY timestamp_epoch, id))[1], 'detected block') AS s_blk,
 coalesce((list(ent_user ORDER BY timestamp_epoch, id))[1], 'unknown user') AS s_user,
 coalesce(arg_min(ips[1], o) FILTER (len(ips) > 0), 'remote source') AS s_ip,
 coalesce((list(bgl_node ORDER BY timestamp_epoch, id))[1], nullif(arg_min(host, o), ''), 'node') AS s_node,
 coalesce((list(req_id ORDER BY timestamp_epoch, id))[1], 'request') AS s_req,
 arg_min(service, o) AS s_svc, arg_min(message, o) AS s_msg
 FROM (SELECT *, {{'e': timestamp_epoch, 'i': id}} AS o FROM members) GROUP BY 1, 2)"""


@query("incident_narrative", chain(NARRATIVE, "members"))
def incident_narrative(t):
    return NA.incident_narrative(t.members)


cte("told_left", NARRATIVE.replace("FROM members)", "FROM members WHERE dataset <> 'generic')"), "members")


@query("incident_abstain", chain(f"""
SELECT i.dataset, i.incident_id, n.rule IS NULL AS abstained, coalesce(n.probable_root_cause, {q(NA.NO_EVIDENCE_CAUSE)}) AS probable_root_cause,
 coalesce(n.recommended_action, {q(NA.NO_EVIDENCE_ACTION)}) AS recommended_action, coalesce(n.confidence, {NA.NO_EVIDENCE_CONFIDENCE}::DOUBLE) AS confidence
FROM incidents i LEFT JOIN told_left n USING (dataset, incident_id)""", "told_left", "incidents"))
def incident_abstain(t):
    """Incidents whose evidence is gone (here: the generic dataset was deleted) abstain."""
    left = t.members.filter(F.col("dataset") != "generic")
    return NA.with_abstention(t.correlation.incidents, NA.incident_narrative(left))


# --------------------------------------------------------------------------- #
# Sequences
# --------------------------------------------------------------------------- #
@query("entity_sessions", chain("SELECT dataset, id, template_id, session_id FROM sessions", "sessions"))
def entity_sessions(t):
    return Q.entity_sessions(t.events)


@query("transition_counts", chain("SELECT dataset, t1, t2, n FROM trans", "trans"))
def transition_counts(t):
    return Q.transition_counts(Q.transitions(t.sessions))


@query("rare_transitions", chain("SELECT dataset, session_id, log_id_a, log_id_b, t1, t2, probability FROM rare", "rare"))
def rare_transitions(t):
    return Q.rare_transitions(t.pairs)


@query("mined_transitions", chain("SELECT dataset, session_id, log_id_a, log_id_b, t1, t2, probability FROM rare_mined", "rare_mined"))
def mined_transitions(t):
    return Q.rare_transitions(Q.transitions(Q.entity_sessions(t.mined)))


cte("journeys", """
SELECT * FROM (SELECT session_id, lag(id) OVER w AS log_id_a, id AS log_id_b, lag(template_id) OVER w AS t1, template_id AS t2
FROM (SELECT p.id, p.template_id, 'account:' || e.user_id AS session_id FROM all_parsed p JOIN events e ON e.event_id = p.id - 1)
WINDOW w AS (PARTITION BY session_id ORDER BY id)) WHERE log_id_a IS NOT NULL""", "all_parsed")


@query("rare_journeys", chain(f"""
SELECT session_id, log_id_a, log_id_b, t1, t2, {half_up("n / total", 3)} AS probability FROM journeys JOIN (
 SELECT *, (sum(n) OVER (PARTITION BY t1))::BIGINT AS total FROM (SELECT t1, t2, count(*) AS n FROM journeys GROUP BY 1, 2)) USING (t1, t2)
WHERE total >= 3 AND n / total < 0.15::DOUBLE""", "journeys"))
def rare_journeys(t):
    """Rare transitions over sessions given from outside: one per account."""
    accounts = t.table("events").select(
        (F.col("event_id") + 1).alias("id"), F.concat(F.lit("account:"), F.col("user_id").cast("string")).alias("session_id")
    )
    sessions = t.all_events.select("dataset", "id", "template_id").join(accounts, "id")
    return Q.rare_transitions(Q.transitions(sessions)).drop("dataset")


@query("retry_loops", chain("SELECT dataset, session_id, event_count, first_log_id, last_log_id FROM session_sums WHERE event_count >= 4 AND n_templates = 1", "session_sums"))
def retry_loops(t):
    return Q.retry_loops(Q.session_summary(t.sessions))


@query("anomalous_sessions", chain("""
SELECT * FROM (SELECT dataset, session_id, event_count, first_log_id, last_log_id, event_count >= 4 AND n_templates = 1 AS is_retry_loop, coalesce(n, 0) AS n_unusual
 FROM session_sums LEFT JOIN (SELECT dataset, session_id, count(*) AS n FROM rare GROUP BY 1, 2) USING (dataset, session_id) WHERE event_count >= 2)
WHERE is_retry_loop OR n_unusual > 0""", "session_sums", "rare"))
def anomalous_sessions(t):
    return Q.anomalous_sessions(Q.session_summary(t.sessions), Q.rare_transitions(t.pairs))


# --------------------------------------------------------------------------- #
# Incremental
# --------------------------------------------------------------------------- #
@query("unseen_events", chain("SELECT dataset, source_line, event_key AS event_id FROM parsed_2", "parsed_2"))
def unseen_events(t):
    return I.unseen_lines(t.lines, t.slice(False)).select("dataset", "source_line", "event_id")


@query("unseen_in_store", chain("SELECT dataset, source_line, event_key AS event_id FROM parsed_2", "parsed_2"))
def unseen_in_store(t):
    path = t.new_path("store")
    PQ.save_events(SC.score_stateless(t.slice(False)), path)
    return I.unseen_in_store(t.lines, path).select("dataset", "source_line", "event_id")


@query("events_union", chain("SELECT dataset, id, event_key AS event_id FROM parsed", "parsed"))
def events_union(t):
    return I.events_union(t.slice(False), t.slice(True)).select("dataset", "id", "event_id")


@query("incident_merge", chain("SELECT dataset, candidate, candidate_number, match::VARCHAR AS match, after AS number_after FROM matches", "matches"))
def incident_merge(t):
    matches = I.match_incidents(t.first_slice.members, t.second_slice.members)
    return matches.withColumn("match", F.col("match").cast("string"))


@query("incident_carryover", chain("""
SELECT dataset, incident_id, count(*) AS event_count, count(*) FILTER (generation = 1) AS n_added,
 arg_min(timestamp, {'g': generation, 'e': timestamp_epoch, 'i': id}) AS start_time,
 arg_max(timestamp, {'g': generation, 'c': candidate_number, 'e': timestamp_epoch, 'i': id}) AS end_time
FROM merged GROUP BY 1, 2""", "merged"))
def incident_carryover(t):
    return I.carried_reports(t.merged)


@query("carried_snippets", chain("""
SELECT dataset, incident_id, place, log_id FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset, incident_id ORDER BY g, c, rank) AS place FROM (
  SELECT dataset, incident_id, rank, id AS log_id, 0 AS g, 0 AS c FROM (
   SELECT *, row_number() OVER (PARTITION BY dataset, incident_id ORDER BY anomaly_score DESC, timestamp_epoch, id) AS rank FROM members_1) WHERE rank <= 8
  UNION ALL
  SELECT m.dataset, m.incident_id, r.rank, r.id, 1, m.candidate_number FROM (
   SELECT *, row_number() OVER (PARTITION BY dataset, incident_id ORDER BY anomaly_score DESC, timestamp_epoch, id) AS rank FROM members_2) r
  JOIN merged m ON m.dataset = r.dataset AND m.id = r.id AND m.generation = 1 WHERE r.rank <= 8)) WHERE place <= 8""", "members_1", "members_2", "merged"))
def carried_snippets(t):
    moved = t.merged.filter("generation = 1").select(
        "dataset", F.col("id").alias("log_id"), "incident_id", "candidate_number"
    )
    fresh = C.top_evidence(t.second_slice.members).drop("incident_id").join(moved, ["dataset", "log_id"])
    out = I.carried_snippets(C.top_evidence(t.first_slice.members), fresh)
    return out.withColumn("place", F.col("place").cast("long"))


@query("label_union", chain(f"""
SELECT DISTINCT dataset, incident_id, 'service' AS kind, service AS label FROM merged WHERE service <> ''
UNION ALL SELECT DISTINCT dataset, incident_id, 'entity', unnest({OP.LABELS}) FROM merged""", "merged"))
def label_union(t):
    return I.label_union(t.merged)


@query("changed_incidents", chain("SELECT DISTINCT dataset, incident_id, number FROM merged WHERE generation = 1", "merged"))
def changed_incidents(t):
    return I.changed_incidents(t.merged, t.slice(True))
