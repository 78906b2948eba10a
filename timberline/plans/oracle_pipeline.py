"""DuckDB blocks for scoring, correlation, sequences and retrieval."""

from __future__ import annotations

from timberline.functions import patterns as P
from timberline.plans.oracle_base import case_of, ci, cte, half_up, q

KW = f"regexp_matches(message, {ci(P.KEYWORDS)})"
SEV = case_of("upper(level)", P.SEVERITY_BASE, P.SEVERITY_BASE_OTHER)
SEVNUM = case_of("upper(level)", P.SEVERITY_NUMBER, P.SEVERITY_NUMBER_OTHER)

CONCRETE = (
    "list_filter(['block_id:' || block_id, 'req_id:' || req_id, 'user:' || ent_user, 'bgl_node:' || bgl_node],"
    " lambda x: x IS NOT NULL)"
)
WIDE = (
    "list_filter(['block_id:' || block_id, 'req_id:' || req_id, 'user:' || ent_user, 'bgl_node:' || bgl_node,"
    " CASE WHEN service <> '' THEN 'svc:' || service END,"
    " CASE WHEN host <> '' AND host <> 'local' THEN 'host:' || host END], lambda x: x IS NOT NULL)"
)
LABELS = (
    "list_filter(['block_id:' || block_id, 'req_id:' || req_id, 'bgl_node:' || bgl_node, 'user:' || ent_user,"
    " CASE WHEN host <> '' AND host <> 'local' THEN 'host:' || host END], lambda x: x IS NOT NULL)"
    " || coalesce(all_block_ids, []) || ips || registers"
)
ACTOR = (
    "coalesce('block_id:' || block_id, 'req_id:' || req_id, 'user:' || ent_user, 'bgl_node:' || bgl_node,"
    " 'service:' || coalesce(nullif(service, ''), 'unknown'))"
)
SESSION = (
    "coalesce('block:' || block_id, 'req:' || req_id, 'user:' || ent_user,"
    " CASE WHEN host <> '' AND host <> 'local' THEN 'host:' || host END, 'svc:' || service)"
)
STATELESS_SCORE = half_up(
    f"greatest(CASE WHEN hot THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END, least(1.0::DOUBLE, ({SEV}) + CASE WHEN {KW} THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END))", 3
)
TWO = "printf('%d.%02d', (floor({0} * 100 + 0.5)::BIGINT) // 100, (floor({0} * 100 + 0.5)::BIGINT) % 100)"


def two_decimals(expr: str) -> str:
    return TWO.format(expr)


def score_blocks(p: str, source: str) -> None:
    """rarity_p, spans_p, buckets_p, scored_p over the parsed block ``source``."""
    cte(f"rarity{p}", f"""
SELECT dataset, template_id, n, total, n / total AS share, greatest(0.0::DOUBLE, 1.0::DOUBLE - (n / total) * 10.0::DOUBLE) AS rarity
FROM (SELECT dataset, template_id, count(*) AS n, (sum(count(*)) OVER (PARTITION BY dataset))::BIGINT AS total
      FROM {source} GROUP BY 1, 2)""", source)
    cte(f"spans{p}", f"""
SELECT *, span / n_buckets AS bucket_size FROM (
 SELECT *, greatest(10, least(100, floor(span / 30.0::DOUBLE)::INT)) AS n_buckets FROM (
  SELECT dataset, min(timestamp_epoch) AS min_epoch, max(timestamp_epoch) AS max_epoch, count(*) AS n_rows,
    greatest(1.0::DOUBLE, max(timestamp_epoch) - min(timestamp_epoch)) AS span FROM {source} GROUP BY 1))""", source)
    cte(f"buckets{p}", f"""
SELECT *, CASE WHEN z > 1 THEN least(0.35::DOUBLE, z * 0.10::DOUBLE) ELSE 0.0::DOUBLE END AS weight FROM (
 SELECT *, (n - mean) / std AS z FROM (
  SELECT dataset, bucket, n, mean, sqrt(greatest(0.0::DOUBLE, squares / n_buckets - mean * mean)) + 1e-5::DOUBLE AS std FROM (
   SELECT *, (sum(n) OVER w)::BIGINT / n_buckets AS mean, (sum(n * n) OVER w)::BIGINT AS squares FROM (
    SELECT dataset, n_buckets, least(n_buckets - 1, floor((timestamp_epoch - min_epoch) / bucket_size)::INT) AS bucket, count(*) AS n
    FROM {source} JOIN spans{p} USING (dataset) WHERE max_epoch > min_epoch GROUP BY ALL)
   WINDOW w AS (PARTITION BY dataset))))""", source, f"spans{p}")
    cte(f"scored{p}", f"""
SELECT *, anomaly_score >= 0.55 OR (kw AND sev >= 0.50) OR sev >= 0.80 AS is_anomaly FROM (
 SELECT *, {half_up("least(1.0::DOUBLE, greatest(0.0::DOUBLE, sev + CASE WHEN kw THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + rarity * 0.20::DOUBLE + burst))", 3)} AS anomaly_score FROM (
  SELECT e.*, {KW} AS kw, {SEV} AS sev, r.rarity, r.share, coalesce(b.weight, 0.0::DOUBLE) AS burst
  FROM {source} e JOIN rarity{p} r USING (dataset, template_id) JOIN spans{p} s USING (dataset)
  LEFT JOIN buckets{p} b ON b.dataset = e.dataset
    AND b.bucket = least(n_buckets - 1, floor((timestamp_epoch - min_epoch) / bucket_size)::INT)))""",
        source, f"rarity{p}", f"spans{p}", f"buckets{p}")


def correlate_blocks(p: str) -> None:
    """cand_p, runs_p, groups_p, links_p, comps_p, incidents_p, members_p over scored_p."""
    cte(f"cand{p}", f"""
SELECT *, {CONCRETE} AS concrete, {WIDE} AS wide FROM scored{p} WHERE is_anomaly OR anomaly_score >= 0.60""", f"scored{p}")
    cte(f"runs{p}", f"""
SELECT *, first_value(id) OVER (PARTITION BY dataset, template_id, run_no ORDER BY timestamp_epoch, id) AS run_id FROM (
 SELECT *, sum(brk) OVER (PARTITION BY dataset, template_id ORDER BY timestamp_epoch, id) AS run_no FROM (
  SELECT *, CASE WHEN lag(id) OVER w IS NULL THEN 1
     WHEN timestamp_epoch - lag(timestamp_epoch) OVER w > 300 AND NOT list_has_any(concrete, lag(concrete) OVER w) THEN 1 ELSE 0 END AS brk
  FROM cand{p} WINDOW w AS (PARTITION BY dataset, template_id ORDER BY timestamp_epoch, id)))""", f"cand{p}")
    cte(f"groups{p}", f"""
SELECT *, row_number() OVER (ORDER BY dataset, seen, start_epoch, run_id) AS gidx FROM (
 SELECT *, min({{'e': start_epoch, 'i': run_id}}) OVER (PARTITION BY dataset, template_id) AS seen FROM (
  SELECT dataset, template_id, run_id, min(timestamp_epoch) AS start_epoch, max(timestamp_epoch) AS end_epoch,
    count(*) AS n_events, max(anomaly_score) AS peak FROM runs{p} GROUP BY 1, 2, 3))""", f"runs{p}")
    cte(f"links{p}", f"""
SELECT DISTINCT dataset, run_a, run_b, a, b FROM (
 SELECT dataset, lag(run_id) OVER w AS run_a, run_id AS run_b, lag(gidx) OVER w AS a, gidx AS b, start_epoch, end_epoch,
   lag(start_epoch) OVER w AS ps, lag(end_epoch) OVER w AS pe
 FROM (SELECT DISTINCT r.dataset, k.key, g.run_id, g.gidx, g.start_epoch, g.end_epoch
       FROM (SELECT dataset, run_id, unnest(wide) AS key FROM runs{p}) k
       JOIN groups{p} g USING (dataset, run_id) JOIN runs{p} r ON r.dataset = g.dataset AND r.id = g.run_id)
 WINDOW w AS (PARTITION BY dataset, key ORDER BY gidx))
WHERE a IS NOT NULL AND ps <= end_epoch + 60 AND start_epoch <= pe + 60""", f"runs{p}", f"groups{p}")
    cte(f"reach{p}", f"""/*plain*/ /*recursive*/
SELECT gidx AS node, gidx AS lbl FROM groups{p}
UNION
SELECT e.b, r.lbl FROM reach{p} r JOIN (SELECT a, b FROM links{p} UNION SELECT b, a FROM links{p}) e ON r.node = e.a""",
        f"groups{p}", f"links{p}")
    cte(f"comps{p}", f"SELECT node AS gidx, min(lbl) AS root FROM reach{p} GROUP BY 1", f"reach{p}")
    cte(f"incidents{p}", f"""
SELECT *, 'INC-' || number AS incident_id FROM (
 SELECT *, 100 + row_number() OVER (PARTITION BY dataset ORDER BY peak DESC, event_count DESC, root) AS number FROM (
  SELECT dataset, root, min_by(run_id, gidx) AS lead_id, max(peak) AS peak, sum(n_events)::BIGINT AS event_count
  FROM groups{p} JOIN comps{p} USING (gidx) GROUP BY 1, 2))""", f"groups{p}", f"comps{p}")
    cte(f"members{p}", f"""
SELECT r.*, i.incident_id, i.number FROM runs{p} r JOIN groups{p} g USING (dataset, template_id, run_id)
JOIN comps{p} c USING (gidx) JOIN incidents{p} i ON i.dataset = r.dataset AND i.root = c.root""",
        f"runs{p}", f"groups{p}", f"comps{p}", f"incidents{p}")


cte("half", "SELECT dataset, max(id) // 2 AS half FROM parsed GROUP BY 1", "parsed")
cte("parsed_1", "SELECT e.* FROM parsed e JOIN half USING (dataset) WHERE id <= half", "parsed", "half")
cte("parsed_2", "SELECT e.* FROM parsed e JOIN half USING (dataset) WHERE id > half", "parsed", "half")
for suffix, source in (("", "parsed"), ("_all", "all_parsed"), ("_1", "parsed_1"), ("_2", "parsed_2")):
    score_blocks(suffix, source)
    correlate_blocks(suffix)

cte("stateless", f"""
SELECT *, anomaly_score >= 0.55 OR ({KW} AND ({SEV}) >= 0.50) AS is_anomaly FROM (
 SELECT *, {STATELESS_SCORE} AS anomaly_score FROM parsed)""", "parsed")

cte("rollup", f"""
SELECT *,
  'Incident in ' || scope || ' (' || event_count || ' correlated events)' AS title,
  CASE WHEN critical THEN 'CRITICAL' WHEN error THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  {half_up("least(0.98::DOUBLE, greatest(0.65::DOUBLE, peak))", 2)} AS confidence,
  CASE WHEN n_templates > 1 THEN event_count || ' correlated anomalies spanning ' || n_templates || ' log templates and '
     || greatest(n_services, 1) || ' service(s), joined by shared entities within the same time window. Peak anomaly score ' || {two_decimals("peak")} || '.'
   ELSE event_count || ' recurrences of a single log template in ' || scope || ', consolidated into one incident. Peak anomaly score ' || {two_decimals("peak")} || '.' END AS summary
FROM (SELECT dataset, incident_id, count(*) AS event_count, max(anomaly_score) AS peak,
  arg_min(timestamp, {{'e': timestamp_epoch, 'i': id}}) AS start_time, arg_max(timestamp, {{'e': timestamp_epoch, 'i': id}}) AS end_time,
  count(DISTINCT template_id) AS n_templates, count(DISTINCT nullif(service, '')) AS n_services,
  coalesce(min(nullif(service, '')), 'System') AS scope, bool_or(level IN ('CRITICAL', 'FATAL')) AS critical, bool_or(level = 'ERROR') AS error
  FROM members GROUP BY 1, 2)""", "members")

cte("kpis", f"""
SELECT dataset, raw_logs_count, templates_count, anomalies_count, incidents_count,
  greatest(0.0::DOUBLE, least(99.9::DOUBLE, {half_up("(1.0::DOUBLE - incidents_count / greatest(1, anomalies_count)) * 100", 2)})) AS noise_reduction_ratio,
  manual_sec, assisted_sec, {half_up("manual_sec / greatest(0.1::DOUBLE, assisted_sec)", 1)} AS triage_speedup
FROM (SELECT *, {half_up("anomalies_count * 15.0::DOUBLE", 1)} AS manual_sec, {half_up("0.5::DOUBLE + incidents_count * 1.2::DOUBLE", 2)} AS assisted_sec
 FROM (SELECT dataset, count(*) AS raw_logs_count, count(DISTINCT template_id) AS templates_count,
   count(*) FILTER (is_anomaly) AS anomalies_count FROM scored GROUP BY 1)
 JOIN (SELECT dataset, count(*) AS incidents_count FROM incidents GROUP BY 1) USING (dataset))""", "scored", "incidents")

# --- sequences ---------------------------------------------------------------
def sequence_blocks(p: str, source: str) -> None:
    cte(f"sessions{p}", f"SELECT dataset, id, template_id, {SESSION} AS session_id FROM {source}", source)
    cte(f"pairs{p}", f"""
SELECT * FROM (SELECT dataset, session_id, lag(id) OVER w AS log_id_a, id AS log_id_b, lag(template_id) OVER w AS t1, template_id AS t2
FROM sessions{p} WINDOW w AS (PARTITION BY dataset, session_id ORDER BY id)) WHERE log_id_a IS NOT NULL""", f"sessions{p}")
    cte(f"trans{p}", f"SELECT dataset, t1, t2, count(*) AS n FROM pairs{p} GROUP BY 1, 2, 3", f"pairs{p}")
    cte(f"rare{p}", f"""
SELECT p.*, {half_up("n / total", 3)} AS probability FROM pairs{p} p JOIN (
 SELECT *, (sum(n) OVER (PARTITION BY dataset, t1))::BIGINT AS total FROM trans{p}) USING (dataset, t1, t2)
WHERE total >= 3 AND n / total < 0.15::DOUBLE""", f"pairs{p}", f"trans{p}")


sequence_blocks("", "parsed")
cte("session_sums", """
SELECT dataset, session_id, count(*) AS event_count, min(id) AS first_log_id, max(id) AS last_log_id, count(DISTINCT template_id) AS n_templates
FROM sessions GROUP BY 1, 2""", "sessions")

# --- templates ---------------------------------------------------------------
cte("texts", f"""
SELECT dataset, template, min(id) AS first_id, count(*) AS n, string_split(template, ' ') AS toks, len(string_split(template, ' ')) AS n_tokens
FROM parsed WHERE template <> {q(P.EMPTY_TEMPLATE)} GROUP BY 1, 2""", "parsed")


def _route(source: str, keys: str, position: int, name: str) -> str:
    return f"""
SELECT t.* EXCLUDE (tok), CASE WHEN tok IS NULL THEN '' WHEN rk <= 100 THEN tok ELSE '<*>' END AS {name} FROM (
 SELECT *, CASE WHEN toks[{position}] LIKE '<%>' THEN '<*>' ELSE toks[{position}] END AS tok FROM {source}) t
LEFT JOIN (SELECT {keys}, tok, row_number() OVER (PARTITION BY {keys} ORDER BY first_id, tok) AS rk FROM (
 SELECT {keys}, CASE WHEN toks[{position}] LIKE '<%>' THEN '<*>' ELSE toks[{position}] END AS tok, min(first_id) AS first_id
 FROM {source} GROUP BY ALL) WHERE tok IS NOT NULL) USING ({keys}, tok)"""


cte("leaf1", _route("texts", "dataset, n_tokens", 1, "key1"), "texts")
cte("leaves", _route("leaf1", "dataset, n_tokens, key1", 2, "key2"), "leaf1")

# Clusters of every leaf, one text per step in order of first id. State: templates and founders as lists.
cte("sequence", """
SELECT *, row_number() OVER (PARTITION BY dataset, n_tokens, key1, key2 ORDER BY first_id) AS step FROM leaves""", "leaves")
_SHARED = "list_sum(list_transform(range(1, len(s.toks) + 1), lambda i: CASE WHEN s.toks[i] = c[i] AND s.toks[i] <> '<*>' THEN 1 ELSE 0 END))"
_MERGED = "list_transform(range(1, len(s.toks) + 1), lambda i: CASE WHEN s.toks[i] = c[i] THEN c[i] ELSE '<*>' END)"
cte("walk", f"""
SELECT * FROM (WITH RECURSIVE walk AS (
 SELECT dataset, n_tokens, key1, key2, step, template, 1 AS at, [toks] AS now, [template] AS founders FROM sequence WHERE step = 1
 UNION ALL
 SELECT dataset, n_tokens, key1, key2, step, template, CASE WHEN joins THEN best ELSE len(now) + 1 END,
  CASE WHEN joins THEN list_transform(now, lambda c, k: CASE WHEN k = best THEN merged ELSE c END) ELSE list_append(now, toks) END,
  CASE WHEN joins THEN founders ELSE list_append(founders, template) END
 FROM (SELECT *, shared[best] / n_tokens >= 0.5 AS joins, list_transform([now[best]], lambda c: {_MERGED.replace("s.toks", "toks")})[1] AS merged
  FROM (SELECT *, list_position(shared, list_max(shared)) AS best
   FROM (SELECT s.dataset, s.n_tokens, s.key1, s.key2, s.step, s.template, s.toks, w.now, w.founders, list_transform(w.now, lambda c: {_SHARED}) AS shared
    FROM walk w JOIN sequence s ON s.dataset = w.dataset AND s.n_tokens = w.n_tokens AND s.key1 = w.key1 AND s.key2 = w.key2 AND s.step = w.step + 1))))
 SELECT * FROM walk)""", "sequence")
cte("clustered", """
SELECT w.dataset, w.template, l.founders[w.at] AS founder, array_to_string(l.now[w.at], ' ') AS cluster_template
FROM walk w JOIN (SELECT dataset, n_tokens, key1, key2, arg_max(now, step) AS now, arg_max(founders, step) AS founders FROM walk GROUP BY 1, 2, 3, 4) l
USING (dataset, n_tokens, key1, key2)""", "walk")

# Events carrying the template of their cluster, and what follows from it.
cte("parsed_mined", """
SELECT p.* REPLACE (coalesce(substr(md5(c.founder), 1, 10), p.template_id) AS template_id, coalesce(c.cluster_template, p.template) AS template)
FROM parsed p LEFT JOIN clustered c USING (dataset, template)""", "parsed", "clustered")
score_blocks("_mined", "parsed_mined")
correlate_blocks("_mined")
sequence_blocks("_mined", "parsed_mined")

# --- retrieval ---------------------------------------------------------------
def passage_blocks(p: str, source: str) -> None:
    cte(f"ordered{p}", f"""
SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY id) - 1 AS pos, count(*) OVER (PARTITION BY dataset) AS total FROM {source}""", source)
    cte(f"passages{p}", f"""
SELECT dataset, start, min(id) AS start_id, max(id) AS end_id, count(*) AS n_rows, bool_or(is_anomaly) AS has_anomaly,
  string_agg('[' || level || '] ' || service || ': ' || message, ' | ' ORDER BY pos) AS text, 'chunk_' || min(id) || '_' || max(id) AS chunk_id
FROM (SELECT *, unnest(list_filter([pos, pos - 1, pos - 2, pos - 3, pos - 4], lambda s: s >= 0 AND s % 2 = 0)) AS start FROM ordered{p}) GROUP BY 1, 2""", f"ordered{p}")


passage_blocks("", "scored")
passage_blocks("_all", "scored_all")
cte("extra_all", """
SELECT dataset, start, min(o.id) AS start_id, max(o.id) AS end_id, count(*) AS n_rows, bool_or(o.is_anomaly) AS has_anomaly,
  string_agg('[' || o.level || '] ' || o.service || ': ' || o.message, ' | ' ORDER BY o.pos) AS text, 'chunk_' || min(o.id) || '_' || max(o.id) AS chunk_id
FROM (SELECT DISTINCT dataset, greatest(0, pos - 2) AS start FROM ordered_all WHERE is_anomaly OR anomaly_score >= 0.55
 EXCEPT SELECT dataset, start FROM passages_all) t
JOIN ordered_all o USING (dataset) WHERE o.pos BETWEEN t.start AND t.start + 4 GROUP BY 1, 2""", "ordered_all", "passages_all")

TERM_LIST = "regexp_extract_all(lower(text), " + q(P.TERM) + ")"
TERMS = "w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])"
cte("chunk_terms", f"""
SELECT dataset, chunk_id, term, count(*) AS tf FROM (
 SELECT dataset, chunk_id, unnest({TERMS}) AS term FROM (SELECT *, {TERM_LIST} AS w FROM passages)) GROUP BY 1, 2, 3""", "passages")
cte("vocab", """
SELECT *, ln((1 + n_chunks) / (1 + df)) + 1.0::DOUBLE AS idf FROM (
 SELECT dataset, term, sum(tf)::BIGINT AS corpus_tf, count(*) AS df FROM chunk_terms GROUP BY 1, 2)
JOIN (SELECT dataset, count(*) AS n_chunks FROM passages GROUP BY 1) USING (dataset)""", "chunk_terms", "passages")
cte("weights", "SELECT dataset, chunk_id, term, tf * idf AS w FROM chunk_terms JOIN vocab USING (dataset, term)", "chunk_terms", "vocab")


def question_rows() -> str:
    from timberline.plans.tables import QUESTIONS

    return "VALUES " + ", ".join(f"({i}::BIGINT, {q(t)})" for i, t in QUESTIONS)


cte("questions", f"SELECT * FROM ({question_rows()}) AS t(question_id, text)")
cte("asked", f"""
SELECT dataset, question_id, term, tf * idf AS qw FROM (
 SELECT question_id, term, count(*) AS tf FROM (
  SELECT question_id, unnest({TERMS}) AS term FROM (SELECT *, {TERM_LIST} AS w FROM questions)) GROUP BY 1, 2)
JOIN vocab USING (term)""", "questions", "vocab")
cte("found", f"""
SELECT dataset, question_id, chunk_id, start_id, score, rank FROM (
 SELECT *, {half_up("cosine", 3)} AS score, row_number() OVER (PARTITION BY dataset, question_id ORDER BY {half_up("cosine", 9)} DESC, start_id) AS rank FROM (
  SELECT dataset, question_id, chunk_id, start_id, dot / (norm * q_norm) AS cosine FROM (
   SELECT dataset, question_id, chunk_id, sum(w * qw) AS dot FROM weights JOIN asked USING (dataset, term) GROUP BY 1, 2, 3)
  JOIN (SELECT dataset, chunk_id, sqrt(sum(w * w)) AS norm FROM weights GROUP BY 1, 2) USING (dataset, chunk_id)
  JOIN (SELECT dataset, question_id, sqrt(sum(qw * qw)) AS q_norm FROM asked GROUP BY 1, 2) USING (dataset, question_id)
  JOIN passages USING (dataset, chunk_id)) WHERE cosine > 0.01) WHERE rank <= 3""", "weights", "asked", "passages")
cte("cited", """
SELECT *, row_number() OVER (PARTITION BY dataset, question_id ORDER BY rank, pos) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY dataset, question_id, log_id ORDER BY rank, pos) AS once FROM (
  SELECT f.dataset, f.question_id, f.rank, f.score, o.pos, o.id AS log_id, o.timestamp, o.level, o.service, o.message
  FROM found f JOIN passages p USING (dataset, chunk_id) JOIN ordered o ON o.dataset = f.dataset AND o.pos BETWEEN p.start AND p.start + p.n_rows - 1))
WHERE once = 1""", "found", "passages", "ordered")

# --- incremental -------------------------------------------------------------
def _shapes(p: str) -> str:
    """Incidents with spans and what they can be matched by."""
    return f"""
SELECT dataset, incident_id, number, min(timestamp_epoch) AS s, max(timestamp_epoch) AS e, list(DISTINCT template_id) AS ts,
 list_distinct(flatten(list(wide))) AS ks FROM members{p} GROUP BY 1, 2, 3"""


def _fits(keys: str, slack: int) -> str:
    return f"(list_has_any(r.{keys}, c.{keys}) AND c.s <= r.e + {slack} AND r.s <= c.e + {slack})"


cte("candidates", f"SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY number) AS i FROM ({_shapes('_2')})", "members_2")
# One candidate after the other, each against the reports as those before it left them.
cte("carried", f"""/*recursive*/
SELECT c.dataset, 0::BIGINT AS i, coalesce(r.top, 100) AS top, NULL::BIGINT AS match, NULL::BIGINT AS after,
 coalesce(r.reports, []) AS reports
FROM (SELECT DISTINCT dataset FROM candidates) c LEFT JOIN (
 SELECT dataset, max(number)::BIGINT AS top, list({{'n': number::BIGINT, 's': s, 'e': e, 'ts': ts, 'ks': ks}} ORDER BY number) AS reports
 FROM ({_shapes('_1')}) GROUP BY 1) r USING (dataset)
UNION ALL
SELECT dataset, i, CASE WHEN match IS NULL THEN top + 1 ELSE top END, match, coalesce(match, top + 1),
 CASE WHEN match IS NULL THEN list_append(reports, {{'n': top + 1, 's': s, 'e': e, 'ts': ts, 'ks': ks}})
  ELSE list_transform(reports, lambda r: CASE WHEN r.n = match THEN
   {{'n': r.n, 's': r.s, 'e': e, 'ts': list_distinct(r.ts || ts), 'ks': list_distinct(r.ks || ks)}} ELSE r END) END
FROM (SELECT c.dataset, c.i, c.s, c.e, c.ts, c.ks, x.top, x.reports, list_min(list_transform(list_filter(x.reports,
  lambda r: {_fits('ts', 300)} OR {_fits('ks', 60)}), lambda r: r.n)) AS match
 FROM carried x JOIN candidates c ON c.dataset = x.dataset AND c.i = x.i + 1)""", "candidates", "members_1")
cte("matches", """
SELECT c.dataset, c.incident_id AS candidate, c.number AS candidate_number, x.match, x.after
FROM candidates c JOIN carried x ON x.dataset = c.dataset AND x.i = c.i""", "candidates", "carried")
cte("merged", """
SELECT dataset, incident_id, number, id, timestamp, timestamp_epoch, service, host, template_id, 0 AS generation, 0 AS candidate_number,
  block_id, req_id, bgl_node, ent_user, all_block_ids, ips, registers FROM members_1
UNION ALL
SELECT m.dataset, 'INC-' || t.after AS incident_id, t.after AS number, id, timestamp, timestamp_epoch, service, host, template_id, 1, t.candidate_number,
  block_id, req_id, bgl_node, ent_user, all_block_ids, ips, registers FROM members_2 m
JOIN matches t ON t.dataset = m.dataset AND t.candidate = m.incident_id""", "members_1", "members_2", "matches")
