"""DuckDB building blocks: named common table expressions and how to chain them."""

from __future__ import annotations

from timberline.functions import patterns as P

_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTES[name] = (needs, body)


def chain(final: str, *needs: str, recursive: bool = False) -> str:
    """``WITH`` every needed block (in dependency order) before ``final``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in _CTES[name][0]:
            visit(need)
        order.append(name)

    for need in needs:
        visit(need)
    if not order:
        return final
    blocks = []
    for name in order:
        body = _CTES[name][1].strip()
        plain = body.startswith("/*plain*/")
        blocks.append(f"{name} AS {'' if plain else 'MATERIALIZED '}(\n{body}\n)")
    recursive = recursive or any("/*recursive*/" in _CTES[name][1] for name in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(blocks) + "\n" + final


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def ci(pattern: str) -> str:
    return q("(?i)" + pattern)


def case_of(expr: str, table: dict, other) -> str:
    def lit(value):
        return q(value) if isinstance(value, str) else f"{value}::DOUBLE"

    whens = " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {lit(other)} END"


def half_up(expr: str, places: int) -> str:
    scale = f"{10 ** places}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


def lines_cte(single: bool) -> str:
    dataset = "'all'" if single else "dialect"
    number = "event_id + 1" if single else "event_id // 8 + 1"
    return f"""
SELECT {dataset} AS dataset, dialect, {dataset} AS source_id, ({number})::BIGINT AS source_line,
  ({number})::BIGINT AS id, event_id, event_type,
  CASE dialect
   WHEN 'hdfs' THEN strftime(ts, '%y%m%d %H%M%S') || ' ' || (100 + user_id) || ' ' || lvl || ' dfs.DataNode$Worker: ' || body
   WHEN 'syslog' THEN strftime(ts, '%b %d %H:%M:%S') || ' host' || (user_id % 5) || ' sshd[' || (1000 + user_id) || ']: ' || lvl || ' ' || body
   WHEN 'openstack' THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || (2000 + user_id) || ' ' || lvl || ' nova.compute.manager ' || body
   WHEN 'bgl' THEN '- ' || (epoch_us(ts) // 1000000) || ' ' || strftime(ts, '%Y.%m.%d') || ' ' || node || ' '
        || strftime(ts, '%Y-%m-%d-%H.%M.%S.%f') || ' ' || node || ' RAS KERNEL ' || lvl || ' ' || body
   WHEN 'zookeeper' THEN strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' - ' || lvl || '  [main:QuorumPeer@101] - ' || body
   WHEN 'hadoop' THEN strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' ' || lvl || ' [main] org.apache.hadoop.mapreduce.v2.app.MRAppMaster: ' || body
   WHEN 'spark' THEN strftime(ts, '%y/%m/%d %H:%M:%S') || ' ' || lvl || ' executor.Executor: ' || body
   ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || lvl || ' api: ' || body END AS line
FROM (
 SELECT *,
  (['hdfs','syslog','openstack','bgl','zookeeper','hadoop','spark','generic'])[(event_id % 8 + 1)::INT] AS dialect,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' AND value >= 200 THEN 'WARN'
       WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS lvl,
  'R' || lpad((user_id % 16)::VARCHAR, 2, '0') || '-M' || (user_id % 2) || '-N' || (user_id % 8) || '-C:J'
      || lpad((user_id % 18)::VARCHAR, 2, '0') || '-U' || lpad((user_id % 12)::VARCHAR, 2, '0') AS node,
  CASE event_type
   WHEN 'error' THEN 'request req-' || substr(md5(user_id::VARCHAR), 1, 8) || ' failed for user u' || user_id
      || ' from 10.0.' || (user_id % 8) || '.' || (event_id % 250) || ' after ' || (event_id % 7) || ' retries'
   WHEN 'signup' THEN 'user u' || user_id || ' registered from 10.0.' || (user_id % 8) || '.' || (event_id % 250)
   WHEN 'purchase' THEN 'stored block blk_' || (1000 + user_id % 40) || ' of size ' || floor(value * 100)::BIGINT
      || ' at 0x' || substr(md5(event_id::VARCHAR), 1, 8)
   WHEN 'click' THEN 'opened /var/data/u' || user_id || '/page' || (event_id % 20)
   ELSE 'heartbeat ok seq ' || event_id END AS body
 FROM events)"""


def _redact(expr: str) -> str:
    out = expr
    out = f"regexp_replace({out}, {ci(P.CREDENTIAL)}, {q(chr(92) + '1' + P.CREDENTIAL_MASK)}, 'g')"
    out = f"regexp_replace({out}, {ci(P.AUTH_HEADER)}, {q(P.AUTH_HEADER_MASK)}, 'g')"
    out = f"regexp_replace({out}, {q(P.EMAIL)}, {q(P.EMAIL_MASK)}, 'g')"
    return f"regexp_replace({out}, {q(P.PRIVATE_KEY)}, {q(P.PRIVATE_KEY_MASK)}, 'g')"


redact_sql = _redact

_ANY_MASK = "|".join(pattern for _, pattern in P.MASKS)
_MARK = (
    "CASE "
    + " ".join(
        f"WHEN regexp_full_match(p, {q(pat[:-2] if name == 'REQ' else pat)}) THEN {q('<' + name + '>')}"
        for name, pat in P.MASKS
    )
    + " END"
)


def mask_sql(source: str, message: str) -> str:
    """Adds params, tokens, template, template_id to ``source``."""
    return f"""
SELECT *, CASE WHEN len(tokens) = 0 THEN {q(P.EMPTY_TEMPLATE)} ELSE array_to_string(tokens, ' ') END AS template,
  CASE WHEN len(tokens) = 0 THEN {q(P.EMPTY_TEMPLATE_ID)} ELSE substr(md5(array_to_string(tokens, ' ')), 1, 10) END AS template_id
FROM (
 SELECT *, list_filter(string_split_regex(trim(masked), '\\s+'), lambda w: w <> '') AS tokens FROM (
  SELECT *, array_to_string(list_transform(gaps, lambda g, i: g || coalesce(marks[i], '')), '') AS masked FROM (
   SELECT *, list_transform(params, lambda p: {_MARK}) AS marks FROM (
    SELECT *, regexp_extract_all({message}, {q(_ANY_MASK)}) AS params,
      string_split_regex({message}, {q(_ANY_MASK)}) AS gaps FROM ({source})))))"""


def parse_sql(source: str, year: int = 2024) -> str:
    ts = f"""
SELECT *,
  coalesce(t_iso, t_slash, t_sys, t_cmp) AS t_naive,
  CASE WHEN t_iso IS NOT NULL THEN 'iso' WHEN t_slash IS NOT NULL THEN 'slash' WHEN t_sys IS NOT NULL THEN 'syslog'
       WHEN t_cmp IS NOT NULL THEN 'compact' WHEN x_epoch <> '' THEN 'epoch' ELSE 'synthetic' END AS ts_format
FROM (SELECT *,
  CASE WHEN substr(x_iso, 20, 1) IN ('', '.', ',') THEN try_strptime(replace(substr(x_iso, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S') END AS t_iso,
  CASE WHEN x_slash <> '' THEN try_strptime(regexp_replace(x_slash, '\\s+', ' '), '%y/%m/%d %H:%M:%S') END AS t_slash,
  CASE WHEN x_sys <> '' THEN try_strptime('{year} ' || regexp_replace(x_sys, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S') END AS t_sys,
  CASE WHEN x_cmp <> '' THEN try_strptime(regexp_replace(x_cmp, '\\s+', ' '), '%y%m%d %H%M%S') END AS t_cmp
 FROM (SELECT *,
  regexp_extract(raw, {q(P.TS_ISO)}, 1) AS x_iso,
  regexp_extract(raw, {q(P.TS_SLASH)}, 1) AS x_slash,
  regexp_extract(raw, {q(P.TS_SYSLOG)}, 1) AS x_sys,
  regexp_extract(raw, {q(P.TS_COMPACT)}, 1) AS x_cmp,
  regexp_extract(raw, {q(P.TS_EPOCH)}, 1) AS x_epoch
  FROM (SELECT *, trim(line) AS clean, {_redact('trim(line)')} AS raw FROM ({source}))))"""
    rem = f"""
SELECT *,
  CASE WHEN t_naive IS NOT NULL THEN epoch(t_naive)::DOUBLE WHEN x_epoch <> '' THEN x_epoch::DOUBLE
       ELSE {P.SYNTHETIC_EPOCH}::DOUBLE + id END AS timestamp_epoch,
  CASE ts_format WHEN 'iso' THEN regexp_replace(raw, {q(P.TS_ISO)}, '') WHEN 'slash' THEN regexp_replace(raw, {q(P.TS_SLASH)}, '')
       WHEN 'syslog' THEN regexp_replace(raw, {q(P.TS_SYSLOG)}, '') WHEN 'compact' THEN regexp_replace(raw, {q(P.TS_COMPACT)}, '')
       WHEN 'epoch' THEN regexp_replace(raw, {q(P.TS_EPOCH)}, '') ELSE raw END AS remainder
FROM ({ts})"""
    head = f"""
SELECT *,
  CASE WHEN t_naive IS NOT NULL THEN strftime(t_naive, '%Y-%m-%dT%H:%M:%S')
       ELSE strftime(make_timestamp((timestamp_epoch * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS timestamp,
  {case_of(f"upper(regexp_extract(remainder, {ci(P.LEVEL)}, 1))", P.LEVEL_NAMES, 'INFO')} AS level,
  instr(remainder, ':') AS at_colon,
  regexp_extract(remainder, {q(P.ZOOKEEPER_HEADER)}, 1) AS zk1,
  regexp_extract(remainder, {q(P.ZOOKEEPER_HEADER)}, 2) AS zk2,
  list_filter(string_split_regex(CASE WHEN dialect IN ('hdfs','syslog','hadoop','spark')
     THEN CASE WHEN instr(remainder, ':') > 0 THEN split_part(remainder, ':', 1) ELSE '' END ELSE remainder END, '\\s+'),
     lambda w: w <> '') AS hw
FROM ({rem})"""

    def has(words, var="w"):
        return "(" + " OR ".join(f"contains({var}, {q(x)})" for x in words) + ")"

    body = f"""
SELECT *,
  coalesce(CASE dialect
    WHEN 'hdfs' THEN list_filter(hw, lambda w: contains(w, 'dfs.'))[-1]
    WHEN 'syslog' THEN CASE WHEN len(hw) >= 2 THEN regexp_replace(hw[2], '\\[\\d+\\]', '', 'g') END
    WHEN 'openstack' THEN CASE WHEN len(hw) >= 3 THEN list_filter(hw[1:5], lambda w: {has(P.OPENSTACK_SERVICES)})[1] END
    WHEN 'bgl' THEN list_filter(hw, lambda w: w IN ('KERNEL', 'APP', 'DISCOVERY', 'RAS'))[-1]
    WHEN 'zookeeper' THEN CASE WHEN zk1 <> '' THEN split_part(CASE WHEN contains(zk1, ':') THEN split_part(zk1, ':', 2) ELSE zk1 END, '@', 1) END
    WHEN 'hadoop' THEN split_part(list_filter(hw, lambda w: {has(P.HADOOP_SERVICES)})[-1], '.', -1)
    WHEN 'spark' THEN split_part(list_filter(hw, lambda w: {has(P.SPARK_SERVICES)})[-1], '.', -1)
    END, 'system') AS service,
  coalesce(CASE dialect
    WHEN 'syslog' THEN CASE WHEN len(hw) >= 2 THEN hw[1] END
    WHEN 'bgl' THEN list_filter(hw, lambda w: regexp_matches(w, {q(P.BGL_HOST)}))[-1] END, 'local') AS host0,
  CASE dialect
    WHEN 'hdfs' THEN list_filter(hw, lambda w: regexp_full_match(w, '\\d+'))[1]
    WHEN 'syslog' THEN CASE WHEN len(hw) >= 2 THEN nullif(regexp_extract(hw[2], '\\[(\\d+)\\]', 1), '') END
    WHEN 'openstack' THEN CASE WHEN len(hw) >= 3 THEN list_filter(hw[1:4], lambda w: regexp_full_match(w, '\\d+'))[1] END END AS pid,
  trim(CASE WHEN dialect IN ('hdfs','syslog','hadoop','spark') AND at_colon > 0 THEN substr(remainder, at_colon + 1)
       WHEN dialect = 'bgl' THEN regexp_replace(remainder, {q('(?is)^.*?' + P.LEVEL)}, '')
       WHEN dialect = 'zookeeper' AND zk1 <> '' THEN zk2 ELSE remainder END) AS body,
  nullif(regexp_extract(raw, {q(P.ENT_BLOCK)}, 1), '') AS block_id,
  CASE WHEN len(regexp_extract_all(raw, {q(P.ENT_BLOCK)}, 1)) > 1 THEN list_distinct(regexp_extract_all(raw, {q(P.ENT_BLOCK)}, 1)) END AS all_block_ids,
  nullif(regexp_extract(raw, {q(P.ENT_REQUEST)}, 1), '') AS req_id,
  nullif(regexp_extract(raw, {q(P.ENT_NODE)}, 1), '') AS bgl_node,
  regexp_extract_all(raw, {q(P.ENT_IPV4)}) AS ips,
  nullif(regexp_extract(raw, {ci(P.ENT_USER)}, 1), '') AS ent_user,
  regexp_extract_all(raw, {q(P.ENT_REGISTER)}, 1) AS registers
FROM ({head})"""
    msg = f"""
SELECT * EXCLUDE (host0), CASE WHEN host0 = 'local' THEN coalesce(bgl_node, 'local') ELSE host0 END AS host,
  coalesce(nullif(trim(regexp_replace(body, {q(P.LEADING_MARKS)}, '')), ''), raw) AS message,
  sha256(source_id || chr(0) || source_line || chr(0) || clean) AS event_key,
  level IN ('ERROR', 'FATAL', 'CRITICAL') AS hot
FROM ({body})"""
    return mask_sql(msg, "message")


cte("log_lines", lines_cte(False))
cte("all_lines", lines_cte(True))
cte("parsed", parse_sql("SELECT * FROM log_lines"), "log_lines")
cte("all_parsed", parse_sql("SELECT * FROM all_lines"), "all_lines")
