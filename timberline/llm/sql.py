"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS body,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turns AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sums),
-- Sources stop in the order of size to weight; the first open one fixes the share.
ordered AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS t,
         coalesce(sum(3 * source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c,
         sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS w
  FROM turns),
marked AS (SELECT *, weight * (t - c) > 3 * source_size * w AS stops FROM ordered),
share AS (SELECT (t - c) AS amount, w FROM marked WHERE NOT stops ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN stops THEN (3 * source_size)::DOUBLE
              ELSE (weight * (SELECT amount FROM share))::DOUBLE / (SELECT w FROM share)::DOUBLE END AS target
  FROM marked),
rated AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       size * (floor(rate)::BIGINT + CASE WHEN
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || md5(body)), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
"""
