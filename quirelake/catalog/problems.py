"""Registered queries of the core, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import drift, nested, rolling
from quirelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p1_found": lambda s, d: drift.schema_changes(table(s, d, "export_files")).select("file_id", "table_id", "change", "old_header", "new_header"),
    "p1_changes": lambda s, d: drift.field_changes(table(s, d, "export_files")),
    "p1_unified": lambda s, d: drift.unified_rows(table(s, d, "export_files")),
    "p3_found": lambda s, d: rolling.usage_bursts(table(s, d, "usage_events")),
    "p3_rolling": lambda s, d: rolling.usage_rolling(table(s, d, "usage_events")),
    "p3_corrected": lambda s, d: rolling.usage_corrected(table(s, d, "usage_events"), F.lower("status") == "error"),
    "p5_found": lambda s, d: nested.linked_children(table(s, d, "export_files")),
    "p5_identities": lambda s, d: nested.identity_report(table(s, d, "export_files")),
}

_DAYS = """
WITH e AS (
  SELECT id, lower(trim(engine)) AS engine, trim(timestamp) AS t, coalesce(total_tokens, 0) AS tokens,
         CAST(coalesce(estimated_cost_usd, 0) AS DECIMAL(28,10)) AS cost
  FROM (SELECT DISTINCT * FROM usage_events)
), d AS (
  SELECT engine, tokens, cost,
         CAST(CASE WHEN substr(t, 5, 1) = '-' THEN substr(t, 1, 10)
              ELSE substr(t, 1, 4) || '-' || substr(t, 5, 2) || '-' || substr(t, 7, 2) END AS DATE) AS day
  FROM e WHERE engine IS NOT NULL AND engine <> ''
), leaf AS (SELECT engine, day, count(*) AS calls, sum(tokens) AS tokens, sum(cost) AS cost FROM d GROUP BY ALL),
span AS (SELECT engine, min(day) AS a, max(day) AS b FROM leaf GROUP BY engine),
cal AS (SELECT engine, a, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
full_days AS (
  SELECT cal.engine, cal.a, cal.day, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost
  FROM cal LEFT JOIN leaf ON leaf.engine = cal.engine AND leaf.day = cal.day
), w AS (
  SELECT engine, a, day,
    sum(calls) OVER w7 AS calls_7, sum(tokens) OVER w7 AS tokens_7, sum(cost) OVER w7 AS cost_7,
    sum(calls) OVER w30 AS calls_30, sum(tokens) OVER w30 AS tokens_30, sum(cost) OVER w30 AS cost_30
  FROM full_days
  WINDOW w7 AS (PARTITION BY engine ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY engine ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
)
"""


def _rolling_columns() -> str:
    out = []
    for n in (7, 30):
        out.append(
            f"CAST(calls_{n} AS BIGINT) AS calls_{n}, CAST(tokens_{n} AS BIGINT) AS tokens_{n}, CAST(cost_{n} AS DOUBLE) AS cost_usd_{n}, "
            f"round(CAST(tokens_{n} AS DOUBLE) / {n}.0, 4) AS avg_tokens_{n}, round(CAST(cost_{n} AS DOUBLE) / {n}.0, 9) AS avg_cost_usd_{n}, "
            f"round(CASE WHEN calls_{n} > 0 THEN CAST(tokens_{n} AS DOUBLE) / CAST(calls_{n} AS DOUBLE) END, 4) AS per_call_tokens_{n}"
        )
    return ", ".join(out)


ORACLE: dict[str, str] = {
    "p3_found": _DAYS + "SELECT engine, strftime(day, '%Y-%m-%d') AS usage_day FROM w WHERE day >= a + 29 AND tokens_30 > 0 AND tokens_7 * 2 > tokens_30",
    "p3_rolling": _DAYS + f"SELECT engine, strftime(day, '%Y-%m-%d') AS usage_day, {_rolling_columns()} FROM w",
}
_CORRECTED = _DAYS.replace("SELECT id, lower(trim(engine))", "SELECT id, lower(status) <> 'error' AS own, lower(trim(engine))").replace("SELECT engine, tokens, cost,\n", "SELECT engine, own, tokens, cost,\n")
_CORRECTED = _CORRECTED.replace("count(*) AS calls, sum(tokens) AS tokens, sum(cost) AS cost FROM d GROUP BY ALL", "count_if(own) AS calls, sum(CASE WHEN own THEN tokens ELSE 0 END) AS tokens, sum(CASE WHEN own THEN cost ELSE 0 END) AS cost FROM d GROUP BY ALL")
ORACLE["p3_corrected"] = _CORRECTED + f"SELECT engine, strftime(day, '%Y-%m-%d') AS usage_day, {_rolling_columns()} FROM w"

ORACLE["p5_found"] = """
WITH f AS (SELECT DISTINCT file_id, ltrim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS p FROM export_files WHERE file_id IS NOT NULL AND payload IS NOT NULL),
j AS (SELECT file_id, CAST(p AS JSON) AS j FROM f WHERE json_valid(p)),
top AS (SELECT file_id, CASE json_type(j) WHEN 'ARRAY' THEN j WHEN 'OBJECT' THEN CASE WHEN json_exists(j, '$.sections') THEN CASE WHEN json_type(j, '$.sections') = 'ARRAY' THEN json_extract(j, '$.sections') END
  WHEN json_exists(j, '$.tables') OR json_exists(j, '$.section_id') THEN json_array(j) END END AS ss FROM j),
s AS (SELECT file_id, unnest(CAST(ss AS JSON[])) AS s, unnest(range(len(CAST(ss AS JSON[])))) AS section_ord FROM top WHERE ss IS NOT NULL),
t AS (SELECT file_id, section_ord, unnest(CAST(json_extract(s, '$.tables') AS JSON[])) AS t, unnest(range(len(CAST(json_extract(s, '$.tables') AS JSON[])))) AS table_ord FROM s WHERE json_type(s) = 'OBJECT' AND json_type(s, '$.tables') = 'ARRAY'),
g AS (SELECT file_id, section_ord, table_ord, t, json_type(t, '$.headers') IS DISTINCT FROM 'ARRAY' AND json_type(t, '$.array') IS NOT DISTINCT FROM 'ARRAY' AND json_array_length(t, '$.array') > 0 AS form FROM t WHERE json_type(t) = 'OBJECT'),
b AS (SELECT file_id, section_ord, table_ord, CASE WHEN form THEN CASE WHEN json_type(t, '$.array[0]') = 'ARRAY' THEN CAST(json_extract(t, '$.array[0]') AS JSON[]) ELSE [] END WHEN json_type(t, '$.headers') = 'ARRAY' THEN CAST(json_extract(t, '$.headers') AS JSON[]) ELSE [] END AS heads,
  CASE WHEN form THEN CAST(json_extract(t, '$.array') AS JSON[])[2:] WHEN json_type(t, '$.rows') = 'ARRAY' THEN CAST(json_extract(t, '$.rows') AS JSON[]) ELSE [] END AS rows FROM g),
r AS (SELECT file_id, section_ord, table_ord, list_position(list_transform(heads, lambda h: h->>'$'), 'DESCRIPTION') AS place, unnest(rows) AS r, unnest(range(len(rows))) AS child_ord FROM b),
d AS (SELECT file_id, section_ord, table_ord, child_ord, CASE json_type(r) WHEN 'OBJECT' THEN json_extract(r, '$.DESCRIPTION') WHEN 'ARRAY' THEN json_extract(r, '$[' || (place - 1) || ']') END AS v FROM r),
q AS (SELECT file_id, section_ord, table_ord, CASE WHEN json_type(t, '$.quality') = 'VARCHAR' THEN CASE WHEN json_valid(t->>'$.quality') THEN CAST(t->>'$.quality' AS JSON) END ELSE json_extract(t, '$.quality') END AS q FROM g),
w AS (SELECT file_id, section_ord, table_ord, CASE WHEN json_type(q, '$.warnings') = 'ARRAY' THEN CAST(json_extract(q, '$.warnings') AS JSON[]) ELSE [json_extract(q, '$.warnings')] END AS ws FROM q WHERE json_type(q) = 'OBJECT' AND json_exists(q, '$.warnings')),
x AS (SELECT file_id, section_ord, table_ord, unnest(ws) AS x, unnest(range(len(ws))) AS child_ord FROM w),
c AS (SELECT file_id, section_ord, table_ord, child_ord, CASE WHEN json_type(x) = 'OBJECT' THEN json_extract(x, '$.code') ELSE x END AS v FROM x)
SELECT DISTINCT file_id, CAST(section_ord AS INTEGER) AS section_ord, CAST(table_ord AS INTEGER) AS table_ord, 'row' AS child, CAST(child_ord AS INTEGER) AS child_ord, CASE WHEN json_type(v) = 'VARCHAR' THEN v->>'$' ELSE CAST(v AS VARCHAR) END AS child_value
FROM d WHERE v IS NOT NULL AND json_type(v) <> 'NULL' AND NOT (json_type(v) = 'VARCHAR' AND (v->>'$') = '')
UNION ALL SELECT DISTINCT file_id, CAST(section_ord AS INTEGER), CAST(table_ord AS INTEGER), 'warning', CAST(child_ord AS INTEGER), v->>'$' FROM c WHERE json_type(v) = 'VARCHAR' AND (v->>'$') <> ''"""
