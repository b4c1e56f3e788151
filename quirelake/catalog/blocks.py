"""Tables out of HTML text, stages, signals, reports and guards over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.catalog.tables import _CELLS, _GRID, _KEY, _S, _TABLES, _strip
from quirelake.functions import keywords as K
from quirelake.functions import tables as T
from quirelake.functions import text as X
from quirelake.operators import blocks, bom, contract, reports
from quirelake.plans.lineage import cut, scratch
from quirelake.sources import sinks
from quirelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _words(words, x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_S}+', ' ', 'g'))"


def _filled(row: str) -> str:
    return f"list_filter(list_transform({row}, lambda x: {_strip('x')}), lambda x: x <> '')"


def _title(row: str) -> str:
    one = f"list_distinct({_filled(row)})"
    return f"(len({one}) = 1 AND length({one}[1]) >= 3 AND NOT regexp_matches({one}[1], '^[0-9]+$'))"


def _digits(x: str) -> str:
    return f"regexp_matches({x}, '^[0-9,.\\-\\s]*$')"


def _sub(row: str) -> str:
    c = _filled(row)
    return f"(len({c}) >= 2 AND len(list_filter({c}, lambda x: {_words(K.SUB_HEADERS, 'upper(x)')})) >= 2 AND len(list_filter({c}, lambda x: {_digits('x')})) <= len({c}) * 0.4)"


def _header_like(row: str) -> str:
    return f"(len(list_filter({row}, lambda x: x <> '' AND NOT {_digits('x')})) > len({row}) * 0.5)"


def _rendered(s: SparkSession, d: str) -> DataFrame:
    t = contract.tables_with_rows(table(s, d, "doc_tables"), table(s, d, "doc_cells")).filter(F.size("headers") > 0)
    return t.withColumn("html", F.concat(F.lit("앞 글 "), T.render_html(F.col("headers"), F.col("rows")), F.lit(" 뒤 글")))


#: Every table with headers as a grid of collapsed texts, all rows of the same width.
_HTML = f"""{_GRID}, r AS (SELECT {_KEY}, list(row ORDER BY row_ord) AS rows FROM g GROUP BY {_KEY}),
  t AS (SELECT {_KEY}, list_concat([list_transform(headers, lambda h: coalesce(h, ''))], coalesce(rows, [])) AS raw FROM {_TABLES} LEFT JOIN r USING ({_KEY}) WHERE len(headers) > 0),
  w AS (SELECT {_KEY}, raw, list_max(list_transform(raw, lambda r: len(r))) AS width FROM t),
  h AS (SELECT {_KEY}, upper(array_to_string(list_transform(flatten(raw), lambda c: replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), '</TD><TD>')) AS up, width,
    list_transform(raw, lambda r: list_transform(range(1, width + 1), lambda i: {_clean('r[i]')})) AS grid FROM w)"""


@query("html_material_tables", f"""WITH {_HTML}, k AS (SELECT *, CASE WHEN {_words(K.BOM_BLACKLIST, 'up')} THEN NULL WHEN {_words(K.LINE_HEADER_GROUPS[0], 'up')} THEN 'line_list'
    WHEN {" AND ".join(_words(g, 'up') for g in K.BOM_HEADER_GROUPS)} THEN 'bom' END AS kind,
    CASE WHEN len(grid) >= 2 AND width > 1 AND {_title('grid[1]')} THEN 1 WHEN len(grid) >= 3 AND width > 1 AND {_title('grid[2]')} THEN 2 ELSE 0 END AS skip FROM h),
  e AS (SELECT *, grid[skip + 1:] AS eff FROM k WHERE kind IS NOT NULL)
  SELECT {_KEY}, kind, CAST(len(eff[1]) AS BIGINT) AS width, CAST(len(eff) - CASE WHEN {_sub('eff[2]')} THEN 2 ELSE 1 END AS BIGINT) AS raw_rows FROM e WHERE len(eff) >= 2""")
def html_material_tables(s, d):
    """Every table rendered to HTML between other text and read as a material table by its key words."""
    m = blocks.material_tables(_rendered(s, d), bom.TABLE, "html")
    return m.select(*bom.TABLE, "kind", F.size("headers").cast("long").alias("width"), F.col("raw_rows").cast("long").alias("raw_rows"))


@query("html_section_tables", f"""WITH {_HTML}, n AS (SELECT *, CASE WHEN len(grid) < 2 OR len(list_distinct(grid[1])) = len(grid[1]) THEN 1
    WHEN len(grid) >= 4 AND (len({_filled('grid[3]')}) >= 2 AND len(list_distinct({_filled('grid[3]')})) = 1 AND regexp_matches({_filled('grid[3]')}[1], '^[0-9]+\\.\\s*\\S+$')) THEN 2
    WHEN len(grid) >= 4 AND {_header_like('grid[2]')} AND {_header_like('grid[3]')} AND NOT {_header_like('grid[4]')} THEN 3
    WHEN len(grid) >= 3 AND {_header_like('grid[2]')} THEN 2 ELSE 1 END AS n FROM h),
  b AS (SELECT *, grid[n + 1:] AS body FROM n)
  SELECT {_KEY}, CAST(width AS BIGINT) AS width, CAST(len(body) AS BIGINT) AS raw_rows, CAST(len(list_filter(body, lambda r: trim(array_to_string(r, ' ')) <> '' AND (regexp_matches(trim(array_to_string(r, ' ')), '\\[주\\]|〔주〕|【주】|^[①-⑩]|^[㉮-㉷]|^[-–] |^비\\s*고')
    OR coalesce(len({_filled('r')}) = 1 AND (length({_filled('r')}[1]) > 50 OR regexp_matches({_filled('r')}[1], '^\\([0-9]{{4}}\\)\\s*.+|^[0-9]+-[0-9]+(-[0-9]+)?\\s+.{{4,}}')), false)))) AS BIGINT) AS notes FROM b""")
def html_section_tables(s, d):
    """Every table rendered to HTML and read as a section table: header rows, notes set into it, width."""
    t = blocks.parsed_tables(_rendered(s, d).withColumn("sid", F.lit("S")), bom.TABLE, "sid", "html", {"none": ()})
    return t.select(*bom.TABLE, F.size("headers").cast("long").alias("width"), F.col("raw_rows").cast("long").alias("raw_rows"), F.size("notes").cast("long").alias("notes"))


@query("material_sections")
def material_sections(s, d):
    """(doc_id, section_id, type, status, columns, rows): the sections that an export of each document's material tables holds."""
    t = blocks.material_sections(blocks.material_tables(_rendered(s, d), bom.TABLE, "html"), ["doc_id"], ["section_ord", "table_ord"])
    return t.select("doc_id", "section_id", "type", "role", "status", F.size("headers").alias("columns"), F.size("rows").alias("rows"), F.size("warnings").alias("warnings"))


@query("first_stage", f"""WITH t AS (SELECT {_KEY}, domain, CASE WHEN quality.status = 'ok' THEN 1 WHEN quality.status IS NOT NULL THEN 2 ELSE 3 END AS stage FROM {_TABLES})
  SELECT {_KEY}, domain, stage FROM t QUALIFY stage = min(stage) OVER (PARTITION BY doc_id)""")
def first_stage(s, d):
    """Of each document the tables of the first stage that gave any: sound ones, faulty ones, unchecked ones."""
    t = contract.distinct_tables(table(s, d, "doc_tables")).withColumn("stage", F.when(F.col("quality.status") == "ok", 1).when(F.col("quality.status").isNotNull(), 2).otherwise(3))
    return blocks.first_stage(t.select(*bom.TABLE, "domain", "stage"), ["doc_id"], "stage").select(*bom.TABLE, "domain", "stage")


@query("fallback_signals", f"""WITH d AS (SELECT DISTINCT doc_id, section_ord, clean_text FROM doc_sections), c AS (SELECT doc_id, sum(coalesce(length(clean_text), 0)) AS chars, bool_or(coalesce(contains(clean_text, '견적'), false)) AS quote FROM d GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n, bool_or(coalesce(type = 'BOM_자재', false)) AS m, bool_or(coalesce(type = 'BOM_LINE_LIST', false)) AS l,
    max({" + ".join(f"CAST(contains(upper(array_to_string(headers, '')), '{w.replace(chr(39), chr(39) * 2)}') AS INTEGER)" for w in K.BOM_STRUCTURE)}) AS words FROM {_TABLES} GROUP BY doc_id),
  j AS (SELECT doc_id, chars, quote, coalesce(n, 0) AS n, coalesce(m AND l AND words >= 3, false) AS strong FROM c LEFT JOIN t USING (doc_id))
  SELECT doc_id, strong, n > 0 AND n <= 2 AND chars >= 1000 AND NOT strong AS mixed, n = 0 AND chars >= 500 AND quote AS quote FROM j""")
def fallback_signals(s, d):
    """(doc_id, strong, mixed, quote): whether a document's own tables suffice, or another reading is called for."""
    sec = table(s, d, "doc_sections").select("doc_id", "section_ord", "clean_text").distinct()
    c = sec.groupBy("doc_id").agg(F.sum(F.coalesce(F.length("clean_text"), F.lit(0))).alias("chars"), F.bool_or(F.coalesce(F.col("clean_text").contains("견적"), F.lit(False))).alias("q"))
    is_type = lambda k: F.bool_or(F.coalesce(F.col("type") == k, F.lit(False)))
    t = contract.distinct_tables(table(s, d, "doc_tables")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), is_type("BOM_자재").alias("m"), is_type("BOM_LINE_LIST").alias("l"), F.max(T.count_hits(F.upper(F.array_join("headers", "")), K.BOM_STRUCTURE)).alias("words"))
    j = c.join(t, "doc_id", "left").withColumn("strong", F.coalesce(blocks.strong_package(F.col("m"), F.col("l"), F.col("words")), F.lit(False)))
    f = blocks.fallback_signals(F.coalesce("n", F.lit(0)), F.lit(False), F.col("chars"), F.col("strong"), F.col("q"))
    return j.select("doc_id", "strong", f["mixed"].alias("mixed"), f["quote"].alias("quote"))


@query("composite_flags", f"""WITH h AS (SELECT {_KEY}, unnest(headers) AS h, unnest(range(len(headers))) AS col_ord FROM {_TABLES}),
  p AS (SELECT *, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(h, ''), '_[0-9]+$', ''), '\\s*\\|\\s*|_'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM h)
  SELECT {_KEY}, col_ord, len(p) >= 2 AS composite, len(p) >= 2 AND coalesce(upper(p[1]) = upper(p[2]), false) AS self_repeating FROM p""")
def composite_flags(s, d):
    h = contract.distinct_tables(table(s, d, "doc_tables")).select(*bom.TABLE, F.posexplode("headers").alias("col_ord", "h"))
    f = blocks.composite_flags(F.coalesce("h", F.lit("")))
    return h.select(*bom.TABLE, F.col("col_ord").cast("long").alias("col_ord"), f["composite"].alias("composite"), F.coalesce(f["self_repeating"], F.lit(False)).alias("self_repeating"))


@query("info_pairs", f"""WITH {_GRID}, r AS (SELECT {_KEY}, list(row ORDER BY row_ord) AS rows FROM g GROUP BY {_KEY}),
  t AS (SELECT {_KEY}, list_concat([list_transform(headers, lambda h: coalesce(h, ''))], coalesce(rows, [])) AS raw FROM {_TABLES} LEFT JOIN r USING ({_KEY}) WHERE len(headers) > 0),
  c AS (SELECT {_KEY}, {_filled('flatten(raw)')} AS c FROM t)
  SELECT {_KEY}, i, coalesce(c[4 * i + 1], '') AS item, coalesce(c[4 * i + 2], '') AS value, coalesce(c[4 * i + 3], '') AS item_2, coalesce(c[4 * i + 4], '') AS value_2
  FROM (SELECT *, unnest(range((len(c) + 3) // 4)) AS i FROM c)""")
def info_pairs(s, d):
    """Every table laid out as (item, value, item, value), the way company tables are read."""
    p = _rendered(s, d).select(*bom.TABLE, F.posexplode(blocks.info_pairs(F.col("headers"), F.col("rows"))).alias("i", "p"))
    return p.select(*bom.TABLE, F.col("i").cast("long").alias("i"), *[F.col("p")[k].alias(n) for k, n in enumerate(("item", "value", "item_2", "value_2"))])


@query("plain_html", """SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS plain_md5 FROM documents""")
def plain_html(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(blocks.plain_html(F.col("text"))).alias("plain_md5"))


@query("html_blocks", """SELECT doc_id, len(regexp_extract_all(t, '(?is)<table[^>]*>.*?</table>')) + CASE WHEN len(regexp_extract_all(t, '(?is)<table[^>]*>.*?</table>')) = 0 AND regexp_matches(t, '(?is)<table') THEN 1 ELSE 0 END AS blocks,
  length(regexp_replace(t, '(?is)<table[^>]*>.*?</table>', '', 'g')) AS rest FROM (SELECT doc_id, text || '<TABLE a="1"><tr></tr></table> x <table>' || coalesce(title, '') || '</table><table>' AS t FROM documents WHERE text IS NOT NULL)""")
def html_blocks(s, d):
    """Table blocks of every text with two closed tables and an open one behind it, and the length of the rest."""
    t = table(s, d, "documents").filter("text is not null").select("doc_id", F.concat("text", F.lit('<TABLE a="1"><tr></tr></table> x <table>'), F.coalesce("title", F.lit("")), F.lit("</table><table>")).alias("t"))
    rest = F.regexp_replace("t", r"(?is)<table[^>]*>.*?</table>", "")
    return t.select("doc_id", F.size(T.html_tables(F.col("t"))).cast("long").alias("blocks"), F.length(rest).cast("long").alias("rest"))


@query("header_rows", f"""WITH {_HTML} SELECT {_KEY}, CASE WHEN len(raw) < 2 OR len(list_distinct(raw[1])) = len(raw[1]) THEN 1
    WHEN len(raw) >= 4 AND (len({_filled('raw[3]')}) >= 2 AND len(list_distinct({_filled('raw[3]')})) = 1 AND regexp_matches({_clean(_filled('raw[3]') + '[1]')}, '^[0-9]+\\.\\s*\\S+$')) THEN 2
    WHEN len(raw) >= 4 AND {_header_like('raw[2]')} AND {_header_like('raw[3]')} AND NOT {_header_like('raw[4]')} THEN 3
    WHEN len(raw) >= 3 AND {_header_like('raw[2]')} THEN 2 ELSE 1 END AS n FROM w""")
def header_rows(s, d):
    """How many rows of every table's grid, its headers first, are header."""
    t = _rendered(s, d).select(*bom.TABLE, F.concat(F.array(F.transform("headers", lambda h: F.coalesce(h, F.lit("")))), "rows").alias("g"))
    return t.select(*bom.TABLE, T.header_rows(F.col("g")).cast("int").alias("n"))


@query("extended_headers", f"""WITH {_GRID}, r AS (SELECT {_KEY}, max(len(row)) AS w FROM g GROUP BY {_KEY}), t AS (SELECT {_KEY}, headers, coalesce(w, 0) AS w FROM {_TABLES} LEFT JOIN r USING ({_KEY}) WHERE len(headers) > 0)
  SELECT {_KEY}, array_to_string(list_concat(headers[:len(headers) - 1], list_transform(range(len(headers), greatest(w, len(headers) - 1) + 1), lambda k: 'Column_' || k)), '|') AS names FROM t""")
def extended_headers(s, d):
    """Headers without their last one, extended to the widest row."""
    t = _rendered(s, d).withColumn("h", F.slice("headers", F.lit(1), F.size("headers") - 1))
    return t.select(*bom.TABLE, F.array_join(T.extend_headers(F.col("h"), F.col("rows")), "|").alias("names"))


@query("filled_parents", f"""WITH t AS (SELECT {_KEY}, list_transform(headers, lambda h: {_strip("coalesce(h, '')")}) AS h FROM {_TABLES} WHERE len(headers) > 0),
  p AS (SELECT *, list_transform(range(1, len(h) + 1), lambda i: CASE WHEN i % 2 = 1 THEN h[i] ELSE '' END) AS par FROM t)
  SELECT {_KEY}, array_to_string(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN par[i] = '' AND h[i] <> '' THEN coalesce(list_filter(par[:i], lambda x: x <> '')[-1], '') ELSE par[i] END), '|') AS names FROM p""")
def filled_parents(s, d):
    """Every other header as a parent with a blank beside it, filled from the left where a child stands."""
    t = contract.distinct_tables(table(s, d, "doc_tables")).filter(F.size("headers") > 0).withColumn("h", F.transform("headers", lambda h: X.strip(F.coalesce(h, F.lit("")))))
    parents = F.transform("h", lambda h, i: F.when(i % 2 == 0, h).otherwise(""))
    return t.select(*bom.TABLE, F.array_join(T.fill_parents(parents, F.col("h")), "|").alias("names"))


@query("batch_rollup", f"""SELECT coalesce(domain, '') AS batch, count_if(q = 'ok') AS ok, count_if(q IS DISTINCT FROM 'ok') AS failed, CAST(coalesce(sum(CASE WHEN q = 'ok' THEN n END), 0) AS BIGINT) AS rows_ok, round(avg(n), 4) AS mean_rows,
  count_if(n = 0) AS without_rows FROM (SELECT domain, quality.status AS q, coalesce(parsed_row_count, 0) AS n FROM {_TABLES}) GROUP BY ALL""")
def batch_rollup(s, d):
    t = contract.distinct_tables(table(s, d, "doc_tables")).select(F.coalesce("domain", F.lit("")).alias("batch"), (F.col("quality.status") == "ok").alias("ok"), F.coalesce("parsed_row_count", F.lit(0)).alias("rows"))
    return reports.batch_rollup(t, "batch", "ok", "rows")


@query("run_comparison", f"""WITH a AS (SELECT coalesce(type, '') AS name, CAST(sum(coalesce(raw_row_count, 0)) AS DOUBLE) AS v FROM {_TABLES} GROUP BY ALL), b AS (SELECT coalesce(type, '') AS name, CAST(sum(coalesce(parsed_row_count, 0)) AS DOUBLE) AS v FROM {_TABLES} GROUP BY ALL)
  SELECT name, a.v AS baseline, b.v AS after, round(CASE WHEN a.v = 0 THEN 0 ELSE (b.v - a.v) / a.v * 100 END, 4) AS change_pct FROM a FULL JOIN b USING (name)""")
def run_comparison(s, d):
    """Raw against parsed rows a type, as two runs."""
    t = contract.distinct_tables(table(s, d, "doc_tables")).withColumn("name", F.coalesce("type", F.lit("")))
    total = lambda c: t.groupBy("name").agg(F.sum(F.coalesce(c, F.lit(0))).cast("double").alias("v"))
    return reports.compare_runs(total("raw_row_count"), total("parsed_row_count"), "name", "v")


@query("artifact_kinds", """WITH f AS (SELECT DISTINCT source_file AS path FROM export_files WHERE source_file IS NOT NULL UNION SELECT '_compare/bom/' || source_file FROM export_files WHERE source_file IS NOT NULL UNION SELECT 'run_summary.md' UNION SELECT 'a/manifest.json' UNION SELECT 'b/물량표.xlsx')
  SELECT path, CASE WHEN regexp_matches(path, '(^|/)manifest\\.json$') THEN 'manifest' WHEN regexp_matches(path, '(^|/)run_summary\\.md$') THEN 'summary' WHEN lower(path) LIKE '%.json' THEN 'json' WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.xlsx' THEN 'excel' WHEN lower(path) LIKE '%.pdf' THEN 'pdf' ELSE 'other' END AS kind,
    list_contains(string_split(path, '/'), '_compare') AS compared, CASE WHEN list_contains(string_split(path, '/'), '_compare') THEN 'diagnostic' ELSE 'representative' END AS role,
    NOT regexp_matches(upper(path), 'COVER|DWG LIST|물량|SUPPORT_물량') AS target, 'case-1/' || path AS prefixed, NOT (path LIKE '/%' OR list_contains(string_split(path, '/'), '..')) AS safe FROM f""")
def artifact_kinds(s, d):
    own = table(s, d, "export_files").filter("source_file is not null").select(F.col("source_file").alias("path"))
    more = s.createDataFrame([("run_summary.md",), ("a/manifest.json",), ("b/물량표.xlsx",)], "path string")
    p = own.unionByName(own.select(F.concat(F.lit("_compare/bom/"), "path").alias("path"))).unionByName(more).distinct()
    return reports.artifacts(p, "path", "case-1")


@query("input_guards", """SELECT doc_id, n_chars > 500 AS too_long, length(text) <= 10000000 AS fits, coalesce(lower(title) LIKE '%.pdf', false) AS is_pdf FROM documents""")
def input_guards(s, d):
    return table(s, d, "documents").select("doc_id", (~reports.within(F.col("n_chars"), 500)).alias("too_long"), reports.within(F.length("text"), 10_000_000).alias("fits"), reports.is_pdf(F.col("title")).alias("is_pdf"))


@query("text_sheet", f"""WITH s AS (SELECT DISTINCT doc_id, section_ord, title, clean_text FROM doc_sections QUALIFY row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY title NULLS LAST, clean_text NULLS LAST) = 1)
  SELECT doc_id, row_no, title, chars FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_ord) + 1 AS row_no, coalesce(title, '') AS title, length(clean_text) AS chars, clean_text FROM s) WHERE clean_text IS NOT NULL AND regexp_replace(clean_text, '{_S}+', '', 'g') <> ''""")
def text_sheet(s, d):
    """Rows of a text sheet: sections without text are left out but keep their row."""
    return reports.text_sheet(table(s, d, "doc_sections")).select("doc_id", "row_no", "title", F.length("text").cast("long").alias("chars"))


@query("manifest_lookup", """WITH f AS (SELECT DISTINCT file_id, series, source_file, export_date FROM export_files WHERE source_file IS NOT NULL AND export_date IS NOT NULL)
  SELECT source_file AS path, arg_max(series, (export_date, file_id)) AS series, count(*) AS entries FROM f WHERE series IS NOT NULL GROUP BY source_file""")
def manifest_lookup(s, d):
    f = table(s, d, "export_files").filter("source_file is not null and export_date is not null and series is not null").select("file_id", F.col("series"), F.col("source_file").alias("path"), "export_date").distinct()
    return reports.latest_entries(f, "path", ["export_date", "file_id"], "series")


@query("qa_report", f"""WITH t AS (SELECT CASE WHEN quality.status = 'ok' THEN 'PASS' WHEN quality.status IN ('warning', 'warn') THEN 'WARN' WHEN quality.status IS NULL THEN 'NONE' ELSE 'FAIL' END AS v FROM {_TABLES}), c AS (SELECT v, count(*) AS n FROM t GROUP BY v)
  SELECT 0 AS line_no, '# QA: ' || CASE WHEN count_if(v = 'FAIL') > 0 THEN 'FAIL' WHEN count_if(v = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS line FROM c
  UNION ALL SELECT CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER), '- ' || v || ': ' || n FROM c""")
def qa_report(s, d):
    q = F.col("quality.status")
    v = F.when(q == "ok", "PASS").when(q.isin("warning", "warn"), "WARN").when(q.isNull(), "NONE").otherwise("FAIL")
    return reports.qa_report(contract.distinct_tables(table(s, d, "doc_tables")).select(v.alias("verdict")))


@query("job_capacity", """WITH e AS (SELECT DISTINCT id, job_id, lower(status) AS status FROM usage_events WHERE job_id IS NOT NULL), j AS (SELECT job_id, min(id) AS first_id, max(id) AS last_id, count_if(status = 'error') AS errors, count(*) AS n FROM e GROUP BY job_id)
  SELECT job_id, CASE WHEN errors = n THEN 'failed' WHEN errors > 0 THEN 'partial' ELSE 'done' END AS status, last_id - first_id + 1 AS span, last_id - first_id >= 10 AS over_capacity FROM j""")
def job_capacity(s, d):
    """The state of every job from its calls, and whether it outgrew ten queued calls."""
    e = table(s, d, "usage_events").filter("job_id is not null").select("id", "job_id", F.lower("status").alias("status")).distinct()
    return reports.job_states(e, 10)


@query("key_exhaustion", """WITH e AS (SELECT DISTINCT id, engine FROM usage_events), n AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM e), r AS (SELECT id, n, (n - 1) // 7 AS turn FROM n)
  SELECT id, CAST(CASE WHEN turn % 4 = 2 THEN 3 ELSE turn % 4 END AS INTEGER) AS slot FROM r""")
def key_exhaustion(s, d):
    """Calls in order over four keys of seven calls each, the third of which is used up: its turns go to the next."""
    e = table(s, d, "usage_events").select("id").distinct()
    return reports.serve_calls(e, "id", keys=4, quota=7, exhausted=(2,)).select("id", "slot")


@query("workbook_values", f"""SELECT doc_id, count(*) FILTER (WHERE {_strip("coalesce(value, '')")} <> '') AS json_values, count(*) FILTER (WHERE {_strip("coalesce(value, '')")} <> '') AS sheet_values, false AS loss
  FROM {_CELLS} SEMI JOIN (SELECT {_KEY} FROM doc_tables) USING ({_KEY}) GROUP BY doc_id""")
def workbook_values(s, d):
    """Values of every document's tables against those of the workbook written from them and read back."""
    a = cut(contract.tables_with_rows(table(s, d, "doc_tables"), table(s, d, "doc_cells")).filter(F.size("rows") > 0).withColumn("role", F.coalesce("saved_role", F.lit("table"))))
    folder = scratch(s, "books")
    written = cut(sinks.write_workbooks(a, folder if "://" in folder else folder.removeprefix("file:")))
    n = a.groupBy("doc_id").agg(F.sum(F.size(F.filter(F.flatten("rows"), lambda x: X.strip(F.coalesce(x, F.lit(""))) != ""))).alias("json_values"))
    j = n.join(sinks.workbook_values(written), "doc_id")
    return j.select("doc_id", F.col("json_values").cast("long").alias("json_values"), "sheet_values", (F.col("sheet_values") < F.col("json_values")).alias("loss"))


_MANIFEST = """m AS (SELECT coalesce(series, '') AS run_id, CASE WHEN file_id % 4 = 0 THEN '_compare/' ELSE '' END || coalesce(source_file, '') AS json, CASE WHEN file_id % 4 = 0 OR file_id % 7 = 0 THEN 'diagnostic' ELSE 'representative' END AS role,
  CASE WHEN file_id % 3 = 0 THEN 'estimate' ELSE 'bom' END AS domain, CASE WHEN received_at IS NULL THEN 'fail' ELSE 'ok' END AS quality_status FROM (SELECT DISTINCT file_id, series, source_file, received_at FROM export_files))"""


def _manifest(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "export_files").select("file_id", "series", "source_file", "received_at").distinct()
    part = lambda k: F.col("file_id") % k == 0
    return f.select(
        F.coalesce("series", F.lit("")).alias("run_id"), F.concat(F.when(part(4), "_compare/").otherwise(""), F.coalesce("source_file", F.lit(""))).alias("json"), F.when(part(4) | part(7), "diagnostic").otherwise("representative").alias("role"),
        F.when(part(3), "estimate").otherwise("bom").alias("domain"), F.when(F.col("received_at").isNull(), "fail").otherwise("ok").alias("quality_status"),
    )


@query("manifest_roles", f"WITH {_MANIFEST} SELECT run_id, count(*) AS entries, count_if(role = 'representative') AS representative, count_if(role = 'diagnostic') AS diagnostic, count_if(quality_status = 'fail') AS failed FROM m GROUP BY run_id")
def manifest_roles(s, d):
    """Entries of every run's manifest by the role that the manifest gives."""
    return reports.manifest_counts(_manifest(s, d))


@query("manifest_boms", f"WITH {_MANIFEST} SELECT DISTINCT run_id, json FROM m WHERE role = 'representative' AND domain = 'bom' AND NOT list_contains(string_split(json, '/'), '_compare')")
def manifest_boms(s, d):
    """The files of every run that a roll-up of bills of materials reads."""
    return reports.representative_jsons(_manifest(s, d))
