"""Names, headers, boxes and rows brought into form, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.catalog.tables import _CELLS, _GRID, _KEY, _S, _TABLES, _compact, _strip
from quirelake.functions import grid as G
from quirelake.functions import numbers as N
from quirelake.functions import tables as T
from quirelake.functions import text as X
from quirelake.operators import bom, contract, layout, metadata, positions, reports, toc
from quirelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_SECTIONS = "(SELECT DISTINCT doc_id, section_ord, section_id, title, department, chapter, page FROM doc_sections)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("sheet_tokens", f"""SELECT {_KEY}, col_ord, regexp_replace(regexp_replace(trim(regexp_replace(coalesce(h, ''), '{_S}+', ' ', 'g')), '[\\[\\]:*?/\\\\]', '_', 'g'), '^[ .'']+|[ .'']+$', '', 'g') AS token
  FROM (SELECT {_KEY}, unnest(headers) AS h, unnest(range(len(headers))) AS col_ord FROM {_TABLES})""")
def sheet_tokens(s, d):
    h = contract.distinct_tables(table(s, d, "doc_tables")).select(*bom.TABLE, F.posexplode("headers").alias("col_ord", "h"))
    return h.select(*bom.TABLE, F.col("col_ord").cast("long").alias("col_ord"), X.sheet_token(F.col("h")).alias("token"))


@query("output_names", """WITH f AS (SELECT DISTINCT file_id, source_file, received_at FROM export_files WHERE source_file IS NOT NULL AND received_at IS NOT NULL)
  SELECT file_id, strftime(received_at, '%Y%m%d') || '_' || regexp_replace(regexp_extract(source_file, '([^/\\\\]*)$', 1), '\\.[^.]*$', '') || CASE WHEN file_id % 2 = 0 THEN '_p' || file_id || '-' || (file_id + 3) ELSE '' END AS name FROM f""")
def output_names(s, d):
    """Base names of outputs, every other one for a part of the pages."""
    f = table(s, d, "export_files").filter("source_file is not null and received_at is not null").select("file_id", "source_file", "received_at").distinct()
    part = F.when(F.col("file_id") % 2 == 0, F.col("file_id"))
    return f.select("file_id", N.output_base_name(F.col("source_file"), F.col("received_at"), part, part + 3).alias("name"))


@query("code_fences", f"""SELECT doc_id, md5({_strip("text")}) AS text_md5 FROM documents WHERE text IS NOT NULL AND NOT starts_with({_strip("text")}, '```') AND NOT ends_with({_strip("text")}, '```')
  UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL OR starts_with({_strip("text")}, '```') OR ends_with({_strip("text")}, '```')""")
def code_fences(s, d):
    """Every text set into a code fence and taken out again; null where it has fences of its own."""
    own = X.strip(F.col("text"))
    out = X.strip_code_fence(F.concat(F.lit(" ```json\n"), own, F.lit("\n```\n")))
    fenced = F.coalesce(own.startswith("```") | own.endswith("```"), F.lit(True))
    return table(s, d, "documents").select("doc_id", F.when(~fenced, F.md5(out)).alias("text_md5"))


_BOXES = """b AS (SELECT doc_id, page_num, unnest(CAST(layout AS JSON[])) AS x, unnest(range(len(CAST(layout AS JSON[])))) AS i FROM (SELECT DISTINCT doc_id, page_num, layout FROM ocr_pages) WHERE layout IS NOT NULL),
  k AS (SELECT doc_id, page_num, i, CAST(x->'$.bbox[0]' AS DOUBLE) AS x0, CAST(x->'$.bbox[1]' AS DOUBLE) AS y0, CAST(x->'$.bbox[2]' AS DOUBLE) AS x1, CAST(x->'$.bbox[3]' AS DOUBLE) AS y1 FROM b)"""


def _boxes(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "ocr_pages").select("doc_id", "page_num", "layout").distinct()
    b = p.select("doc_id", "page_num", F.posexplode(layout.blocks(F.col("layout"))).alias("n", "b"))
    return b.select("doc_id", "page_num", F.col("b.i").alias("ord"), *[F.col("b.bbox")[k].cast("double").alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])


@query("box_overlaps", f"""WITH {_BOXES}, p AS (SELECT a.doc_id, a.page_num, a.i, greatest((a.x1 - a.x0) * (a.y1 - a.y0), 1.0) AS ra, greatest((b.x1 - b.x0) * (b.y1 - b.y0), 1.0) AS rb,
    greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0) AS shared
    FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND b.i = a.i + 1)
  SELECT doc_id, page_num, CAST(i AS INTEGER) AS ord, round(shared / least(ra, rb), 6) AS overlap, round(least(ra, rb) / greatest(ra, rb), 6) AS areas FROM p""")
def box_overlaps(s, d):
    """Every box against the next one of its page."""
    b = _boxes(s, d)
    one = lambda p: F.struct(*[F.col(f"{p}.{c}") for c in ("x0", "y0", "x1", "y1")])
    a, c = b.alias("a"), b.withColumn("ord", F.col("ord") - 1).alias("c")
    j = a.join(c, ["doc_id", "page_num", "ord"])
    return j.select("doc_id", "page_num", F.col("ord").cast("int").alias("ord"), F.round(N.overlap_ratio(one("a"), one("c")), 6).alias("overlap"), F.round(N.area_ratio(one("a"), one("c")), 6).alias("areas"))


@query("page_extents", f"WITH {_BOXES} SELECT doc_id, page_num, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM k GROUP BY ALL")
def page_extents(s, d):
    w = _boxes(s, d).select("doc_id", "page_num", "x0", F.col("y0").alias("top"), "x1", F.col("y1").alias("bottom"))
    return layout.bounding_box(w, ["doc_id", "page_num"])


@query("chapter_forms", f"""SELECT doc_id, section_ord, CASE WHEN regexp_matches(c, '^제[0-9]+장') THEN regexp_extract(c, '^제[0-9]+장') || ' ' || CASE WHEN regexp_matches({_strip("regexp_extract(c, '^제[0-9]+장(.*)$', 1)")}, '^[가-힣](\\s+[가-힣])*$') THEN regexp_replace(regexp_extract(c, '^제[0-9]+장(.*)$', 1), '{_S}+', '', 'g') ELSE {_strip("regexp_extract(c, '^제[0-9]+장(.*)$', 1)")} END ELSE {_strip("c")} END AS name,
  CASE WHEN n >= 10 AND length(regexp_extract(i, '^([0-9]+)', 1)) = 1 AND TRY_CAST(regexp_extract(i, '^([0-9]+)', 1) AS INTEGER) = n % 10 THEN n || regexp_replace(i, '^[0-9]+', '') ELSE i END AS id
  FROM (SELECT doc_id, section_ord, coalesce(chapter, '제3장 공 통') AS c, coalesce(section_id, '') AS i, 10 + section_ord % 5 AS n FROM {_SECTIONS})""")
def chapter_forms(s, d):
    """Chapter names in form and ids with the lost digit of chapters from 10 on."""
    x = table(s, d, "doc_sections").select("doc_id", "section_ord", "section_id", "title", "department", "chapter", "page").distinct()
    n = (F.pmod("section_ord", F.lit(5)) + 10).cast("int")
    return x.select("doc_id", "section_ord", X.section_name(F.coalesce("chapter", F.lit("제3장 공 통"))).alias("name"), X.repair_section_id(F.coalesce("section_id", F.lit("")), n).alias("id"))


@query("merged_sub_headers", f"""WITH {_GRID}, r AS (SELECT {_KEY}, arg_min(row, row_ord) AS row FROM g GROUP BY {_KEY}), t AS (SELECT {_KEY}, headers, row FROM {_TABLES} JOIN r USING ({_KEY}) WHERE len(headers) > 0),
  z AS (SELECT {_KEY}, list_transform(range(1, greatest(len(headers), len(row)) + 1), lambda i: [{_strip("coalesce(headers[i], '')")}, {_strip("coalesce(row[i], '')")}]) AS p FROM t),
  m AS (SELECT {_KEY}, list_transform(p, lambda x, i: CASE WHEN x[2] = '' OR {_compact('x[1]')} = {_compact('x[2]')} THEN CASE WHEN x[1] = '' THEN 'Column_' || i ELSE x[1] END WHEN x[1] = '' THEN x[2] ELSE x[1] || ' | ' || x[2] END) AS n FROM z)
  SELECT {_KEY}, array_to_string(list_transform(n, lambda x, i: CASE WHEN len(list_filter(n[:i], lambda y: y = x)) > 1 THEN x || '_' || len(list_filter(n[:i], lambda y: y = x)) ELSE x END), chr(10)) AS names FROM m""")
def merged_sub_headers(s, d):
    """Headers of every table merged with its first row as sub-headers."""
    t = contract.tables_with_rows(table(s, d, "doc_tables"), table(s, d, "doc_cells")).filter((F.size("headers") > 0) & (F.size("rows") > 0))
    return t.select(*bom.TABLE, F.array_join(T.merge_sub_headers(F.col("headers"), F.col("rows")[0]), "\n").alias("names"))


@query("number_marks", f"SELECT doc_id, section_ord, table_ord, row_ord, col_ord, header, regexp_matches({_strip('value')}, '^-?[0-9,]+$') AS number FROM {_CELLS} WHERE value IS NOT NULL")
def number_marks(s, d):
    c = bom.distinct_cells(table(s, d, "doc_cells")).filter("value is not null")
    return c.select(*bom.TABLE, "row_ord", "col_ord", "header", N.is_number(F.col("value")).alias("number"))


@query("gap_rows", """WITH l AS (SELECT doc_id, page_num, string_split(coalesce(text, ''), chr(10)) AS ls FROM (SELECT DISTINCT doc_id, page_num, text FROM ocr_pages WHERE text IS NOT NULL))
  SELECT doc_id, page_num, len(list_filter(list_transform(ls, lambda x: regexp_split_to_array('a' || x || 'a', '\\s{2,}')), lambda r: len(r) >= 3)) AS n FROM l""")
def gap_rows(s, d):
    """Lines of every page that runs of blanks part into three cells, each line between two letters."""
    p = table(s, d, "ocr_pages").filter("text is not null").select("doc_id", "page_num", "text").distinct()
    framed = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("a"), x, F.lit("a"))), "\n")
    return p.select("doc_id", "page_num", F.size(T.gap_rows(framed)).cast("long").alias("n"))


@query("sheet_kinds", f"""SELECT {_KEY}, CASE WHEN domain = 'bom' AND role IN ('primary_material_table', 'line_list_table') THEN 'bom_generic' WHEN domain = 'estimate' AND role IN ('estimate_table', 'detail_table', 'condition_table') THEN replace(role, '_table', '') ELSE 'generic' END AS sheet FROM {_TABLES}""")
def sheet_kinds(s, d):
    return contract.distinct_tables(table(s, d, "doc_tables")).select(*bom.TABLE, contract.sheet_kind(F.col("domain"), F.col("role")).alias("sheet"))


@query("toc_reverse", f"""SELECT doc_id, regexp_replace(id, '#.*$', '') AS id, chapter, arg_max(toc_key, ord) AS toc_key FROM (SELECT doc_id, section_id || CASE WHEN section_ord % 2 = 0 THEN '#2' ELSE '' END AS id, coalesce(chapter, '') AS chapter, section_id || '/' || section_ord AS toc_key, section_ord AS ord FROM {_SECTIONS} WHERE section_id IS NOT NULL) GROUP BY ALL""")
def toc_reverse(s, d):
    x = table(s, d, "doc_sections").filter("section_id is not null").select("doc_id", "section_ord", "section_id", "chapter").distinct()
    t = x.select("doc_id", F.concat("section_id", F.when(F.col("section_ord") % 2 == 0, "#2").otherwise("")).alias("id"), F.coalesce("chapter", F.lit("")).alias("chapter"), F.concat_ws("/", "section_id", F.col("section_ord").cast("string")).alias("toc_key"), F.col("section_ord").alias("ord"))
    return toc.reverse_map(t, ["doc_id"])


@query("pipe_roundtrip", f"""WITH {_GRID}, r AS (SELECT {_KEY}, list(row ORDER BY row_ord) AS rows FROM g GROUP BY {_KEY}), t AS (SELECT {_KEY}, headers, coalesce(rows, []) AS rows FROM {_TABLES} LEFT JOIN r USING ({_KEY}) WHERE len(headers) > 1)
  SELECT {_KEY}, CAST(len(rows) + 1 AS BIGINT) AS rows, CAST(len(headers) AS BIGINT) AS width, length(array_to_string(list_transform(headers, lambda h: trim(regexp_replace(replace(coalesce(h, ''), '|', '/'), '{_S}+', ' ', 'g'))), '|')) AS head_chars FROM t""")
def pipe_roundtrip(s, d):
    """Every table written as a pipe table, turned into HTML and read back by the grid kernel."""
    t = contract.tables_with_rows(table(s, d, "doc_tables"), table(s, d, "doc_cells")).filter(F.size("headers") > 1)
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: X.collapse(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("/")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size("headers")))
    md = F.concat(line(F.col("headers")), F.lit("\n"), rule, F.array_join(F.transform("rows", lambda r: F.concat(F.lit("\n"), line(r))), ""))
    g = t.select(*bom.TABLE, F.explode(F.array(G.html_grid(G.markdown_tables_to_html(md)))).alias("g"))
    return g.select(*bom.TABLE, F.size("g").cast("long").alias("rows"), F.size(F.col("g")[0]).cast("long").alias("width"), F.length(F.array_join(F.col("g")[0], "|")).cast("long").alias("head_chars"))


@query("condition_rows")
def condition_rows(s, d):
    """(table key, label, value, note): condition rows set into the tables of every document."""
    t = contract.tables_with_rows(table(s, d, "doc_tables"), table(s, d, "doc_cells")).select(*bom.TABLE, contract.split_conditions(F.col("rows")).alias("c"))
    return t.select(*bom.TABLE, F.posexplode("c.conditions").alias("n", "x")).select(*bom.TABLE, "n", "x.label", "x.value", "x.note")


@query("cover_fields")
def cover_fields(s, d):
    """(doc_id, client, project, amount): the cover fields of every document's text."""
    c = table(s, d, "documents").select("doc_id", metadata.cover(F.coalesce("text", F.lit(""))).alias("c"))
    return c.select("doc_id", "c.client", "c.project", "c.amount")


@query("realigned_rows")
def realigned_rows(s, d):
    """(table key, row_ord, row): rows of every table without their blank cells, set right under headers whose middle is composite."""
    t = contract.tables_with_rows(table(s, d, "doc_tables"), table(s, d, "doc_cells")).filter(F.size("headers") > 4)
    n = F.size("headers")
    heads = F.transform("headers", lambda h, i: F.when((i >= 2) & (i < n - 2), F.concat(F.lit("W | "), F.coalesce(h, F.lit("")))).otherwise(F.coalesce(h, F.lit(""))))
    short = F.transform("rows", lambda r: T.filled(r))
    g = t.select(*bom.TABLE, F.explode(F.array(G.normalised(short, heads))).alias("g"))
    return g.select(*bom.TABLE, F.posexplode("g").alias("row_no", "r")).select(*bom.TABLE, "row_no", F.array_join("r", "|").alias("row"))



def _token(x: str) -> str:
    return f"regexp_replace(regexp_replace(trim(regexp_replace(coalesce({x}, ''), '{_S}+', ' ', 'g')), '[\\[\\]:*?/\\\\]', '_', 'g'), '^[ .'']+|[ .'']+$', '', 'g')"


@query("sheet_names", f"""WITH t AS (SELECT {_KEY}, role, type, coalesce(CASE type WHEN 'A_품셈' THEN '품셈' WHEN 'B_규모기준' THEN '규모기준' WHEN 'C_구분설명' THEN '설명' WHEN 'D_기타' THEN '설명' END, '표') AS label, coalesce(CASE type WHEN 'A_품셈' THEN '품셈' WHEN 'B_규모기준' THEN '규모기준' WHEN 'C_구분설명' THEN '설명' WHEN 'D_기타' THEN '설명' END, 'BOM_자재표') AS bom_label,
    {_token("headers[1]")} AS st, {_token("table_id")} AS tt FROM {_TABLES}),
  n AS (SELECT *, CASE role WHEN 'source_info_table' THEN '업체정보' WHEN 'material_quantity_table' THEN '물량산출표' END AS own FROM t)
  SELECT {_KEY}, coalesce(own, CASE WHEN st <> '' AND lower(st) NOT IN ('doc', 'inline_text') THEN CASE WHEN NOT contains(st, label) THEN st || '_' || label ELSE st END WHEN tt <> '' AND lower(tt) NOT IN ('doc', 'inline_text') THEN tt ELSE label END) AS name,
    CASE WHEN role = 'line_list_table' OR type = 'BOM_LINE_LIST' THEN 'BOM_LINE_LIST' ELSE coalesce(own, CASE WHEN st <> '' AND lower(st) NOT IN ('doc', 'inline_text') THEN CASE WHEN NOT contains(st, bom_label) THEN st || '_' || bom_label ELSE st END WHEN tt <> '' AND lower(tt) NOT IN ('doc', 'inline_text') THEN tt ELSE bom_label END) END AS bom_name FROM n""")
def sheet_names(s, d):
    """Names of the sheets of every table, its first header standing for the section's title."""
    t = contract.distinct_tables(table(s, d, "doc_tables"))
    first = F.try_element_at("headers", F.lit(1))
    name = reports.sheet_name(F.col("role"), first, F.col("table_id"), reports.type_label(F.col("type"), "표"))
    return t.select(*bom.TABLE, name.alias("name"), reports.material_sheet_name(F.col("role"), F.col("type"), first, F.col("table_id")).alias("bom_name"))


@query("context_markers", f"""SELECT doc_id, section_ord, CASE WHEN section_id IS NULL THEN '' ELSE '<!-- CONTEXT: ' || section_id || ' | ' || coalesce(title, '') || ' | 부문:' || coalesce(department, '') || ' | 장:' || coalesce(chapter, '') || ' -->' || chr(10) || chr(10) END AS context,
  '<!-- PAGE ' || coalesce(page, 0) || CASE WHEN coalesce(title, '') <> '' THEN ' | ' || title ELSE '' END || ' -->' AS page_mark FROM {_SECTIONS}""")
def context_markers(s, d):
    x = table(s, d, "doc_sections").select("doc_id", "section_ord", "section_id", "title", "department", "chapter", "page").distinct()
    context = positions.context_marker(F.col("section_id"), F.col("title"), F.col("department"), F.col("chapter"))
    return x.select("doc_id", "section_ord", context.alias("context"), positions.page_marker(F.coalesce("page", F.lit(0)), F.col("title")).alias("page_mark"))


@query("call_rules", """WITH e AS (SELECT DISTINCT id, engine, status, input_tokens, output_tokens, total_tokens FROM usage_events)
  SELECT id, coalesce(contains(m, '429') OR regexp_matches(lower(m), 'quota|rate limit'), false) AS rate_limit, CASE WHEN total_tokens IS NULL THEN 'never' WHEN k IN ('auto', 'always', 'never') THEN k ELSE 'auto' END AS mode, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens,
    CASE WHEN id % 3 = 0 THEN 'b_2' WHEN id % 3 = 1 THEN 'b' ELSE 'b_1' END AS name
  FROM (SELECT *, CASE WHEN lower(status) = 'error' THEN 'HTTP 429 ' || engine WHEN id % 5 = 0 THEN 'Rate Limit reached' ELSE status END AS m, CASE id % 4 WHEN 0 THEN 'always' WHEN 1 THEN 'never' WHEN 2 THEN 'x' END AS k FROM e)""")
def call_rules(s, d):
    """Every call put through the rules of engines: limits, fallback mode, token counts of an answer, reserved names."""
    e = table(s, d, "usage_events").select("id", "engine", "status", "input_tokens", "output_tokens", "total_tokens").distinct()
    said = F.when(F.lower("status") == "error", F.concat(F.lit("HTTP 429 "), "engine")).when(F.col("id") % 5 == 0, "Rate Limit reached").otherwise(F.col("status"))
    asked = F.when(F.col("id") % 4 == 0, "always").when(F.col("id") % 4 == 1, "never").when(F.col("id") % 4 == 2, "x")
    answer = F.to_json(F.struct(F.struct(F.col("input_tokens").alias("prompt_token_count"), F.col("output_tokens").alias("candidates_token_count")).alias("usage_metadata")))
    n = reports.token_counts(answer)
    taken = F.when(F.col("id") % 3 == 0, F.array(F.lit("b"), F.lit("b_1"))).when(F.col("id") % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("b")))
    return e.select("id", reports.is_rate_limit(said).alias("rate_limit"), reports.fallback_mode(asked, F.col("total_tokens").isNull()).alias("mode"), n["input_tokens"].alias("input_tokens"), n["output_tokens"].alias("output_tokens"), reports.reserved_name(F.lit("b"), taken).alias("name"))


@query("estimate_sheet", f"""WITH t AS (SELECT * FROM {_TABLES} WHERE domain = 'estimate' AND len(headers) > 0), c AS (SELECT {_KEY}, row_ord, col_ord, value, dense_rank() OVER (PARTITION BY {_KEY} ORDER BY row_ord) AS rn,
    row_number() OVER (PARTITION BY {_KEY}, row_ord ORDER BY col_ord, coalesce(value, '')) AS cn FROM {_CELLS}),
  x AS (SELECT {_KEY}, rn + 2 AS row_no, cn AS col_no, {_strip("coalesce(value, '')")} AS text FROM c SEMI JOIN t USING ({_KEY}))
  SELECT {_KEY}, CAST(row_no AS BIGINT) AS row_no, CAST(col_no AS BIGINT) AS col_no, text, CASE WHEN col_no >= 5 AND regexp_full_match(text, '-?[0-9,]+\\.?[0-9]*') AND NOT regexp_matches(replace(text, ',', ''), '^-?0[0-9]') THEN try_cast(replace(text, ',', '') AS DOUBLE) END AS number FROM x WHERE text <> ''
  UNION ALL SELECT {_KEY}, 2, unnest(range(1, len(headers) + 1)), unnest(list_transform(headers, lambda h: coalesce(h, ''))), NULL FROM t
  UNION ALL SELECT t.doc_id, t.section_ord, t.table_ord, coalesce(r.n, 0) + 3, 1, '※ ' || array_to_string(notes, ' / '), NULL FROM t LEFT JOIN (SELECT {_KEY}, max(rn) AS n FROM c GROUP BY ALL) r ON r.doc_id = t.doc_id AND r.section_ord = t.section_ord AND r.table_ord = t.table_ord WHERE len(notes) > 0""")
def estimate_sheet(s, d):
    """Filled cells of the sheets of all estimate tables, headers and notes among them."""
    t = contract.tables_with_rows(table(s, d, "doc_tables"), table(s, d, "doc_cells"))
    notes = contract.distinct_tables(table(s, d, "doc_tables")).filter("domain = 'estimate'").select(*bom.TABLE, "notes")
    e = reports.estimate_sheet(t.join(notes, bom.TABLE), bom.TABLE).filter("text <> '' or row_no = 2")
    return e.select(*bom.TABLE, F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), "text", "number")


@query("two_columns", f"""WITH {_GRID} SELECT {_KEY}, row_ord, CASE WHEN len(cells) = 0 THEN '' WHEN len(cells) = 1 THEN cells[1] ELSE {_strip("array_to_string(cells[:len(cells) - 1], ' ')")} END AS label, CASE WHEN len(cells) < 2 THEN '' ELSE cells[len(cells)] END AS value FROM f""")
def two_columns(s, d):
    """Every row's filled cells as a label and a value."""
    g = bom.grids(table(s, d, "doc_cells")).withColumn("p", T.two_columns(T.filled(F.col("row"))))
    return g.select(*bom.TABLE, "row_ord", F.col("p")[0].alias("label"), F.col("p")[1].alias("value"))


@query("words_outside", f"""WITH {_BOXES} SELECT a.doc_id, a.page_num, CAST(a.i AS INTEGER) AS ord FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id = a.doc_id AND b.page_num = a.page_num AND b.i % 2 = 1 AND b.x0 <= (a.x0 + a.x1) / 2 AND (a.x0 + a.x1) / 2 <= b.x1 AND b.y0 <= (a.y0 + a.y1) / 2 AND (a.y0 + a.y1) / 2 <= b.y1)""")
def words_outside(s, d):
    """Blocks of every page, as words, whose middle lies in none of the page's odd blocks."""
    b = _boxes(s, d)
    w = b.select("doc_id", "page_num", "ord", "x0", F.col("y0").alias("top"), "x1", F.col("y1").alias("bottom"))
    return layout.words_outside(w, b.filter("ord % 2 = 1"), ["doc_id", "page_num"]).select("doc_id", "page_num", F.col("ord").cast("int").alias("ord"))


@query("doubled_tails", f"""WITH t AS (SELECT {_KEY}, list_transform(headers, lambda h: {_strip("coalesce(h, '')")}) AS h FROM {_TABLES} WHERE len(headers) > 1)
  SELECT {_KEY}, array_to_string(h, chr(10)) AS names FROM t""")
def doubled_tails(s, d):
    """Headers with their last one doubled past the end of the sub-headers, and trimmed again."""
    t = contract.distinct_tables(table(s, d, "doc_tables")).filter(F.size("headers") > 1).withColumn("h", F.transform("headers", lambda h: X.strip(F.coalesce(h, F.lit("")))))
    last = F.element_at("h", -1)
    more = F.concat("h", F.when(last == "", F.array().cast("array<string>")).otherwise(F.array(last, last)))
    return t.select(*bom.TABLE, F.array_join(T.trim_doubled_tail(more, F.transform("h", lambda h: F.lit("x")), more), "\n").alias("names"))


@query("unique_notes", f"""WITH n AS (SELECT doc_id, section_ord, table_ord, unnest(notes) AS note FROM {_TABLES}), k AS (SELECT *, regexp_replace(note, '{_S}+', '', 'g') AS k FROM n WHERE note IS NOT NULL)
  SELECT DISTINCT a.doc_id, a.section_ord, a.note FROM k a WHERE a.table_ord > 0 AND NOT EXISTS (SELECT 1 FROM k b WHERE b.doc_id = a.doc_id AND b.section_ord = a.section_ord AND b.table_ord = 0 AND a.k <> '' AND b.k <> '' AND (contains(a.k, b.k) OR contains(b.k, a.k)))""")
def unique_notes(s, d):
    """Notes of the later tables of every section that repeat none of its first table."""
    n = contract.distinct_tables(table(s, d, "doc_tables")).select(*bom.TABLE, F.explode("notes").alias("note")).filter("note is not null")
    later = n.filter("table_ord > 0").select("doc_id", "section_ord", "note").distinct()
    return metadata.unique_notes(later, n.filter("table_ord = 0"), ["doc_id", "section_ord"]).select("doc_id", "section_ord", "note")
