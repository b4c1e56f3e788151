"""Table structure, roll-ups and contracts over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import grid as G
from quirelake.functions import keywords as K
from quirelake.functions import tables as T
from quirelake.functions.text import canonical_detail_key, strip
from quirelake.operators import bom, contract
from quirelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_S = r"[\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CELLS = "(SELECT DISTINCT doc_id, section_ord, table_ord, row_ord, col_ord, header, value FROM doc_cells)"
_TABLES = "(SELECT * FROM doc_tables QUALIFY row_number() OVER (PARTITION BY doc_id, section_ord, table_ord) = 1)"
_KEY = "doc_id, section_ord, table_ord"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


def _lenient(c: str) -> str:
    t = f"replace({_strip(f'coalesce({c}, chr(32))')}, ',', '')"
    return (
        f"(CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST({t} AS DOUBLE) "
        f"WHEN regexp_full_match(regexp_extract({t}, '^([0-9.-]+)', 1), '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CAST(regexp_extract({t}, '^([0-9.-]+)', 1) AS DOUBLE) ELSE 0 END)"
    )


def _strings(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_ALIAS = "CASE " + " ".join(f"WHEN h IN ({_strings(v)}) THEN '{k}'" for k, v in K.BOM_ALIASES.items()) + " END"
_BOM_ROWS = f"""
c AS (SELECT *, upper({_strip("translate(header, '’‘', '''''')")}) AS h FROM {_CELLS} SEMI JOIN (SELECT {_KEY} FROM doc_tables WHERE domain = 'bom' AND type IS DISTINCT FROM 'BOM_LINE_LIST') USING ({_KEY})),
k AS (SELECT *, {_ALIAS} AS k FROM c),
r AS (SELECT {_KEY}, row_ord, {", ".join(f"coalesce(arg_min(coalesce(value, ''), col_ord) FILTER (WHERE k = '{k}'), '') AS {a}" for k, a in (("SIZE", "size"), ("MATERIAL", "material"), ("DESCRIPTION", "description"), ("QUANTITY", "q"), ("WEIGHT", "w")))}
      FROM k WHERE k IS NOT NULL GROUP BY ALL),
b AS (SELECT {_KEY}, row_ord, {_strip("size")} AS size, {_strip("material")} AS material, description, {_lenient("q")} AS qty, {_lenient("w")} AS weight FROM r)
"""


@query("bom_aggregate", f"""WITH {_BOM_ROWS} SELECT CAST(row_number() OVER (ORDER BY encode(size), encode(material)) AS BIGINT) AS item_no, * FROM (
  SELECT size, material, arg_min(description, (doc_id, section_ord, table_ord, row_ord)) AS description, round(sum(qty), 2) AS qty, round(sum(weight), 2) AS weight
  FROM b WHERE (size <> '' OR material <> '') AND (qty <> 0 OR weight <> 0) GROUP BY size, material)""")
def bom_aggregate(s, d):
    rows = bom.bom_rows(table(s, d, "doc_cells"), table(s, d, "doc_tables"))
    return bom.aggregate_boms(rows, ["doc_id", "section_ord", "table_ord", "row_ord"])


_ALL_ROWS = _BOM_ROWS.replace("domain = 'bom' AND", "(domain IN ('estimate', 'bom') OR domain IS NULL) AND")


@query("bom_aggregate_all", f"""WITH {_ALL_ROWS} SELECT CAST(row_number() OVER (ORDER BY encode(size), encode(material)) AS BIGINT) AS item_no, * FROM (
  SELECT size, material, arg_min(description, (doc_id, section_ord, table_ord, row_ord)) AS description, round(sum(qty), 2) AS qty, round(sum(weight), 2) AS weight
  FROM b WHERE (size <> '' OR material <> '') AND (qty <> 0 OR weight <> 0) GROUP BY size, material)""")
def bom_aggregate_all(s, d):
    """The roll-up over estimates and tables without a domain too, as files are aggregated."""
    rows = bom.bom_rows(table(s, d, "doc_cells"), table(s, d, "doc_tables"), ("bom", "estimate", None))
    return bom.aggregate_boms(rows, ["doc_id", "section_ord", "table_ord", "row_ord"])


@query("bom_rows", f"WITH {_BOM_ROWS} SELECT * FROM b")
def bom_rows(s, d):
    return bom.bom_rows(table(s, d, "doc_cells"), table(s, d, "doc_tables"))


@query("bom_pipe_roundtrip", """SELECT CAST(row_number() OVER (ORDER BY encode(size), encode(material)) AS BIGINT) AS item_no, * FROM (
  SELECT CAST(p_size AS VARCHAR) AS size, p_type AS material, min(p_name) AS description, round(sum(l_quantity), 2) AS qty, round(sum(round(l_extendedprice, 2)), 2) AS weight
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity <> 0 OR l_extendedprice <> 0 GROUP BY p_size, p_type)""")
def bom_pipe_roundtrip(s, d):
    """Orders rendered as pipe tables, parsed back, aliased, cast and rolled up."""
    line = F.concat_ws(" | ", F.lit("|"), F.col("p_size").cast("string"), "p_type", F.format_string("%.2f", "l_quantity"), F.format_string("%.2f", "l_extendedprice"), "p_name", F.lit("|"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice").join(table(s, d, "part").select("p_partkey", "p_size", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumn("line", F.regexp_replace(line, r"^\| \| ", "| ")).withColumn("line", F.regexp_replace("line", r" \| \|$", " |"))
    head = "| SIZE | MATL | Q'TY | WT(KG) | DESCRIPTION |\n|---|---|---|---|---|\n"
    docs = rows.groupBy("l_orderkey").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("md"))
    # explode keeps the parsed grid and its header as values; else both are computed again for every row
    parsed = docs.select("l_orderkey", F.explode(F.array(T.pipe_rows(F.col("md")))).alias("g"))
    named = parsed.select("l_orderkey", "g", F.explode(F.array(F.transform(F.col("g")[0], lambda h: bom.canonical_header(h)))).alias("headers"))
    grid = named.select("l_orderkey", "headers", F.posexplode(F.slice("g", F.lit(2), F.size("g"))).alias("row_ord", "row"))
    m = T.row_map(F.col("headers"), F.col("row"))
    out = grid.select("l_orderkey", "row_ord", m.alias("m")).select("l_orderkey", "row_ord", F.col("m")["SIZE"].alias("size"), F.col("m")["MATERIAL"].alias("material"), F.col("m")["DESCRIPTION"].alias("description"), *[bom.lenient_number(F.col("m")[k]).alias(a) for k, a in (("QUANTITY", "qty"), ("WEIGHT", "weight"))])
    return bom.aggregate_boms(out, ["description"])


@query("line_list_union", f"SELECT doc_id AS source_doc, section_ord, table_ord, row_ord, header, value FROM {_CELLS} SEMI JOIN (SELECT {_KEY} FROM doc_tables WHERE type = 'BOM_LINE_LIST') USING ({_KEY})")
def line_list_union(s, d):
    return bom.line_list(table(s, d, "doc_cells"), table(s, d, "doc_tables"))


@query("html_roundtrip", f"""SELECT {_KEY}, dense_rank() OVER (PARTITION BY {_KEY} ORDER BY row_ord) AS row_no, row_number() OVER (PARTITION BY {_KEY}, row_ord ORDER BY col_ord, header, value) AS col_no,
  trim(regexp_replace(coalesce(value, ''), '{_S}+', ' ', 'g')) AS value FROM {_CELLS}""")
def html_roundtrip(s, d):
    """Every table rendered to HTML and read back by the grid kernel."""
    c = F.struct("col_ord", "header", F.coalesce("value", F.lit("")).alias("value"))
    r = bom.distinct_cells(table(s, d, "doc_cells")).groupBy(*bom.TABLE, "row_ord").agg(F.array_sort(F.collect_list(c)).alias("c"))
    t = r.groupBy(*bom.TABLE).agg(F.array_sort(F.collect_list(F.struct("row_ord", F.transform("c", lambda x: x["value"]).alias("row"), F.transform("c", lambda x: F.coalesce(x["header"], F.lit(""))).alias("h")))).alias("rows"))
    html = T.render_html(F.col("rows")[0]["h"], F.transform("rows", lambda x: x["row"]))
    back = t.select(*bom.TABLE, G.html_grid(html).alias("g"), F.transform("rows", lambda x: F.size(x["row"])).alias("w"))
    cells = back.select(*bom.TABLE, "w", F.posexplode(F.slice("g", F.lit(2), F.size("g"))).alias("i", "row")).select(*bom.TABLE, (F.col("i") + 1).cast("long").alias("row_no"), F.posexplode(F.slice("row", F.lit(1), F.col("w")[F.col("i")])).alias("j", "value"))
    return cells.select(*bom.TABLE, "row_no", (F.col("j") + 1).cast("long").alias("col_no"), "value")


_GRID = f"g AS (SELECT {_KEY}, row_ord, list(coalesce(value, '') ORDER BY col_ord, header, value) AS row FROM {_CELLS} GROUP BY ALL), f AS (SELECT *, list_filter(list_transform(row, lambda x: {_strip('x')}), lambda x: x <> '') AS cells FROM g)"


@query("row_predicates", f"""WITH {_GRID} SELECT {_KEY}, row_ord,
  len(cells) = 0 OR {" OR ".join(f"contains(upper(array_to_string(row, ' ')), '{w.replace(chr(39), chr(39) * 2)}')" for w in K.NOISE_ROW)} OR (len(cells) > 1 AND len(list_distinct(cells)) = 1) AS noise,
  trim(array_to_string(row, ' ')) <> '' AND (regexp_matches(trim(array_to_string(row, ' ')), '\\[주\\]|〔주〕|【주】|^[①-⑩]|^[㉮-㉷]|^[-–] |^비\\s*고')
    OR coalesce(len(cells) = 1 AND (length(cells[1]) > 50 OR regexp_matches(cells[1], '^\\([0-9]{{4}}\\)\\s*.+|^[0-9]+-[0-9]+(-[0-9]+)?\\s+.{{4,}}')), false)) AS note,
  len(list_filter(row, lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9,.\\-\\s]*$'))) > len(row) * 0.5 AS header_like,
  len(cells) >= 2 AND len(list_filter(cells, lambda x: {" OR ".join(f"contains(upper(x), '{w.replace(chr(39), chr(39) * 2)}')" for w in K.SUB_HEADERS)})) >= 2 AND len(list_filter(cells, lambda x: regexp_matches(x, '^[0-9,.\\-\\s]*$'))) <= len(cells) * 0.4 AS sub_header
  FROM f""")
def row_predicates(s, d):
    c = F.struct("col_ord", "header", F.coalesce("value", F.lit("")).alias("value"))
    g = bom.distinct_cells(table(s, d, "doc_cells")).groupBy(*bom.TABLE, "row_ord").agg(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["value"]).alias("row"))
    r = F.col("row")
    return g.select(*bom.TABLE, "row_ord", T.is_noise_row(r).alias("noise"), T.is_note_row(r).alias("note"), T.is_header_like(r).alias("header_like"), T.is_sub_header(r).alias("sub_header"))


@query("unique_headers", f"""SELECT {_KEY}, pos - 1 AS col_ord, CASE WHEN n > 1 THEN b || '_' || n ELSE b END AS name FROM (
  SELECT {_KEY}, pos, b, row_number() OVER (PARTITION BY {_KEY}, b ORDER BY pos) AS n FROM (
    SELECT {_KEY}, pos, CASE WHEN {_strip("coalesce(h, '')")} = '' THEN 'Column_' || pos ELSE {_strip("coalesce(h, '')")} END AS b
    FROM (SELECT {_KEY}, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS pos FROM (SELECT {_KEY}, list_concat(headers, ['', headers[1], headers[2]]) AS hs FROM {_TABLES} WHERE len(headers) >= 2))))""")
def unique_headers(s, d):
    """Headers of all tables, each with a blank and its first two headers again at the end."""
    t = contract.distinct_tables(table(s, d, "doc_tables")).filter(F.size("headers") >= 2)
    hs = F.concat("headers", F.array(F.lit(""), F.col("headers")[0], F.col("headers")[1]))
    return t.select(*bom.TABLE, F.posexplode(T.unique_headers(hs)).alias("col_ord", "name")).withColumn("col_ord", F.col("col_ord").cast("long"))


@query("empty_tail", f"""WITH w AS (SELECT {_KEY}, col_ord, bool_or({_strip("coalesce(value, '')")} <> '') AS live FROM {_CELLS} GROUP BY ALL),
  h AS (SELECT {_KEY}, len(headers) AS width, unnest(headers) AS h, unnest(range(len(headers))) AS c FROM {_TABLES}),
  r AS (SELECT DISTINCT {_KEY} FROM doc_cells)
  SELECT h.doc_id, h.section_ord, h.table_ord, any_value(width) AS width, CASE WHEN any_value(r.doc_id) IS NULL THEN any_value(width) ELSE coalesce(max(c + 1) FILTER (WHERE NOT regexp_matches(h, '^(?i:Column_|col_)[0-9]+$') OR coalesce(live, false)), 0) END AS kept
  FROM h LEFT JOIN w ON w.doc_id = h.doc_id AND w.section_ord = h.section_ord AND w.table_ord = h.table_ord AND w.col_ord = h.c
  LEFT JOIN r ON r.doc_id = h.doc_id AND r.section_ord = h.section_ord AND r.table_ord = h.table_ord GROUP BY ALL""")
def empty_tail(s, d):
    t = contract.tables_with_rows(table(s, d, "doc_tables"), table(s, d, "doc_cells")).filter(F.size("headers") > 0)
    return t.select(*bom.TABLE, F.size("headers").cast("long").alias("width"), T.kept_columns(F.col("headers"), F.col("rows")).cast("long").alias("kept"))


def _compact(h: str) -> str:
    return f"regexp_replace(upper(regexp_replace(trim(regexp_replace(coalesce({h}, ''), '{_S}+', ' ', 'g')), '_[0-9]+$', '')), '(?:{_S}|[._|/''()\\[\\]-])+', '', 'g')"


def _sum(words, x: str) -> str:
    return " + ".join(f"CAST(contains({x}, '{w}') AS INTEGER)" for w in words)


def _any(words, x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


@query("table_contracts", f"""WITH t AS (SELECT {_KEY}, coalesce(type, '') AS type, domain AS saved_domain, headers, array_to_string(list_transform(headers, lambda h: {_compact("h")}), '') AS key FROM {_TABLES}),
  x AS (SELECT t.*, concat_ws(' ', array_to_string(headers, ' '), type, body) AS text FROM t LEFT JOIN
    (SELECT {_KEY}, string_agg(coalesce(value, ''), ' ' ORDER BY row_ord, col_ord) AS body FROM (SELECT *, dense_rank() OVER (PARTITION BY {_KEY} ORDER BY row_ord) AS rn FROM {_CELLS}) WHERE rn <= 3 GROUP BY {_KEY}) USING ({_KEY})),
  c AS (SELECT {_KEY}, saved_domain, CASE WHEN type = 'BOM_LINE_LIST' THEN 'bom/line_list_table'
    WHEN type = 'BOM_자재' OR (({_sum(K.BOM_MATERIAL_WORDS, 'key')}) >= 4 AND contains(key, 'DESCRIPTION')) THEN 'bom/primary_material_table'
    WHEN type = 'A_품셈' THEN 'pumsem/pumsem_quantity_table' WHEN type = 'B_규모기준' THEN 'pumsem/pumsem_size_table' WHEN type = 'C_구분설명' THEN 'pumsem/pumsem_description_table'
    WHEN {_any(K.TRADE_WORDS, 'text')} THEN 'trade_statement/trade_statement_table' WHEN ({_sum(K.ESTIMATE_WORDS, 'key')}) >= 4 THEN 'estimate/estimate_table' ELSE 'generic/generic_table' END AS c FROM x)
  SELECT split_part(c, '/', 1) AS domain, split_part(c, '/', 2) AS role, coalesce(saved_domain, 'none') AS saved_domain, count(*) AS tables FROM c GROUP BY ALL""")
def table_contracts(s, d):
    a = contract.annotate(table(s, d, "doc_tables"), table(s, d, "doc_cells"))
    return a.groupBy("domain", "role", F.coalesce("saved_domain", F.lit("none")).alias("saved_domain")).agg(F.count(F.lit(1)).alias("tables"))


@query("table_quality")
def table_quality(s, d):
    """(warning, tables, status): recomputed warnings of every table; `ok` for none."""
    a = contract.annotate(table(s, d, "doc_tables"), table(s, d, "doc_cells"))
    w = a.select("status", F.explode(F.when(F.size("warnings") > 0, F.col("warnings")).otherwise(F.array(F.lit("ok")))).alias("warning"))
    return w.groupBy("warning", "status").agg(F.count(F.lit(1)).alias("tables"))


@query("quality_status", f"""WITH t AS (SELECT doc_id, quality.status AS st FROM {_TABLES})
  SELECT doc_id, CASE max(CASE st WHEN 'fail' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'fail' WHEN 1 THEN 'warning' ELSE 'ok' END AS status, count(*) AS tables FROM t GROUP BY doc_id""")
def quality_status(s, d):
    return contract.distinct_tables(table(s, d, "doc_tables")).groupBy("doc_id").agg(contract.worst(F.col("quality.status")).alias("status"), F.count(F.lit(1)).alias("tables"))


@query("warning_histogram", f"SELECT w AS warning, count(*) AS tables FROM (SELECT {_KEY}, unnest(list_distinct(quality.warnings)) AS w FROM {_TABLES}) GROUP BY w")
def warning_histogram(s, d):
    t = contract.distinct_tables(table(s, d, "doc_tables")).select(F.explode(F.array_distinct("quality.warnings")).alias("warning"))
    return t.groupBy("warning").agg(F.count(F.lit(1)).alias("tables"))


@query("document_domain", f"SELECT doc_id, CASE WHEN count(DISTINCT domain) = 1 THEN min(domain) ELSE 'generic' END AS domain FROM {_TABLES} GROUP BY doc_id")
def document_domain(s, d):
    return table(s, d, "doc_tables").groupBy("doc_id").agg(F.when(F.count_distinct("domain") == 1, F.min("domain")).otherwise("generic").alias("domain"))


@query("row_styles", f"""WITH c AS (SELECT {_KEY}, row_ord, {_strip("coalesce(arg_min(coalesce(value, ''), col_ord), '')")} AS first,
    count(*) FILTER (WHERE contains(header, '금액') OR contains(header, '금 액')) AS money, count(*) FILTER (WHERE (contains(header, '금액') OR contains(header, '금 액')) AND {_strip("coalesce(value, '')")} <> '') AS paid
    FROM {_CELLS} SEMI JOIN (SELECT {_KEY} FROM doc_tables WHERE domain = 'estimate') USING ({_KEY}) GROUP BY ALL)
  SELECT {_KEY}, row_ord, CASE WHEN money > 0 AND paid = 0 AND first <> '' AND NOT regexp_full_match(first, '-?[0-9,]+') THEN 'section' WHEN regexp_matches(first, '소\\s*계|합\\s*계|계\\s*$|간접비|직접비\\s*소계') THEN 'subtotal' ELSE 'body' END AS style FROM c""")
def row_styles(s, d):
    own = table(s, d, "doc_tables").filter("domain = 'estimate'").select(*bom.TABLE).distinct()
    c = F.struct("col_ord", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("value", F.lit("")).alias("value"))
    g = bom.distinct_cells(table(s, d, "doc_cells")).join(own, bom.TABLE, "left_semi").groupBy(*bom.TABLE, "row_ord").agg(F.array_sort(F.collect_list(c)).alias("c"))
    return g.select(*bom.TABLE, "row_ord", contract.row_style(F.transform("c", lambda x: x["value"]), F.transform("c", lambda x: x["header"])).alias("style"))


@query("repeat_blanking", f"""SELECT {_KEY}, row_ord, col_ord, CASE WHEN col_ord > 0 AND value = lag(value) OVER (PARTITION BY {_KEY}, col_ord ORDER BY row_ord, header, value) THEN '' ELSE value END AS shown FROM {_CELLS}""")
def repeat_blanking(s, d):
    w = Window.partitionBy(*bom.TABLE, "col_ord").orderBy("row_ord", "header", "value")
    return bom.distinct_cells(table(s, d, "doc_cells")).select(*bom.TABLE, "row_ord", "col_ord", F.when((F.col("col_ord") > 0) & (F.col("value") == F.lag("value").over(w)), "").otherwise(F.col("value")).alias("shown"))


@query("detail_projection")
def detail_projection(s, d):
    """Estimate rows on the fixed detail columns; the first column of a name counts, '' without."""
    own = table(s, d, "doc_tables").filter("domain = 'estimate' and role = 'detail_table'").select(*bom.TABLE).distinct()
    c = bom.distinct_cells(table(s, d, "doc_cells")).join(own, bom.TABLE, "left_semi").withColumn("k", canonical_detail_key(F.regexp_replace("header", r"(재료비|노무비|경비|합계)\s+(단가|금액)", "$1_$2")))
    pick = [F.coalesce(F.min_by(F.when(F.col("k") == k, F.coalesce("value", F.lit(""))), F.when(F.col("k") == k, F.col("col_ord"))), F.lit("")).alias(k) for k in K.DETAIL_COLUMNS]
    return c.groupBy(*bom.TABLE, "row_ord").agg(*pick)


@query("table_notes", f"SELECT {_KEY}, CAST(pos AS INTEGER) AS note_no, note FROM (SELECT {_KEY}, unnest(notes) AS note, unnest(range(1, len(notes) + 1)) AS pos FROM {_TABLES})")
def table_notes(s, d):
    return contract.distinct_tables(table(s, d, "doc_tables")).select(*bom.TABLE, F.posexplode("notes").alias("i", "note")).select(*bom.TABLE, (F.col("i") + 1).alias("note_no"), "note")


@query("note_antijoin", f"""WITH n AS (SELECT doc_id, section_ord, table_ord, unnest(notes) AS note FROM {_TABLES}), v AS (SELECT doc_id, section_ord, regexp_replace(value, '{_S}+', '', 'g') AS v FROM {_CELLS} WHERE length(value) >= 6)
  SELECT DISTINCT doc_id, section_ord, note FROM n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = n.doc_id AND v.section_ord = n.section_ord AND v.v <> '' AND
    (contains(regexp_replace(n.note, '{_S}+', '', 'g'), v.v) OR contains(v.v, regexp_replace(n.note, '{_S}+', '', 'g'))))""")
def note_antijoin(s, d):
    """Notes that neither hold nor are held by a longer cell of their own section."""
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    n = table(s, d, "doc_tables").select("doc_id", "section_ord", F.explode("notes").alias("note")).distinct().withColumn("k", squeeze("note"))
    v = bom.distinct_cells(table(s, d, "doc_cells")).filter(F.length("value") >= 6).select("doc_id", "section_ord", squeeze("value").alias("v")).filter("v <> ''").distinct()
    on = (n["doc_id"] == v["doc_id"]) & (n["section_ord"] == v["section_ord"]) & (F.col("k").contains(F.col("v")) | F.col("v").contains(F.col("k")))
    return n.join(v, on, "left_anti").select("doc_id", "section_ord", "note")
