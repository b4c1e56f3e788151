"""Markers, as-of lookups, sections, detection and extraction quality over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import keywords as K
from quirelake.functions.times import epoch_micros
from quirelake.operators import detect, positions, toc
from quirelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_S = r"[\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SECTIONS = "(SELECT * FROM doc_sections QUALIFY row_number() OVER (PARTITION BY doc_id, section_ord ORDER BY coalesce(section_id, ''), coalesce(title, '')) = 1)"
_PAGES = "(SELECT DISTINCT doc_id, page_num FROM ocr_pages)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _sections(s, d) -> DataFrame:
    return table(s, d, "doc_sections").dropDuplicates(["doc_id", "section_ord"])


def _pages(s, d) -> DataFrame:
    return table(s, d, "ocr_pages").select("doc_id", "page_num").distinct()


_MARK = r"<!--\s*(?:PAGE|SECTION|CONTEXT)\b[^>]*?-->"
_MARKERS = f"""m AS (SELECT doc_id, regexp_extract_all(text, '{_MARK}') AS ms, string_split_regex(text, '{_MARK}') AS ps FROM documents WHERE text IS NOT NULL),
  k AS (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m),
  mk AS (SELECT doc_id, i - 1 AS ord, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS pos, ms[i] AS mark FROM k)"""


@query("text_markers", f"""WITH {_MARKERS} SELECT doc_id, CAST(ord AS INTEGER) AS ord, pos, CAST(pos + length(mark) AS INTEGER) AS "end", regexp_extract(mark, '<!--\\s*(PAGE|SECTION|CONTEXT)', 1) AS kind, try_cast(regexp_extract(mark, '^<!--\\s*PAGE\\s+([0-9]+)', 1) AS INTEGER) AS page FROM mk""")
def text_markers(s, d):
    return positions.markers(table(s, d, "documents"))


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL), ls AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no) - length(line) - 1 AS INTEGER) AS pos FROM l)"


@query("page_asof", f"""WITH {_MARKERS}, {_LINES}, p AS (SELECT doc_id, pos, CAST(regexp_extract(mark, 'PAGE\\s+([0-9]+)', 1) AS INTEGER) AS page FROM mk),
  f AS (SELECT doc_id, arg_min(page, pos) AS page FROM p GROUP BY doc_id), a AS (SELECT ls.doc_id, ls.line_no, ls.pos, p.page FROM ls ASOF LEFT JOIN p ON ls.doc_id = p.doc_id AND ls.pos >= p.pos)
  SELECT a.doc_id, line_no, pos, coalesce(a.page, f.page) AS page FROM a JOIN f ON f.doc_id = a.doc_id""")
def page_asof(s, d):
    """The page of every line of documents that have page markers."""
    docs = table(s, d, "documents").select("doc_id", "text")
    m = positions.markers(docs).filter("kind = 'PAGE'").select("doc_id", "pos", "page")
    lines = positions.line_starts(docs).select("doc_id", "line_no", "pos").join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    return positions.as_of(lines, m, ["doc_id"], "pos", "page", default_first=True)


@query("active_section", f"""SELECT p.doc_id, p.page_num AS page, arg_max(s.section_id, (s.page, s.section_id)) AS section_id FROM {_PAGES} p LEFT JOIN {_SECTIONS} s ON s.doc_id = p.doc_id AND s.page > 0 AND s.page <= p.page_num GROUP BY ALL""")
def active_section(s, d):
    pages = _pages(s, d).withColumnRenamed("page_num", "page")
    entries = _sections(s, d).select("doc_id", "page", F.col("section_id").alias("id"))
    return toc.active_section(pages, entries, ["doc_id"])


@query("sections_by_page", f"SELECT doc_id, page, list(section_id ORDER BY section_ord) AS ids FROM {_SECTIONS} WHERE page > 0 GROUP BY doc_id, page")
def sections_by_page(s, d):
    return toc.sections_by_page(_sections(s, d).select("doc_id", "page", F.col("section_ord").alias("ord"), F.col("section_id").alias("id")), ["doc_id"])


@query("carried_chapter", f"SELECT doc_id, section_ord, last_value(CASE WHEN regexp_replace(chapter, '^{_S}+|{_S}+$', '', 'g') <> '' THEN chapter END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section_ord) AS active_chapter FROM {_SECTIONS}")
def carried_chapter(s, d):
    return positions.carried(_sections(s, d).select("doc_id", "section_ord", "chapter"), ["doc_id"], ["section_ord"], "chapter", "active_chapter").select("doc_id", "section_ord", "active_chapter")


@query("toc_lookup", f"""WITH s AS (SELECT doc_id, section_ord, section_id, coalesce(department, '') AS department, title, page FROM {_SECTIONS}),
  t AS (SELECT doc_id, section_id AS id, department AS chapter, title, section_ord AS ord FROM s WHERE title IS NOT NULL AND title <> ''),
  f AS (SELECT doc_id, id, arg_min(title, ord) AS t1 FROM t GROUP BY ALL), p AS (SELECT doc_id, id, chapter, arg_max(title, ord) AS t2 FROM t GROUP BY ALL)
  SELECT s.doc_id, s.section_ord, coalesce(p.t2, f.t1, '') AS found_title FROM s LEFT JOIN f ON f.doc_id = s.doc_id AND f.id = s.section_id LEFT JOIN p ON p.doc_id = s.doc_id AND p.id = s.section_id AND p.chapter = s.department""")
def toc_lookup(s, d):
    x = _sections(s, d).select("doc_id", "section_ord", "section_id", F.coalesce("department", F.lit("")).alias("department"), "title")
    t = x.filter("title <> ''").select("doc_id", F.col("section_id").alias("id"), F.col("department").alias("chapter"), "title", F.col("section_ord").alias("ord"))
    return toc.look_up(x, t, ["doc_id"]).select("doc_id", "section_ord", "found_title")


@query("section_info", f"""SELECT doc_id, section_ord, concat_ws(' > ', nullif(trim(coalesce(chapter, '')), ''), nullif(trim(coalesce(department, '')), ''), concat_ws(' ', section_id, nullif(trim(coalesce(title, '')), ''))) AS info,
  '<!-- SECTION: ' || section_id || ' | ' || coalesce(title, '') || ' | 부문:' || coalesce(department, '') || ' | 장:' || coalesce(chapter, '') || ' -->' AS marker FROM {_SECTIONS}""")
def section_info(s, d):
    x = _sections(s, d)
    info = toc.section_info(F.col("section_id"), F.col("chapter"), F.col("department"), F.col("title"))
    return x.select("doc_id", "section_ord", info.alias("info"), positions.section_marker(F.col("section_id"), F.col("title"), F.col("department"), F.col("chapter")).alias("marker"))


@query("line_segments", f"""WITH {_LINES}, g AS (SELECT *, regexp_matches(line, '^(<!--|Page |수신|Dear |Contact)') AS t, sum(CAST(regexp_matches(line, '^(<!--|Page |수신|Dear |Contact)') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS seg_no FROM ls)
  SELECT doc_id, CAST(seg_no AS BIGINT) AS seg_no, max(CASE WHEN t THEN line END) AS title, min(line_no) AS "first", max(line_no) AS "last", count(*) AS n FROM g GROUP BY doc_id, seg_no""")
def line_segments(s, d):
    lines = positions.line_starts(table(s, d, "documents").select("doc_id", "text"))
    return positions.segments(lines, F.col("line").rlike("^(<!--|Page |수신|Dear |Contact)"), ["doc_id"], "line_no")


@query("gap_groups", """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), f AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 3600000000 OR lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) IS NULL THEN 1 ELSE 0 END AS f FROM e)
  SELECT user_id, grp, count(*) AS n, min(us) AS start_us, max(us) AS end_us FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id) AS grp FROM f) GROUP BY ALL""")
def gap_groups(s, d):
    """Runs of a user's events that are at most an hour apart."""
    e = table(s, d, "events").select("user_id", "event_id", epoch_micros(F.col("ts")).alias("us"))
    g = positions.gap_groups(e, ["user_id"], "us", F.lit(3_600_000_000), ["event_id"])
    return g.groupBy("user_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("end_us"))


def _hits(words, x: str) -> str:
    return "(" + " + ".join("CAST(contains({0}, '{1}') AS INTEGER)".format(x, w.replace("'", "''")) for w in words) + ")"


def _all(words, x: str) -> str:
    return "(" + " AND ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _detect(src: str, key: str) -> str:
    q = f"({_hits(K.MATERIAL_QUOTE, 'sq')} >= 5 OR {_all(K.MATERIAL_QUOTE_HEADER[0], 'sq')} OR {_all(K.MATERIAL_QUOTE_HEADER[1], 'sq')})"
    return f"""a AS (SELECT {key}, t, upper(t) AS u, replace(replace(t, ' ', ''), chr(10), '') AS sq FROM {src}),
    b AS (SELECT {key}, CASE WHEN {q} THEN greatest({_hits(K.ESTIMATE, 't')}, 6) ELSE {_hits(K.ESTIMATE, 't')} END AS e, {_hits(K.PUMSEM, 't')} AS p, {_hits(K.BOM, 'u')} AS bm, {_hits(K.BOM_STRUCTURE, 'u')} AS st, {q} AS quote FROM a),
    c AS (SELECT *, CASE WHEN e >= p AND e >= bm THEN 'estimate' WHEN p >= bm THEN 'pumsem' ELSE 'bom' END AS best, greatest(e, p, bm) AS top FROM b),
    x AS (SELECT *, top - CASE best WHEN 'estimate' THEN greatest(p, bm) WHEN 'pumsem' THEN greatest(e, bm) ELSE greatest(e, p) END AS lead FROM c),
    y AS (SELECT *, CASE WHEN top <= 0 THEN 'low' WHEN best = 'bom' THEN (CASE WHEN top >= 5 AND st >= 2 AND lead >= 2 THEN 'high' WHEN top >= 3 AND lead >= 0 THEN 'medium' ELSE 'low' END)
      ELSE (CASE WHEN top >= 6 AND lead >= 2 THEN 'high' WHEN top >= 4 AND lead >= 2 THEN 'medium' ELSE 'low' END) END AS confidence FROM x)"""


_DETECT_OUT = "CASE WHEN confidence <> 'low' THEN best END AS label, confidence, CAST(e AS INTEGER) AS estimate, CAST(p AS INTEGER) AS pumsem, CAST(bm AS INTEGER) AS bom, confidence <> 'low' AND quote AS material_quote"


@query("keyword_detect", f"WITH {_detect('(SELECT doc_id, coalesce(text, chr(32)) AS t FROM documents)', 'doc_id')} SELECT doc_id, {_DETECT_OUT} FROM y")
def keyword_detect(s, d):
    return table(s, d, "documents").select("doc_id", detect.detection(F.col("text")).alias("d")).select("doc_id", "d.*")


@query("table_detect", f"WITH {_detect('(SELECT doc_id, section_ord, table_ord, array_to_string(headers, chr(32)) AS t FROM (SELECT DISTINCT doc_id, section_ord, table_ord, headers FROM doc_tables))', 'doc_id, section_ord, table_ord')} SELECT doc_id, section_ord, table_ord, {_DETECT_OUT}, CASE WHEN confidence = 'high' THEN best ELSE 'generic' END AS route FROM y")
def table_detect(s, d):
    t = table(s, d, "doc_tables").select("doc_id", "section_ord", "table_ord", "headers").distinct()
    t = t.withColumn("d", detect.detection(F.array_join("headers", " ")))
    return t.select("doc_id", "section_ord", "table_ord", "d.*", detect.route(F.col("d"), F.lit(False)).alias("route"))


@query("extraction_metrics", f"""WITH t AS (SELECT doc_id, page_num, coalesce(text, '') AS t FROM (SELECT DISTINCT doc_id, page_num, text FROM ocr_pages)),
  v AS (SELECT doc_id, page_num, length(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<!--\\s*(?:PAGE|SECTION|CONTEXT).*?-->', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '<[^>]+>', ' ', 'g'), '|', ' '), '{_S}+', ' ', 'g'), '{_S}', '', 'g')) AS v FROM t)
  SELECT doc_id, CAST(sum(v) AS BIGINT) AS visible_chars, count(*) AS pages, count_if(v < 200) AS weak_pages FROM v GROUP BY doc_id""")
def extraction_metrics(s, d):
    p = table(s, d, "ocr_pages").select("doc_id", "page_num", "text").distinct().select("doc_id", detect.extraction_metrics(F.col("text"), F.lit(1)).alias("m"))
    return p.groupBy("doc_id").agg(F.sum("m.visible_chars").cast("long").alias("visible_chars"), F.count(F.lit(1)).alias("pages"), F.count_if(F.col("m.weak_reason").contains("visible_chars<200")).alias("weak_pages"))


@query("cascade_pick", """WITH c AS (SELECT doc_id, text, 0 AS ord, 'page' AS origin FROM (SELECT doc_id, max(text) AS text FROM ocr_pages WHERE page_num = 1 GROUP BY doc_id) UNION ALL SELECT doc_id, text, 1, 'section' FROM (SELECT doc_id, max(clean_text) AS text FROM doc_sections WHERE section_ord = 0 GROUP BY doc_id)),
  m AS (SELECT *, length(coalesce(text, '')) AS score, length(coalesce(text, '')) < 600 AS weak FROM c)
  SELECT doc_id, coalesce(arg_min(origin, ord) FILTER (WHERE NOT weak), arg_max(origin, (score, -ord))) AS origin FROM m GROUP BY doc_id""")
def cascade_pick(s, d):
    """Per document the first extraction that is not weak, else the best one."""
    a = table(s, d, "ocr_pages").filter("page_num = 1").groupBy("doc_id").agg(F.max("text").alias("text")).select("doc_id", "text", F.lit(0).alias("ord"), F.lit("page").alias("origin"))
    b = table(s, d, "doc_sections").filter("section_ord = 0").groupBy("doc_id").agg(F.max("clean_text").alias("text")).select("doc_id", "text", F.lit(1).alias("ord"), F.lit("section").alias("origin"))
    m = a.unionByName(b).withColumn("score", F.length(F.coalesce("text", F.lit("")))).withColumn("weak", F.col("score") < 600)
    first = F.min_by(F.when(~F.col("weak"), F.col("origin")), F.when(~F.col("weak"), F.col("ord")))
    return m.groupBy("doc_id").agg(F.coalesce(first, F.max_by("origin", F.struct("score", -F.col("ord")))).alias("origin"))
