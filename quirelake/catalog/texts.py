"""String, number and hash functions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions import keywords as K
from quirelake.functions import numbers as N
from quirelake.functions import tables as T
from quirelake.functions import text as X
from quirelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: RE2 class of what (?U)\s means.
_S = r"[\t\n\x0b\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_S}+', ' ', 'g'))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_S}+|{_S}+$', '', 'g')"


_CELLS = "(SELECT DISTINCT doc_id, section_ord, table_ord, row_ord, col_ord, header, value FROM doc_cells)"


def _cells(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "doc_cells").distinct()


@query("clean_documents", f"""SELECT doc_id, md5({_collapse(r"regexp_replace(text, '(?is)<!--\s*(?:PAGE|SECTION|CONTEXT).*?-->', '', 'g')")}) AS clean_md5,
  CAST(length({_collapse('text')}) AS BIGINT) AS collapsed_chars FROM documents""")
def clean_documents(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(X.collapse(X.strip_markers(F.col("text")))).alias("clean_md5"), F.length(X.collapse(F.col("text"))).cast("long").alias("collapsed_chars"))


@query("cell_text", f"""SELECT doc_id, section_ord, table_ord, row_ord, col_ord,
  {_collapse("value")} || '^2 A&B_i' AS cell FROM {_CELLS} WHERE value IS NOT NULL AND trim(regexp_replace(value, '{_S}+', '', 'g')) <> ''""")
def cell_text(s, d):
    """Every cell set into markup, its own marks escaped, and read back."""
    c = _cells(s, d).filter(X.collapse(F.col("value")) != "")
    html = F.concat(F.lit("<td><b>"), T.escape_html(F.col("value")), F.lit("</b><sup>2</sup> A&amp;B<sub>i</sub><br></td>"))
    out = F.regexp_replace(X.cell_text(html), r" \^2 ", "^2 ")
    return c.select("doc_id", "section_ord", "table_ord", "row_ord", "col_ord", out.alias("cell"))


@query("display_width", f"""SELECT doc_id, section_ord, table_ord, col_ord, max(length(coalesce(value, '')) + length(regexp_replace(coalesce(value, ''), '[\\x00-\\x7F]', '', 'g'))) AS width
  FROM {_CELLS} GROUP BY ALL""")
def display_width(s, d):
    return _cells(s, d).groupBy("doc_id", "section_ord", "table_ord", "col_ord").agg(F.max(X.display_width(F.coalesce("value", F.lit("")))).cast("long").alias("width"))


@query("header_keys", f"""SELECT h AS header, count(*) AS n,
  regexp_replace(upper(h), '(?:{_S}|[._|/-])+', '', 'g') AS compare_key,
  regexp_replace(regexp_replace(upper(h), '_\\d+$', ''), '(?:{_S}|[._|/''-])+', '', 'g') AS semantic_key
  FROM (SELECT unnest(headers) AS h FROM (SELECT DISTINCT doc_id, section_ord, table_ord, headers FROM doc_tables)) WHERE h IS NOT NULL GROUP BY h""")
def header_keys(s, d):
    h = table(s, d, "doc_tables").select("doc_id", "section_ord", "table_ord", "headers").distinct().select(F.explode("headers").alias("header")).filter("header is not null")
    return h.groupBy("header").agg(F.count(F.lit(1)).alias("n")).withColumns({"compare_key": X.header_compare_key(F.col("header")), "semantic_key": X.semantic_header_key(F.col("header"))})


@query("ocr_corrections", "SELECT doc_id, section_ord, md5(" + "".join("replace(" for _ in K.OCR_CORRECTIONS) + "clean_text" + "".join(f", '{a}', '{b}')" for a, b in K.OCR_CORRECTIONS) + ") AS corrected_md5 FROM (SELECT DISTINCT doc_id, section_ord, clean_text FROM doc_sections) WHERE clean_text IS NOT NULL")
def ocr_corrections(s, d):
    t = table(s, d, "doc_sections").select("doc_id", "section_ord", "clean_text").distinct().filter("clean_text is not null")
    return t.select("doc_id", "section_ord", F.md5(X.correct_ocr(F.col("clean_text"))).alias("corrected_md5"))


@query("sentence_endings", f"""SELECT doc_id, page_num, count(*) AS lines, count_if(regexp_matches(regexp_replace(l, '{_S}+$', ''), '([.:)\\]]|다"|것)$')) AS endings
  FROM (SELECT doc_id, page_num, unnest(string_split(text, chr(10))) AS l FROM (SELECT DISTINCT doc_id, page_num, text FROM ocr_pages)) GROUP BY doc_id, page_num""")
def sentence_endings(s, d):
    lines = table(s, d, "ocr_pages").select("doc_id", "page_num", "text").distinct().select("doc_id", "page_num", F.explode(F.split("text", "\n")).alias("l"))
    return lines.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("lines"), F.count_if(X.ends_sentence(F.col("l"))).alias("endings"))


@query("merge_spaced", """SELECT doc_id, section_ord, md5(array_to_string(list_transform(string_split(t, chr(10)), lambda l:
    CASE WHEN len(k(l)) >= 2 AND len(list_filter(k(l), lambda w: regexp_full_match(w, '[가-힣]'))) >= len(k(l)) * 0.7 THEN array_to_string(k(l), '') ELSE l END), chr(10))) AS merged_md5
  FROM (SELECT DISTINCT doc_id, section_ord, coalesce(toc_title, '') || chr(10) || coalesce(regexp_replace(title, '(.)', '\\1 ', 'g'), '') AS t FROM doc_sections)""".replace("k(l)", "list_filter(string_split_regex(trim(l), '[ \\t]+'), lambda w: w <> '')"))
def merge_spaced(s, d):
    t = table(s, d, "doc_sections").select("doc_id", "section_ord", F.concat(F.coalesce("toc_title", F.lit("")), F.lit("\n"), F.coalesce(F.regexp_replace("title", "(.)", "$1 "), F.lit(""))).alias("t")).distinct()
    return t.select("doc_id", "section_ord", F.md5(X.merge_spaced_hangul(F.col("t"))).alias("merged_md5"))


@query("chapter_numbers", """SELECT doc_id, section_ord, chapter, CAST(coalesce(try_cast(regexp_extract(chapter, '제\\s*(\\d+)\\s*장', 1) AS INTEGER), 0) AS INTEGER) AS chapter_no
  FROM (SELECT DISTINCT doc_id, section_ord, chapter FROM doc_sections)""")
def chapter_numbers(s, d):
    return table(s, d, "doc_sections").select("doc_id", "section_ord", "chapter").distinct().withColumn("chapter_no", X.chapter_number(F.col("chapter")))


@query("artifact_ids", """SELECT source_file, count(*) AS n, translate(rtrim(base64(encode(source_file)), '='), '+/', '-_') AS artifact_id, source_file AS back,
  regexp_replace(regexp_extract(source_file, '([^/\\\\]*)$', 1), '[^0-9A-Za-z가-힣._ -]', '_', 'g') AS safe_name
  FROM doc_sections WHERE source_file IS NOT NULL AND source_file <> '' GROUP BY source_file""")
def artifact_ids(s, d):
    f = table(s, d, "doc_sections").filter("source_file <> ''").groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    f = f.withColumn("artifact_id", X.encode_id(F.col("source_file")))
    return f.select("source_file", "n", "artifact_id", X.decode_id(F.col("artifact_id")).alias("back"), X.file_name(F.col("source_file")).alias("safe_name"))


@query("mask_secrets", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '((?:api_key|API_KEY)["'']?\s*[:=]\s*["'']?)[^"''\s]{8,}', '\1***MASKED***', 'g'), '(Reference id |식별 번호 )[0-9a-f]{6,}', '\1***MASKED***', 'g')) AS masked_md5 FROM documents""")
def mask_secrets(s, d):
    patterns = (*K.SECRETS, (r"(Reference id |식별 번호 )[0-9a-f]{6,}", "$1***MASKED***"))
    return table(s, d, "documents").select("doc_id", F.md5(X.mask_secrets(F.col("text"), patterns)).alias("masked_md5"))


@query("strict_numbers", f"""SELECT doc_id, section_ord, table_ord, row_ord, col_ord, x AS number FROM (
  SELECT *, CASE WHEN regexp_full_match(t, '-?[0-9,]+\\.?[0-9]*') AND NOT regexp_matches(p, '^-?0[0-9]') THEN try_cast(p AS DOUBLE) END AS x
  FROM (SELECT *, {_strip('value')} AS t, replace({_strip('value')}, ',', '') AS p FROM {_CELLS} WHERE value IS NOT NULL)) WHERE x IS NOT NULL""")
def strict_numbers(s, d):
    c = _cells(s, d).withColumn("number", N.strict_number(F.col("value"))).filter("number is not null")
    return c.select("doc_id", "section_ord", "table_ord", "row_ord", "col_ord", "number")


@query("lenient_numbers", f"""SELECT header, count(*) AS n, round(sum(CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(t AS DOUBLE)
    WHEN regexp_full_match(regexp_extract(t, '^([0-9.-]+)', 1), '-?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN CAST(regexp_extract(t, '^([0-9.-]+)', 1) AS DOUBLE) ELSE 0 END), 2) AS total
  FROM (SELECT header, replace({_strip("coalesce(value, '')")}, ',', '') AS t FROM {_CELLS}) GROUP BY header""")
def lenient_numbers(s, d):
    return _cells(s, d).groupBy("header").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(N.lenient_number(F.col("value"))), 2).alias("total"))


@query("content_hash", "SELECT doc_id, sha256(text || 'zai' || '3') AS cache_key, sha256(text || 'local') AS data_key FROM documents WHERE text IS NOT NULL")
def content_hash(s, d):
    t = table(s, d, "documents").filter("text is not null")
    b = F.encode("text", "UTF-8")
    return t.select("doc_id", N.content_key(b, F.lit("zai"), F.lit(3)).alias("cache_key"), N.content_key(b, F.lit("local")).alias("data_key"))


@query("page_spec", "SELECT DISTINCT doc_id, page_num FROM ocr_pages WHERE page_num BETWEEN 2 AND 3 OR page_num >= 5")
def page_spec(s, d):
    pages = [p + 1 for p in X.page_spec("2-3,5-", 10_000)]
    lo, hi = [p for p in pages if p <= 3], min(p for p in pages if p > 3)
    return table(s, d, "ocr_pages").filter(F.col("page_num").isin(lo) | (F.col("page_num") >= hi)).select("doc_id", "page_num").distinct()


@query("token_costs", "SELECT DISTINCT doc_id, page_num, round(coalesce(input_tokens, 0) / 1e6 * 0.1 + coalesce(output_tokens, 0) / 1e6 * 0.4, 9) AS cost FROM ocr_pages")
def token_costs(s, d):
    return table(s, d, "ocr_pages").select("doc_id", "page_num", F.round(N.token_cost(F.col("input_tokens"), F.col("output_tokens")), 9).alias("cost")).distinct()
