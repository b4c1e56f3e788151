"""Layout blocks, loose tables, title blocks and reflow over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.functions.reflow import reflow
from quirelake.functions.scanlines import tables_in_lines
from quirelake.operators import layout, metadata
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


_PAGES = "(SELECT DISTINCT doc_id, page_num, layout FROM ocr_pages)"


@query("layout_order", f"""WITH b AS (SELECT doc_id, page_num, json_extract(layout, '$') AS j FROM {_PAGES} WHERE layout IS NOT NULL), u AS (SELECT doc_id, page_num, unnest(CAST(j AS JSON[])) AS x, unnest(range(len(CAST(j AS JSON[])))) AS i FROM b),
  k AS (SELECT doc_id, page_num, i, x->>'$.type' AS label, CAST(x->'$.bbox[1]' AS DOUBLE) AS y, CAST(x->'$.bbox[0]' AS DOUBLE) AS x0 FROM u)
  SELECT doc_id, page_num, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY y, x0, i) - 1 AS INTEGER) AS block_no, label, y, x0 FROM k""")
def layout_order(s, d):
    """Blocks of every page in reading order."""
    p = table(s, d, "ocr_pages").select("doc_id", "page_num", "layout").distinct()
    b = p.select("doc_id", "page_num", F.posexplode(layout.blocks(F.col("layout"))).alias("block_no", "b"))
    return b.select("doc_id", "page_num", "block_no", "b.label", "b.y", F.col("b.x").alias("x0"))


@query("text_bands", f"""WITH b AS (SELECT doc_id, page_num, unnest(CAST(layout AS JSON[])) AS x, unnest(range(len(CAST(layout AS JSON[])))) AS i FROM {_PAGES} WHERE layout IS NOT NULL),
  k AS (SELECT doc_id, page_num, i, CAST(x->'$.bbox[1]' AS DOUBLE) AS y0, CAST(x->'$.bbox[3]' AS DOUBLE) AS y1 FROM b),
  g AS (SELECT doc_id, page_num, coalesce(max(y1) OVER (PARTITION BY doc_id, page_num ORDER BY y0, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top, y0 AS bottom FROM k UNION ALL SELECT doc_id, page_num, max(y1), 842.0 FROM k GROUP BY ALL)
  SELECT doc_id, page_num, CAST(top AS DOUBLE) AS top, CAST(bottom AS DOUBLE) AS bottom FROM g WHERE bottom - top >= 5""")
def text_bands(s, d):
    p = table(s, d, "ocr_pages").select("doc_id", "page_num", "layout").distinct()
    b = p.select("doc_id", "page_num", F.posexplode(layout.blocks(F.col("layout"))).alias("n", "b"))
    boxes = b.select("doc_id", "page_num", F.col("b.i").alias("ord"), *[F.col("b.bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    return layout.text_bands(boxes, ["doc_id", "page_num"], 842.0)


@query("box_dedup")
def box_dedup(s, d):
    """Boxes of every page without near repeats."""
    p = table(s, d, "ocr_pages").select("doc_id", "page_num", "layout").distinct()
    b = p.select("doc_id", "page_num", F.posexplode(layout.blocks(F.col("layout"))).alias("n", "b"))
    boxes = b.select("doc_id", "page_num", F.col("b.i").alias("ord"), *[F.col("b.bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    return layout.dedupe_boxes(boxes, ["doc_id", "page_num"])


@query("loose_tables", "SELECT l_orderkey AS doc, count(*) AS rows, round(sum(l_quantity), 2) AS qty, round(sum(round(l_extendedprice, 2)), 2) AS weight FROM lineitem GROUP BY l_orderkey")
def loose_tables(s, d):
    """Orders printed as loose material lists, read back by the line reader and summed."""
    line = F.format_string("| %d | %dA | %.2f | %.2f |", F.col("l_linenumber"), F.pmod("l_partkey", F.lit(500)), F.col("l_quantity"), F.col("l_extendedprice"))
    docs = table(s, d, "lineitem").select("l_orderkey", line.alias("line")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    text = F.concat(F.lit("GENERAL NOTES\nBILL OF MATERIALS\n| S/N | SIZE | Q'TY | WT(KG) |\n|---|---|---|---|\n"), "body", F.lit("\n\n\nSCALE 1:50\n"))
    t = docs.select("l_orderkey", F.explode(tables_in_lines(text)).alias("t")).select("l_orderkey", F.explode("t.rows").alias("r"))
    num = lambda k: F.element_at("r", k).try_cast("double")
    return t.groupBy(F.col("l_orderkey").alias("doc")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum(num(3)), 2).alias("qty"), F.round(F.sum(num(4)), 2).alias("weight"))


@query("title_blocks", """SELECT s_suppkey, field, value FROM (SELECT s_suppkey, unnest(['dwg_no', 'title', 'rev', 'scale', 'client']) AS field, unnest(['D-' || s_suppkey, s_name, CAST(s_nationkey AS VARCHAR), '1:' || (s_suppkey % 50 + 1), n_name]) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def title_blocks(s, d):
    """Suppliers printed as title blocks and read back."""
    t = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = F.concat(F.lit("DWG NO. D-"), "s_suppkey", F.lit(" | REV. "), "s_nationkey", F.lit("\n---\nTITLE: "), "s_name", F.lit("\nSCALE 1:"), F.pmod("s_suppkey", F.lit(50)) + 1, F.lit("\nOWNER: "), "n_name", F.lit("\nTITLE: second"))
    return metadata.unpivoted_title_block(t.select("s_suppkey", text.alias("text")), "s_suppkey", "text")


@query("reflowed_pages")
def reflowed_pages(s, d):
    """(doc_id, page_num, lines, paragraphs, text) of every page reflowed."""
    p = table(s, d, "ocr_pages").select("doc_id", "page_num", "text").distinct().withColumn("flow", reflow(F.col("text")))
    count = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""))
    return p.select("doc_id", "page_num", count("text").alias("lines"), count("flow").alias("paragraphs"), F.col("flow").alias("text"))


@query("section_metadata")
def section_metadata(s, d):
    """Notes, conditions, references, year and unit of every section's text, counted."""
    t = table(s, d, "doc_sections").select("doc_id", "section_ord", "clean_text").distinct().select("doc_id", "section_ord", metadata.section_text(F.coalesce("clean_text", F.lit(""))).alias("m"))
    return t.select("doc_id", "section_ord", F.size("m.notes").alias("notes"), F.size("m.conditions").alias("conditions"), F.size("m.references").alias("references"), F.length("m.clean_text").alias("chars"))
