"""Tables of contents as a relation, and lookups in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import chapter_number, repair_section_id
from quirelake.operators.positions import as_of, carried

ENTRY = r"^\s*(\d+-\d+(?:-\d+)?)\s+(.+?)(?:\s*[·.…‥]{2,}\s*|\s+)(\d+)\s*$"


def parse_toc(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, toc_key, id, chapter, title, page) of the entry lines of (by, line_no, line).

    Chapter lines carry forward; ids of chapters from 10 on get their lost digit
    back; a repeated id is `id#2`, `id#3`.
    """
    t = lines.withColumn("_c", F.when(F.col("line").rlike(r"^\s*제\s*\d+\s*장"), F.trim("line")))
    t = carried(t, by, ["line_no"], "_c", "chapter").filter(F.col("line").rlike(ENTRY))
    own = repair_section_id(F.regexp_extract("line", ENTRY, 1), chapter_number(F.coalesce("chapter", F.lit(""))))
    t = t.select(*by, F.col("line_no").alias("ord"), own.alias("id"), F.coalesce("chapter", F.lit("")).alias("chapter"), F.trim(F.regexp_extract("line", ENTRY, 2)).alias("title"), F.regexp_extract("line", ENTRY, 3).try_cast("int").alias("page"))
    n = F.row_number().over(Window.partitionBy(*by, "id").orderBy("ord"))
    return t.withColumn("toc_key", F.when(n > 1, F.concat("id", F.lit("#"), n.cast("string"))).otherwise(F.col("id")))


def sections_by_page(toc: DataFrame, by: list[str]) -> DataFrame:
    """(by, page, ids): ids of the sections that begin on a page above 0, in order."""
    return toc.filter("page > 0").groupBy(*by, "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))


def active_section(pages: DataFrame, toc: DataFrame, by: list[str]) -> DataFrame:
    """`pages` (by, page) with the id of the last section begun; ids compare as text."""
    last = toc.filter("page > 0").groupBy(*by, "page").agg(F.max("id").alias("section_id"))
    return as_of(pages, last, by, "page", "section_id")


def reverse_map(toc: DataFrame, by: list[str]) -> DataFrame:
    """(by, id, chapter, toc_key): the last entry of each id and chapter."""
    return toc.groupBy(*by, F.regexp_replace("id", "#.*$", "").alias("id"), "chapter").agg(F.max_by("toc_key", "ord").alias("toc_key"))


def look_up(sections: DataFrame, toc: DataFrame, by: list[str]) -> DataFrame:
    """`sections` (by, section_id, department, ...) with toc_title: the entry of id and
    department, else the first entry of the id, else ''."""
    first = toc.groupBy(*by, "id").agg(F.min_by("title", "ord").alias("_t1"))
    pair = toc.groupBy(*by, "id", "chapter").agg(F.max_by("title", "ord").alias("_t2"))
    s = sections.join(first.withColumnRenamed("id", "section_id"), [*by, "section_id"], "left")
    s = s.join(pair.withColumnRenamed("id", "section_id").withColumnRenamed("chapter", "department"), [*by, "section_id", "department"], "left")
    return s.withColumn("found_title", F.coalesce("_t2", "_t1", F.lit(""))).drop("_t1", "_t2")


def section_info(section_id, chapter, section, title):
    """`chapter > section > id title`, parts that are blank left out."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws(" > ", blank(chapter), blank(section), F.concat_ws(" ", section_id, blank(title)))
