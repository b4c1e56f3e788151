"""Reading Markdown, OCR results and pages of documents as DataFrames."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quirelake.functions.text import strip
from quirelake.operators.positions import SECTION, matches_with_offset

PAGES = "array<struct<page_num: int, page: int, index: int, text: string, markdown: string, content: string, layout_details: string, input_tokens: bigint, output_tokens: bigint>>"


def read_texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(doc_id, source_file, text) of the text files of a folder, not of its subfolders.

    A byte-order mark and carriage returns are taken off.
    """
    t = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select("value", F.input_file_name().alias("p"))
    name = F.regexp_extract("p", r"([^/]*)$", 1)
    return t.select(F.regexp_replace(name, r"\.[^.]*$", "").alias("doc_id"), name.alias("source_file"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n").alias("text"))


def list_files(spark: SparkSession, path: str, glob: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """(path, length, modified) of the files of a folder in path order; contents are not read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return f.select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def sections_of_markdown(docs: DataFrame, title_pattern: str = r"(?m)^제\d+장\s+.+$") -> DataFrame:
    """(doc_id, section_ord, section_id, title, department, chapter, raw_text) of Markdown documents.

    Cut at SECTION markers; without one at title lines; without these the whole
    text is one section `doc`. Sections of at most 10 visible characters are left out.
    """
    mark = matches_with_offset(F.col("text"), r"<!-- SECTION: \S+ \| .+? \| 부문:.+? \| 장:.+? -->")
    line = matches_with_offset(F.col("text"), title_pattern)
    d = docs.filter("text is not null").select("doc_id", "text", mark.alias("m"), line.alias("l"))
    cuts = F.when(F.size("m") > 0, F.col("m")).otherwise(F.col("l"))
    start = F.when(F.size(cuts) > 0, F.concat(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("match"))), cuts)).otherwise(F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("match"))))
    d = d.select("doc_id", "text", start.alias("s"), (F.size("m") > 0).alias("marked"))
    p = d.select("doc_id", "text", "s", "marked", F.posexplode("s").alias("i", "c"))
    end = F.coalesce(F.try_element_at("s", F.col("i") + 2)["pos"], F.length("text"))
    raw = F.substring("text", F.col("c.pos") + F.length("c.match") + 1, end - F.col("c.pos") - F.length("c.match"))
    g = lambda k: F.trim(F.regexp_extract("c.match", SECTION, k))
    title = F.when(F.col("marked"), g(2)).otherwise(strip(F.col("c.match")))
    out = p.select("doc_id", F.col("i").alias("section_ord"), F.when(F.col("marked") & (g(1) != ""), g(1)).when(F.size("s") == 1, "doc").otherwise(F.concat(F.lit("S"), F.col("i").cast("string"))).alias("section_id"), title.alias("title"), g(3).alias("department"), g(4).alias("chapter"), raw.alias("raw_text"))
    return out.filter(F.length(F.regexp_replace("raw_text", r"(?U)\s|<!--[\s\S]*?-->", "")) > 10)


def response_pages(body: Column) -> Column:
    """array<struct(page_num, text, layout, input_tokens, output_tokens)> of an OCR service's JSON.

    Accepted: an array of pages, an object with `pages`, or one with md_results,
    content or text for a single page. Image links are taken out of the text.
    """
    array = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, PAGES))
    pages = F.coalesce(array(body), array(F.get_json_object(body, "$.pages")))
    clean = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"!\[[^\]]*\]\([^)]*\)", "")
    many = F.transform(pages, lambda p, i: F.struct(F.coalesce(p["page_num"], p["page"], p["index"] + 1, i + 1).alias("page_num"), clean(F.coalesce(p["markdown"], p["text"], p["content"])).alias("text"), p["layout_details"].alias("layout"), F.coalesce(p["input_tokens"], F.lit(0)).alias("input_tokens"), F.coalesce(p["output_tokens"], F.lit(0)).alias("output_tokens")))
    one = F.array(F.struct(F.lit(1).alias("page_num"), clean(F.coalesce(F.get_json_object(body, "$.md_results"), F.get_json_object(body, "$.content"), F.get_json_object(body, "$.text"))).alias("text"), F.get_json_object(body, "$.layout_details").alias("layout"), F.coalesce(F.get_json_object(body, "$.usage.prompt_tokens").try_cast("long"), F.lit(0)).alias("input_tokens"), F.coalesce(F.get_json_object(body, "$.usage.completion_tokens").try_cast("long"), F.lit(0)).alias("output_tokens")))
    return F.when(F.size(pages) > 0, many).otherwise(one)


def read_ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_num, text, layout, input_tokens, output_tokens) of a folder of OCR JSON files."""
    return read_texts(spark, path, "*.json").select("doc_id", F.explode(response_pages(F.col("text"))).alias("p")).select("doc_id", "p.*")


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class PageReader(DataSourceReader):
    """One partition a range of pages; pages come from the engine named by `module:function`."""

    def __init__(self, options: dict) -> None:
        self.path, self.engine = options["path"], options["engine"]
        self.size = int(options.get("pagesPerTask", "16"))

    def _engine(self) -> Callable:
        module, name = self.engine.split(":")
        return getattr(importlib.import_module(module), name)

    def partitions(self) -> list[_Range]:
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path)) if os.path.isdir(self.path) else [self.path]
        count = getattr(self._engine(), "page_count", lambda _: 1)
        return [_Range(f, a, min(a + self.size, n)) for f in files for n in [count(f)] for a in range(0, n, self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        doc = os.path.splitext(os.path.basename(partition.path))[0]
        for page, text in self._engine()(partition.path, range(partition.first, partition.last)):
            yield doc, page + 1, text


class PageSource(DataSource):
    """spark.read.format("pages").option("engine", "module:function").load(path).

    An engine is a function (path, page indices) -> iterator of (index, text) with
    an attribute page_count(path) -> int; PDF and image engines plug in here.
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "doc_id string, page_num int, text string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def text_engine(path: str, pages) -> Iterator[tuple[int, str]]:
    """Engine for text files whose pages are parted by form feeds."""
    with open(path, encoding="utf-8-sig") as f:
        parts = f.read().split("\f")
    for i in pages:
        yield i, parts[i]


def _text_pages(path: str) -> int:
    with open(path, encoding="utf-8-sig") as f:
        return f.read().count("\f") + 1


text_engine.page_count = _text_pages


def cached_pages(pages: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached value, misses) of pages against a cache by `key`."""
    return pages.join(cache.select(key, "value"), key), pages.join(cache.select(key), key, "left_anti")


TOC_ENTRY = "map<string, struct<id: string, chapter: string, section: string, title: string, page: int>>"


def read_toc(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, toc_key, id, chapter, section, title, page) of tables of contents in JSON files.

    A file is {"section_map": {...}} or the map by itself; one that reads as neither gives no row.
    """
    t = read_texts(spark, path, "*.json")
    own = F.from_json(F.coalesce(F.get_json_object("text", "$.section_map"), F.col("text")), TOC_ENTRY)
    return t.select("source_file", F.explode(own).alias("toc_key", "e")).filter("e is not null").select("source_file", "toc_key", F.coalesce("e.id", "toc_key").alias("id"), "e.chapter", "e.section", "e.title", "e.page")
