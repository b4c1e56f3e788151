"""From HTML text to typed tables: material tables, parsed section tables, sections of an export.

A block is one <table> of a text. Blocks are filtered by key words before the
grid kernel reads them, rows of a table stay one array, and nothing is shuffled:
every text is worked on where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import grid as G
from quirelake.functions import keywords as K
from quirelake.functions import tables as T
from quirelake.functions.text import strip
from quirelake.operators.contract import bom_warnings, status_of, type_of_table


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`df` with a column of a Python kernel, which must not be moved into the lambdas that use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def blocks(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, block_no, html): every table of every text, from 1."""
    return texts.select(*keys, F.posexplode(T.html_tables(F.col(text))).alias("block_no", "html")).withColumn("block_no", F.col("block_no") + 1)


def titled(grid: Column) -> Column:
    """struct(title, rows): a title in one of the first two rows taken off with what stands above it."""
    n, wide = F.size(grid), F.size(F.try_element_at(grid, F.lit(1))) > 1
    first, second = T.title_of(F.try_element_at(grid, F.lit(1))), T.title_of(F.try_element_at(grid, F.lit(2)))
    at = F.when((n >= 2) & wide & first.isNotNull(), 1).when((n >= 3) & wide & second.isNotNull(), 2).otherwise(0)
    return F.struct(F.when(at == 1, first).when(at == 2, second).alias("title"), F.slice(grid, at + 1, F.greatest(n - at, F.lit(0))).alias("rows"))


def block_kind(html: Column) -> Column:
    """line_list, bom or null by the key words of a block; blocks of a drawing's frame are none."""
    up = F.upper(html)
    bom = T.has_any(up, K.BOM_HEADER_GROUPS[0]) & T.has_any(up, K.BOM_HEADER_GROUPS[1]) & T.has_any(up, K.BOM_HEADER_GROUPS[2])
    line = T.has_any(up, K.LINE_HEADER_GROUPS[0])
    return F.when(T.has_any(up, K.BOM_BLACKLIST), F.lit(None)).when(line, "line_list").when(bom, "bom")


def material_tables(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, block_no, kind, title, headers, rows, raw_rows) of material and line list tables.

    Title rows are taken off, a second header row is merged into the first, rows
    are brought to the width of the headers, shifted units put back, and noise
    rows left out; raw_rows counts the rows before that.
    """
    b = blocks(texts, keys, text).withColumn("kind", block_kind(F.col("html"))).filter("kind is not null")
    b = _held(b, "grid", G.html_grid(F.col("html"))).withColumn("g", titled(F.col("grid"))).filter(F.size("g.rows") >= 2)
    first, second = F.transform(F.col("g.rows")[0], strip), F.col("g.rows")[1]
    b = b.withColumn("two", T.is_sub_header(second))
    b = b.withColumn("headers", F.when(F.col("two"), T.merge_sub_headers(first, second)).otherwise(first))
    body = F.slice("g.rows", F.when(F.col("two"), 3).otherwise(2), F.size("g.rows"))
    b = _held(b, "all", G.normalised(body, F.col("headers")))
    rows = F.filter(F.transform("all", lambda r: T.repair_shift(r, F.col("headers"))), lambda r: ~T.is_noise_row(r))
    kind = F.when(F.upper(F.coalesce("g.title", F.lit(""))).rlike("LINE ?LIST"), "line_list").otherwise(F.col("kind"))
    return b.select(*keys, "block_no", kind.alias("kind"), F.col("g.title").alias("title"), "headers", rows.alias("rows"), F.size("all").alias("raw_rows"))


# What a block must hold to be read as a material table unasked.
ANCHORS = ("BILL OF MATERIAL", "DWG NO", "MAT'L", "LINE LIST")
METRICS = ("WEIGHT", "QTY", "Q'TY", "WT(KG)", "WT (KG)", "수량")
KIND_TYPES = {"bom": "BOM_자재", "line_list": "BOM_LINE_LIST"}


def parsed_tables(sections: DataFrame, keys: list[str], section_id: str, text: str, type_words: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(keys, block_no, table_id, type, headers, rows, notes, raw_rows, parsed_rows) of the tables of sections.

    Without `type_words` a block with an anchor and a metric is a material table,
    if it reads as one; all others have 1 to 3 header rows, notes set into the
    table, and rows. A block without rows gives nothing.
    """
    every = blocks(sections, [*keys, section_id], text)
    up = F.upper("html")
    gate = F.lit(False) if type_words else T.has_any(up, ANCHORS) & T.has_any(up, METRICS)
    every = every.withColumn("gate", gate)
    of_section = F.concat(F.lit("T-"), F.coalesce(F.col(section_id), F.lit("unknown")), F.lit("-"), F.lpad(F.col("block_no").cast("string"), 2, "0"))
    asked = every.filter("gate").select(*keys, section_id, F.col("block_no").alias("at"), "html")
    bom = material_tables(asked, [*keys, section_id, "at"], "html")
    bom = bom.withColumns({"block_no": F.col("at"), "type": F.when(F.col("kind") == "bom", KIND_TYPES["bom"]).otherwise(KIND_TYPES["line_list"]), "names": T.unique_headers(F.col("headers"), keep_blank=True)})
    cut_rows = lambda rows, n: F.transform(rows, lambda r: F.slice(T.pad(r, n), F.lit(1), n))
    bom = bom.select(*keys, "block_no", of_section.alias("table_id"), "type", F.col("names").alias("headers"), cut_rows(F.col("rows"), F.size("names")).alias("rows"), F.array().cast("array<string>").alias("notes"), "raw_rows")
    rest = _held(every, "g", G.html_grid(F.col("html"))).filter(F.size("g") > 0)
    rest = rest.filter(~(F.col("gate") & block_kind(F.col("html")).isNotNull() & (F.size(titled(F.col("g"))["rows"]) >= 2)))
    rest = rest.withColumn("n", F.when(F.size("g") < 2, 1).otherwise(T.header_rows(F.col("g"))))
    rest = rest.withColumn("headers", T.unique_headers(T.composite_headers(F.slice("g", F.lit(1), F.col("n")))))
    body = F.slice("g", F.col("n") + 1, F.size("g"))
    rest = rest.withColumns({"data": F.filter(body, lambda r: ~T.is_note_row(r)), "notes": F.transform(F.filter(body, T.is_note_row), lambda r: F.array_join(F.filter(r, lambda c: strip(c) != ""), " "))})
    rest = rest.select(*keys, "block_no", of_section.alias("table_id"), type_of_table(F.col("headers"), F.col("data"), type_words).alias("type"), "headers", cut_rows(F.col("data"), F.size("headers")).alias("rows"), "notes", (F.size("g") - F.col("n")).alias("raw_rows"))
    return bom.unionByName(rest).withColumn("parsed_rows", F.size("rows"))


def material_sections(tables: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, section_id, table_id, title, type, role, headers, rows, status, warnings, raw_rows) of an export.

    Material tables and line lists are numbered each on their own in `order`;
    empty ones keep their number but are left out. Headers are extended to the
    widest row and made unique, empty generated columns at the end go.
    """
    # numbering runs within one document
    listed = F.array_sort(F.collect_list(F.struct(*order, "headers", "rows", "raw_rows")))
    t = tables.groupBy(*keys, "kind").agg(listed.alias("l")).select(*keys, "kind", F.posexplode("l").alias("i", "t")).select(*keys, "kind", (F.col("i") + 1).alias("i"), "t.*").filter(F.size("rows") > 0)
    t = t.withColumn("names", T.unique_headers(T.extend_headers(F.col("headers"), F.col("rows"))))
    t = t.withColumn("rows", F.transform("rows", lambda r: T.pad(r, F.size("names"))))
    kept = T.kept_columns(F.col("names"), F.col("rows"))
    t = t.withColumn("kept", kept)
    t = t.withColumns({"headers": F.slice("names", F.lit(1), F.col("kept")), "rows": F.transform("rows", lambda r: F.slice(r, F.lit(1), F.col("kept")))})
    warnings = bom_warnings(F.col("headers"), F.col("rows"))
    line = F.col("kind") == "line_list"
    no = F.col("i").cast("string")
    short = F.when(line, "LL").otherwise("BOM")
    return t.withColumn("warnings", warnings).select(
        *keys, F.concat(short, F.lit("-"), no).alias("section_id"), F.concat(F.lit("T-"), short, F.lit("-"), no, F.lit("-01")).alias("table_id"),
        F.concat(F.when(line, "LINE LIST #").otherwise("BILL OF MATERIALS #"), no).alias("title"), F.when(line, KIND_TYPES["line_list"]).otherwise(KIND_TYPES["bom"]).alias("type"),
        F.when(line, "line_list_table").otherwise("primary_material_table").alias("role"), "headers", "rows", status_of(F.col("warnings")).alias("status"), "warnings", "raw_rows",
    )


def first_stage(found: DataFrame, keys: list[str], stage: str) -> DataFrame:
    """Rows of the earliest stage that gave any, for each of `keys`: one pass of extraction after another."""
    best = found.groupBy(*keys).agg(F.min(stage).alias("_first"))
    return found.join(best, keys).filter(F.col(stage) == F.col("_first")).drop("_first")


def strong_package(has_material: Column, has_lines: Column, core_words: Column) -> Column:
    """Whether a drawing's own tables suffice: both kinds, and three core words in one header."""
    return has_material & has_lines & (core_words >= 3)


def fallback_signals(tables: Column, has_meta: Column, chars: Column, strong: Column, quote: Column) -> Column:
    """struct(mixed, quote): few tables in much text, or a quotation without tables."""
    mixed = (tables > 0) & (tables <= 2) & ~has_meta & (chars >= 1000) & ~strong
    return F.struct(mixed.alias("mixed"), ((tables == 0) & (chars >= 500) & quote).alias("quote"))


def composite_flags(header: Column) -> Column:
    """struct(composite, self_repeating) of a header of parts joined by ` | ` or `_`."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(header, r"_\d+$", ""), r"\s*\|\s*|_"), strip), lambda p: p != "")
    return F.struct((F.size(parts) >= 2).alias("composite"), ((F.size(parts) >= 2) & (F.upper(parts[0]) == F.upper(F.try_element_at(parts, F.lit(2))))).alias("self_repeating"))


def info_pairs(headers: Column, rows: Column) -> Column:
    """array<array<string>> of four cells (item, value, item, value): a company table laid out in pairs.

    Each row, the header first, gives its filled cells two by two.
    """
    cells = F.flatten(F.transform(F.concat(F.array(headers), rows), lambda r: T.filled(r)))
    last = F.size(cells)
    at = lambda i: F.coalesce(F.try_element_at(cells, i), F.lit(""))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda i: F.array(at(i), at(i + 1), at(i + 2), at(i + 3)))).otherwise(F.array().cast("array<array<string>>"))


def plain_html(html: Column) -> Column:
    """Text of HTML: <br> as line break, tags off, entities read."""
    t = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def context_text(md: Column) -> Column:
    """Prose of Markdown: tables, pictures, tags and pipe lines out, blanks collapsed."""
    t = F.regexp_replace(T.without_tables(md), r"!\[[^\]]*\]\([^)]*\)", " ")
    lines = F.filter(F.split(F.regexp_replace(t, r"<[^>]+>", " "), "\n"), lambda x: ~x.rlike(r"\|.*\|"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"[ \t]+", " "))

