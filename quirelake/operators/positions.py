"""Markers in text, as-of lookups by position, sections and carried context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions.text import strip

MARKER = r"<!--\s*(PAGE|SECTION|CONTEXT)\b[^>]*?-->"
PAGE_NO = r"^<!--\s*PAGE\s+(\d+)"
SECTION = r"<!-- SECTION: (\S+) \| (.+?) \| 부문:(.+?) \| 장:(.+?) -->"


def matches_with_offset(text: Column, pattern: str) -> Column:
    """array<struct(pos, match)>: every match of `pattern` with its 0-based offset.

    The text is split at the matches; an offset is the length of what stands
    before. `pattern` must not match the empty string and have group 0 = match.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    parts = F.split(text, pattern, -1)

    def step(acc: Column, pair: Column) -> Column:
        pos = acc["at"] + F.length(pair["p"])
        return F.struct((pos + F.length(pair["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct(pos.alias("pos"), pair["m"].alias("match")))).alias("out"))

    pairs = F.zip_with(found, F.slice(parts, F.lit(1), F.size(found)), lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,match:string>>").alias("out"))
    return F.aggregate(pairs, zero, step)["out"]


def markers(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, pos, end, kind, page) of all markers in reading order."""
    m = docs.filter("text is not null").select("doc_id", F.posexplode(matches_with_offset(F.col("text"), r"<!--\s*(?:PAGE|SECTION|CONTEXT)\b[^>]*?-->")).alias("ord", "m"))
    return m.select("doc_id", "ord", F.col("m.pos").alias("pos"), (F.col("m.pos") + F.length("m.match")).alias("end"), F.regexp_extract("m.match", MARKER, 1).alias("kind"), F.regexp_extract("m.match", PAGE_NO, 1).try_cast("int").alias("page"))


def line_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, line) with the 0-based offset of every line."""
    lines = F.split("text", "\n", -1)
    zero = F.array().cast("array<int>")
    starts = F.aggregate(lines, F.struct(F.lit(0).alias("at"), zero.alias("out")), lambda a, x: F.struct((a["at"] + F.length(x) + 1).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    z = docs.filter("text is not null").select("doc_id", F.posexplode(F.arrays_zip(starts.alias("pos"), lines.alias("line"))).alias("i", "z"))
    return z.select("doc_id", (F.col("i") + 1).alias("line_no"), F.col("z.pos").alias("pos"), F.col("z.line").alias("line"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, default_first: bool = False) -> DataFrame:
    """`left` with the `value` of the last `right` row whose `at` is not later.

    One sorted pass over both sides in place of a range join; `right` rows come
    first among equals. Without an earlier row: null, or with `default_first` the
    first value of the group. Groups are documents; a group that holds a large
    part of all rows should be cut by position first.
    """
    a = left.withColumns({"_r": F.lit(False), "_v": F.lit(None).cast(dict(right.dtypes)[value])})
    b = right.select(*by, at, F.col(value).alias("_v")).withColumn("_r", F.lit(True))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.col(at), F.col("_r").desc())
    got = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if default_first:
        got = F.coalesce(got, F.first("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return both.withColumn(value, got).filter(~F.col("_r")).drop("_r", "_v")


def carried(rows: DataFrame, by: list[str], order: list[str], column: str, out: str) -> DataFrame:
    """`out` = the last non-blank value of `column` up to each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(F.when(strip(F.col(column)) != "", F.col(column)), ignorenulls=True).over(w))


def segments(lines: DataFrame, is_title: Column, by: list[str], order: str) -> DataFrame:
    """(by, seg_no, title, first, last, n): lines cut where a title line begins.

    Lines before the first title are segment 0 without a title.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seg = lines.withColumns({"_t": is_title}).withColumn("seg_no", F.sum(F.when(F.col("_t"), 1).otherwise(0)).over(w))
    return seg.groupBy(*by, "seg_no").agg(F.min_by(F.when(F.col("_t"), F.col("line")), F.when(F.col("_t"), F.col(order))).alias("title"), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def gap_groups(rows: DataFrame, by: list[str], at: str, gap: Column, tie: list[str]) -> DataFrame:
    """`grp`: number of the run of rows whose distance to the row before is at most `gap`."""
    w = Window.partitionBy(*by).orderBy(at, *tie)
    far = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True))
    return rows.withColumn("_f", far).withColumn("grp", F.sum(F.when(F.col("_f"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def context_marker(section_id: Column, title: Column, chapter: Column, section: Column) -> Column:
    """The comment that repeats the section that goes on, before the text of a page; blank without one."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.when(section_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("<!-- CONTEXT: "), section_id, F.lit(" | "), blank(title), F.lit(" | 부문:"), blank(chapter), F.lit(" | 장:"), blank(section), F.lit(" -->\n\n")))


def page_marker(page: Column, context: Column | None = None) -> Column:
    """The comment that marks a page, with its context where there is one."""
    c = F.coalesce(context, F.lit("")) if context is not None else F.lit("")
    return F.concat(F.lit("<!-- PAGE "), page.cast("string"), F.when(c != "", F.concat(F.lit(" | "), c)).otherwise(F.lit("")), F.lit(" -->"))


def section_marker(section_id: Column, title: Column, department: Column, chapter: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("<!-- SECTION: "), section_id, F.lit(" | "), blank(title), F.lit(" | 부문:"), blank(department), F.lit(" | 장:"), blank(chapter), F.lit(" -->"))


def parse_section_marker(marker: Column) -> Column:
    g = lambda k: F.trim(F.regexp_extract(marker, SECTION, k))
    return F.struct(g(1).alias("section_id"), g(2).alias("title"), g(3).alias("department"), g(4).alias("chapter"))


def redistribute(groups: DataFrame, by: list[str]) -> DataFrame:
    """(by, section_id, text): one text block given to the markers that stand before it.

    `groups` is (by, text, markers array<struct(section_id, title)>). A section begins
    at the first line that starts with its id, else at the line that holds the first
    eight letters of its title. Sections without a place get ''; without any place
    the last marker gets the text. What stands before the first place goes to it.
    """
    text = F.col("text")

    def place(m: Column) -> Column:
        by_id = F.regexp_instr(text, F.concat(F.lit(r"(?m)^\Q"), m["section_id"], F.lit(r"\E\s+")))
        head = F.substring(m["title"], 1, 8)
        by_title = F.when(F.length(m["title"]) >= 2, F.instr(text, head))
        line = by_title - F.length(F.substring_index(F.substring(text, F.lit(1), by_title - 1), "\n", -1))
        return F.when(by_id > 0, by_id).when(by_title > 0, line)

    # the k-th marker with its place from 1, in order of places
    at = F.filter(F.transform("markers", lambda m, k: F.struct(place(m).alias("p"), k.alias("k"))), lambda x: x["p"].isNotNull())
    g = groups.withColumn("at", F.when(F.size("markers") > 1, F.array_sort(at)))
    blank = strip(F.coalesce(text, F.lit(""))) == ""

    def share(m: Column, k: Column) -> Column:
        i = F.array_position(F.transform("at", lambda x: x["k"]), k).cast("int")
        begin = F.try_element_at("at", i)["p"]
        end = F.coalesce(F.try_element_at("at", i + 1)["p"], F.length(text) + 1)
        own = strip(F.substring(text, begin, end - begin))
        before = strip(F.substring(text, F.lit(1), F.col("at")[0]["p"] - 1))
        first = F.when((i == 1) & (before != ""), F.concat(before, F.lit("\n\n"), own)).otherwise(own)
        last = F.when(k == F.size("markers") - 1, text).otherwise("")
        return F.when(blank, F.lit("")).when(F.size("markers") == 1, text).when(F.size("at") == 0, last).when(F.coalesce(i, F.lit(0)) > 0, first).otherwise("")

    out = g.select(*by, F.explode(F.transform("markers", lambda m, k: F.struct(m["section_id"].alias("section_id"), share(m, k).alias("text")))).alias("x"))
    return out.select(*by, "x.*")
