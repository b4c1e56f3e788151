"""Boxes and words on a page: ordering, grouping, de-duplication.

Greedy rules depend on the order of a page's boxes, so they run in one fold a
page (a page is bounded); everything that is not greedy is a window or a
higher-order function.
"""

from __future__ import annotations


from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "array<struct<type: string, label: string, bbox: array<double>, bbox_2d: array<double>, content: string, html: string, markdown: string, md: string, text: string, value: string>>"


def blocks(layout: Column) -> Column:
    """Layout JSON as blocks ordered by (y, x); blocks without a box come first; bad JSON is empty."""
    parsed = F.coalesce(F.from_json(layout, BLOCK), F.array().cast(BLOCK))
    box = lambda b: F.coalesce(b["bbox_2d"], b["bbox"], F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    keyed = F.transform(parsed, lambda b, i: F.struct(F.coalesce(F.try_element_at(box(b), F.lit(2)), F.lit(0.0)).alias("y"), F.coalesce(F.try_element_at(box(b), F.lit(1)), F.lit(0.0)).alias("x"), i.alias("i"), F.coalesce(b["label"], b["type"]).alias("label"), box(b).alias("bbox"), block_text(b).alias("text")))
    return F.array_sort(keyed)


def block_text(b: Column) -> Column:
    """The first filled one of html, content, markdown, md, text, value."""
    return F.coalesce(*[F.when(F.trim(b[k]) != "", b[k]) for k in ("html", "content", "markdown", "md", "text", "value")])


def first_table_box(blocks_: Column, width: Column, height: Column, image_width: int, image_height: int) -> Column:
    """The first table's box scaled from page to image, as whole pixels."""
    t = F.try_element_at(F.filter(blocks_, lambda b: b["label"] == "table"), F.lit(1))
    scale = lambda k, n, of: (F.element_at(t["bbox"], k) * n / of).cast("int")
    return F.when(t.isNotNull(), F.array(scale(1, image_width, width), scale(2, image_height, height), scale(3, image_width, width), scale(4, image_height, height)))


def keep_boxes(boxes: list[tuple[float, float, float, float]], overlap: float = 0.75) -> list[int]:
    """Places of the boxes that repeat none kept before: overlap of the smaller area and
    ratio of the areas both at least `overlap` make a repeat."""
    kept: list[int] = []
    area = lambda b: max(1.0, (b[2] - b[0]) * (b[3] - b[1]))
    for i, b in enumerate(boxes):
        for j in kept:
            a = boxes[j]
            w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
            small, large = sorted((area(a), area(b)))
            if w > 0 and h > 0 and w * h / small >= overlap and small / large >= overlap:
                break
        else:
            kept.append(i)
    return kept


def dedupe_boxes(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, x0, y0, x1, y1) without the boxes that repeat an earlier one of the page."""
    cols = [*by, "ord", "x0", "y0", "x1", "y1"]
    types = dict(boxes.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("ord")
        return p.iloc[keep_boxes(list(zip(p.x0, p.y0, p.x1, p.y1)))]

    return boxes.select(*cols).groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in cols))


def word_rows(words: DataFrame, by: list[str], tolerance: float = 3.0) -> DataFrame:
    """`row_no` of each word: a row begins where top differs from the row's first word by more
    than `tolerance`. Measured from the row's first word, not from its neighbour."""
    types = dict(words.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["top", "x0"], kind="stable")
        no, anchor, out = -1, None, []
        for t in p["top"]:
            if anchor is None or abs(t - anchor) > tolerance:
                no, anchor = no + 1, t
            out.append(no)
        p["row_no"] = out
        return p

    return words.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in words.columns) + ", row_no int")


def row_cells(words: DataFrame, by: list[str], gap: float = 18.0) -> DataFrame:
    """(by, row_no, cell_no, text, x0, x1): words of a row joined where they stand close."""
    w = Window.partitionBy(*by, "row_no").orderBy("x0")
    c = words.withColumn("_n", F.coalesce((F.col("x0") - F.lag("x1").over(w) > gap).cast("int"), F.lit(0)))
    c = c.withColumn("cell_no", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy(*by, "row_no", "cell_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ").alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def extended_boxes(boxes: DataFrame, by: list[str], page_height: float) -> DataFrame:
    """Boxes lower than 8 % of the page extended to 5 above the next one, or to 85 % of the page."""
    w = Window.partitionBy(*by).orderBy("ord")
    short = (F.col("y1") - F.col("y0")) < 0.08 * page_height
    return boxes.withColumn("y1", F.when(short, F.greatest(F.col("y1"), F.coalesce(F.lead("y0").over(w) - 5, F.lit(0.85 * page_height)))).otherwise(F.col("y1")))


def text_bands(boxes: DataFrame, by: list[str], page_height: float, least: float = 5.0) -> DataFrame:
    """(by, top, bottom) of the bands between the boxes of a page, those under `least` left out."""
    w = Window.partitionBy(*by).orderBy("y0", "ord")
    above = boxes.select(*by, F.coalesce(F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("top"), F.col("y0").alias("bottom"))
    last = boxes.groupBy(*by).agg(F.max("y1").alias("top")).withColumn("bottom", F.lit(page_height))
    return above.unionByName(last).filter(F.col("bottom") - F.col("top") >= least)


def nearest_column(words: DataFrame, headers: DataFrame, by: list[str], within: float = 15.0) -> DataFrame:
    """Each word with the header column whose centre is nearest, if nearer than `within`."""
    j = words.join(headers.select(*by, "col", F.col("x").alias("_c")), by)
    d = F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("_c"))
    best = j.filter(d < within).groupBy(*by, "word_ord").agg(F.min_by("col", F.struct(d, F.col("col"))).alias("col"))
    return words.join(best, [*by, "word_ord"], "left")


def drop_double_strikes(words: DataFrame, by: list[str]) -> DataFrame:
    """Words printed twice for bold: same text within 1 in top and 3 in x0 of one kept before."""
    types = dict(words.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, kept = pdf.sort_values("word_ord"), []
        for i, (t, top, x) in enumerate(zip(p["text"], p["top"], p["x0"])):
            if not any(t == a and abs(top - b) <= 1 and abs(x - c) <= 3 for _, a, b, c in kept):
                kept.append((i, t, top, x))
        return p.iloc[[k[0] for k in kept]]

    return words.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {types[c]}" for c in words.columns))


def bounding_box(words: DataFrame, by: list[str]) -> DataFrame:
    return words.groupBy(*by).agg(F.min("x0").alias("x0"), F.min("top").alias("y0"), F.max("x1").alias("x1"), F.max("bottom").alias("y1"))




#: Gap between rows that ends a table of conditions, the rows it has at least before that, and at most.
ROW_GAP, LEAST_ROWS, MOST_ROWS = 26.0, 2, 6
# Both stand in the row that begins a table of conditions.
CONDITION_HEADS = ("일반사항", "특기사항")
#: Tolerances of ruled lines: the least one, and how many line widths a corner spans.
LEAST_TOLERANCE, CORNER_WIDTHS = 8.0, 4.0


def condition_tables(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_no, n, x0, y0, x1, y1) of tables that a row with both condition heads begins.

    `rows` is (by, row_no, text, x0, top, x1, bottom). A table takes the rows that
    follow, MOST_ROWS in all, up to a gap of more than ROW_GAP behind its second.
    The rows of a start meet by number, so no page is collected.
    """
    bare = F.replace("text", F.lit(" "), F.lit(""))
    starts = rows.filter(reduce(lambda a, w: a & bare.contains(w), CONDITION_HEADS, F.lit(True))).select(*by, F.col("row_no").alias("start"))
    asked = starts.select(*by, "start", F.explode(F.sequence(F.lit(0), F.lit(MOST_ROWS - 1))).alias("k")).withColumn("row_no", F.col("start") + F.col("k"))
    near = asked.join(rows, [*by, "row_no"]).groupBy(*by, "start").agg(F.array_sort(F.collect_list(F.struct("k", "x0", "top", "x1", "bottom"))).alias("l"))
    ends = F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: (i > LEAST_ROWS) & (F.try_element_at("l", i)["top"] - F.try_element_at("l", i - 1)["top"] > ROW_GAP))
    own = near.select(*by, F.col("start").alias("row_no"), F.slice("l", F.lit(1), F.coalesce(F.try_element_at(ends, F.lit(1)) - 1, F.size("l"))).alias("l"))
    pick = lambda f, c: f(F.transform("l", lambda x: x[c]))
    return own.select(*by, "row_no", F.size("l").alias("n"), pick(F.array_min, "x0").alias("x0"), pick(F.array_min, "top").alias("y0"), pick(F.array_max, "x1").alias("x1"), pick(F.array_max, "bottom").alias("y1"))


def line_tolerances(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, snap, join_at, meet): tolerances from the widest line of each page; a line without width is 1 wide."""
    widest = F.max(F.coalesce("width", F.lit(1.0)))
    reach = F.greatest(F.lit(LEAST_TOLERANCE), widest * CORNER_WIDTHS)
    return lines.groupBy(*by).agg((reach / 2).alias("snap"), reach.alias("join_at"), reach.alias("meet"))


def words_outside(words: DataFrame, boxes: DataFrame, by: list[str]) -> DataFrame:
    """Words whose middle lies in no box of their page; a page's words meet that page's boxes only."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    own = boxes.groupBy(*by).agg(F.collect_list(F.struct(*[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])).alias("_boxes"))  # the boxes of one page
    inside = F.exists("_boxes", lambda b: (b["b_x0"] <= x) & (x <= b["b_x1"]) & (b["b_y0"] <= y) & (y <= b["b_y1"]))
    return words.join(own, by, "left").filter(~F.coalesce(inside, F.lit(False))).drop("_boxes")


#: Of a header row of loose words: fewest and most words, their mean length, and the share of the page they span.
HEADER_WORDS, HEADER_LENGTH, HEADER_SPAN = (2, 8), 15, 0.3
#: Words and rows that a page with a table of loose words has at least.
PAGE_WORDS, TABLE_ROWS = 6, 3


def aligned_tables(words: DataFrame, by: list[str], page_width: float) -> tuple[DataFrame, DataFrame]:
    """Tables of words that stand below each other, one a page: (cells, boxes).

    `words` is (by, row_no, word_ord, text, x0, top, x1, bottom), see word_rows. The
    first row that looks like a header gives the columns; each later word joins
    the column whose centre is nearest, within 15. cells is (by, row_no, col, text),
    rows counted from the header; boxes (by, x0, y0, x1, y1). Only a page's at most
    eight header words meet its words.
    """
    span = F.max("x1") - F.min("x0")
    rows = words.groupBy(*by, "row_no").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("length"), span.alias("span"))
    fits = F.col("n").between(*HEADER_WORDS) & (F.col("length") < HEADER_LENGTH) & (F.col("span") > page_width * HEADER_SPAN)
    page = rows.groupBy(*by).agg(F.min(F.when(fits, F.col("row_no"))).alias("head"), F.sum("n").alias("words"), F.count(F.lit(1)).alias("rows"), F.collect_set("row_no").alias("nos"))
    page = page.filter(F.col("head").isNotNull() & (F.col("words") >= PAGE_WORDS) & (F.size(F.filter("nos", lambda i: i >= F.col("head"))) >= TABLE_ROWS)).select(*by, "head")
    own = words.join(page, by).filter("row_no >= head")
    heads = own.filter("row_no = head").groupBy(*by).agg(F.array_sort(F.collect_list((F.col("x0") + F.col("x1")) / 2)).alias("c")).select(*by, F.posexplode("c").alias("col", "x"))
    placed = nearest_column(own, heads, by).filter("col is not null")
    cells = placed.groupBy(*by, (F.col("row_no") - F.col("head")).alias("row_no"), "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    return cells, bounding_box(own, by)


def found_tables(ruled: DataFrame, aligned: DataFrame, by: list[str]) -> DataFrame:
    """(by, ord, x0, y0, x1, y1): ruled tables, and tables of loose words that repeat none of them."""
    cols = ["x0", "y0", "x1", "y1"]
    both = ruled.select(*by, F.lit(0).alias("_p"), *cols).unionByName(aligned.select(*by, F.lit(1).alias("_p"), *cols))
    w = Window.partitionBy(*by).orderBy("_p", "y0", "x0", "y1", "x1")
    return dedupe_boxes(both.select(*by, (F.row_number().over(w) - 1).alias("ord"), *cols), by)
