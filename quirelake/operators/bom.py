"""Tables of cells, and the roll-up of bills of materials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import keywords as K
from quirelake.functions.numbers import lenient_number
from quirelake.functions.text import strip
from quirelake.plans.order import bucketed_prefix_sum

TABLE = ["doc_id", "section_ord", "table_ord"]


def distinct_cells(cells: DataFrame) -> DataFrame:
    """Cells with repeated rows once."""
    return cells.select(*TABLE, "row_ord", "col_ord", "header", "value").distinct()


def grids(cells: DataFrame) -> DataFrame:
    """(doc_id, section_ord, table_ord, row_ord, row): each row as array in column order.

    A row is bounded by its table's width, so it is the largest group collected.
    """
    c = F.struct("col_ord", F.coalesce("value", F.lit("")).alias("value"))
    return distinct_cells(cells).groupBy(*TABLE, "row_ord").agg(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["value"]).alias("row"))


def canonical_header(header: Column, aliases: dict[str, tuple[str, ...]] = K.BOM_ALIASES) -> Column:
    """The roll-up column that a header stands for, null for others."""
    h = F.upper(strip(F.translate(header, "’‘", "''")))
    out = F.lit(None).cast("string")
    for name, others in aliases.items():
        out = F.when(h.isin(*others), F.lit(name)).otherwise(out)
    return out


def bom_rows(cells: DataFrame, tables: DataFrame, domains: tuple[str | None, ...] = ("bom",)) -> DataFrame:
    """(table key, row_ord, size, material, description, qty, weight) of the tables of `domains`, line lists left out.

    The first column of a name counts; missing ones are blank. Only cells of the
    roll-up's columns are shuffled.
    """
    named = F.col("domain").isin(*[d for d in domains if d is not None])
    wanted = named | F.col("domain").isNull() if None in domains else named
    own = tables.filter(wanted & ~F.col("type").eqNullSafe("BOM_LINE_LIST")).select(*TABLE).distinct()
    c = distinct_cells(cells.filter(canonical_header(F.col("header")).isNotNull())).withColumn("k", canonical_header(F.col("header")))
    c = c.join(own, TABLE, "left_semi")
    pick = lambda k: F.coalesce(F.min_by(F.when(F.col("k") == k, F.coalesce("value", F.lit(""))), F.when(F.col("k") == k, F.col("col_ord"))), F.lit(""))
    rows = c.groupBy(*TABLE, "row_ord").agg(*[pick(k).alias(a) for k, a in (("SIZE", "size"), ("MATERIAL", "material"), ("DESCRIPTION", "description"), ("QUANTITY", "q"), ("WEIGHT", "w"))])
    return rows.select(*TABLE, "row_ord", strip(F.col("size")).alias("size"), strip(F.col("material")).alias("material"), "description", lenient_number(F.col("q")).alias("qty"), lenient_number(F.col("w")).alias("weight"))


def aggregate_boms(rows: DataFrame, order: list[str]) -> DataFrame:
    """(item_no, size, material, description, qty, weight) summed over all sources.

    Rows without size and material, or without quantity and weight, do not count.
    The description is that of the first row under `order`. The numbering sorts
    within a size and sums over the sizes.
    """
    live = rows.filter(((F.col("size") != "") | (F.col("material") != "")) & ((F.col("qty") != 0) | (F.col("weight") != 0)))
    agg = live.groupBy("size", "material").agg(F.min_by("description", F.struct(*order)).alias("description"), F.round(F.sum("qty"), 2).alias("qty"), F.round(F.sum("weight"), 2).alias("weight"))
    numbered = bucketed_prefix_sum(agg.withColumn("_one", F.lit(1)), [], F.col("size"), ["material"], "_one", "_before")
    return numbered.withColumn("item_no", (F.col("_before") + 1).cast("long")).drop("_one", "_before")


def line_list(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells of all line lists in long form with their source; headers differ, so no wide union."""
    own = tables.filter("type = 'BOM_LINE_LIST'").select(*TABLE).distinct()
    return distinct_cells(cells).join(own, TABLE, "left_semi").select(F.col("doc_id").alias("source_doc"), "section_ord", "table_ord", "row_ord", "header", "value")
