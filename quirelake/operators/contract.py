"""Domain, role and quality of parsed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import keywords as K
from quirelake.functions import tables as T
from quirelake.functions.bind import let
from quirelake.functions.text import compact_header, strip
from quirelake.operators.bom import TABLE, grids


def compact(headers: Column) -> Column:
    """All headers of a table as one key."""
    return F.array_join(F.transform(headers, lambda h: compact_header(F.coalesce(h, F.lit("")))), "")


def is_bom_material(key: Column) -> Column:
    return (T.count_hits(key, K.BOM_MATERIAL_WORDS) >= 4) & key.contains("DESCRIPTION")


def is_material_quantity(key: Column) -> Column:
    return (T.count_hits(key, K.MATERIAL_QUANTITY_WORDS) >= 5) & key.contains("수량")


def is_estimate_item(key: Column) -> Column:
    return (T.count_hits(key, K.ESTIMATE_ITEM_WORDS) >= 5) & T.has_any(key, ("품목", "항목"))


def is_source_info(text: Column) -> Column:
    return T.count_hits(text, K.SOURCE_INFO_WORDS) >= 3


def contract(type_: Column, key: Column, text: Column, preset: str | None = None) -> Column:
    """struct(domain, role) by the first rule that holds: BOM, productivity standard,
    estimate by preset, trade statement, estimate by headers, else generic."""
    return let(F.struct(type_.alias("type"), key.alias("key"), text.alias("text")), lambda t: _contract(t["type"], t["key"], t["text"], preset))


def _contract(type_: Column, key: Column, text: Column, preset: str | None) -> Column:
    pair = lambda d, r: F.struct(F.lit(d).alias("domain"), F.lit(r).alias("role"))
    out = F.when(type_ == "BOM_LINE_LIST", pair("bom", "line_list_table")).when((type_ == "BOM_자재") | is_bom_material(key), pair("bom", "primary_material_table"))
    for t, role in (("A_품셈", "pumsem_quantity_table"), ("B_규모기준", "pumsem_size_table"), ("C_구분설명", "pumsem_description_table")):
        out = out.when(type_ == t, pair("pumsem", role))
    if preset == "pumsem":
        return out.otherwise(pair("pumsem", "pumsem_table"))
    if preset == "estimate":
        out = out.when(T.has_any(text, ("일반사항", "특기사항")), pair("estimate", "condition_table"))
        out = out.when(T.has_any(key, ("재료비", "노무비", "경비", "합계")) & T.has_any(key, ("단가", "금액")), pair("estimate", "detail_table"))
        return out.when(is_material_quantity(key), pair("generic", "material_quantity_table")).otherwise(pair("estimate", "estimate_table"))
    out = out.when(T.has_any(text, K.TRADE_WORDS), pair("trade_statement", "trade_statement_table"))
    return out.when(T.count_hits(key, K.ESTIMATE_WORDS) >= 4, pair("estimate", "estimate_table")).otherwise(pair("generic", "generic_table"))


def type_of_table(headers: Column, rows: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """general without key words; else the productivity-standard kind of a table."""
    if not words:
        return F.lit("general")
    head = F.lower(F.array_join(headers, " "))
    labour = F.size(F.filter(rows, lambda r: T.has_any(F.replace(F.coalesce(F.try_element_at(r, F.lit(1)), F.lit("")), F.lit(" "), F.lit("")), K.LABOUR_ROWS)))
    out = F.when((T.count_hits(head, words.get("A_품셈", ())) >= 2) | ((F.size(rows) >= 2) & (labour >= 2)), F.lit("A_품셈"))
    out = out.when(T.has_any(head, words.get("B_규모기준", ())), F.lit("B_규모기준"))
    return out.when((F.size(headers) == 2) & T.has_any(head, words.get("C_구분설명", ())), F.lit("C_구분설명")).otherwise(F.lit("D_기타"))


def bom_warnings(headers: Column, rows: Column) -> Column:
    """Warnings of a material table, in fixed order."""
    keys = F.transform(headers, compact_header)
    first = T.filled(F.coalesce(F.try_element_at(rows, F.lit(1)), F.array().cast("array<string>")))
    like_header = (F.size(first) >= 2) & (F.size(F.filter(first, lambda v: F.array_contains(keys, compact_header(v)))) >= 2) & ~F.exists(first, lambda v: v.rlike(r"^-?[\d,]+\.?\d*$"))
    own_parent = F.exists(headers, lambda h: (F.size(F.split(h, r"\s*\|\s*|_(?!\d+$)")) >= 2) & (compact_header(F.split(h, r"\s*\|\s*|_(?!\d+$)")[0]) == compact_header(F.split(h, r"\s*\|\s*|_(?!\d+$)")[1])))
    c = T.shift_columns(headers)
    at = lambda r, i: strip(F.coalesce(F.try_element_at(r, i), F.lit("")))
    shift = c.isNotNull() & F.exists(rows, lambda r: (at(r, c["qty"]) == "") & at(r, c["unit"]).rlike(r"^-?[\d,]+\.?\d*$") & at(r, c["shifted"]).rlike(K.UNIT_VALUE))
    last = F.size(headers)
    tail = F.try_element_at(headers, F.lit(-1)).startswith("Column_") & (F.size(rows) > 0) & F.forall(rows, lambda r: at(r, last) == "")
    ragged = F.exists(rows, lambda r: F.size(r) != F.size(headers))
    flags = ((ragged, "header_row_key_mismatch"), (own_parent, "self_repeating_composite_header"), (like_header, "first_row_looks_like_header"), (shift, "qty_unit_shift_suspected"), (tail, "empty_tail_column"))
    return F.filter(F.array(*[F.when(F.coalesce(f, F.lit(False)), F.lit(n)) for f, n in flags]), lambda x: x.isNotNull())


def table_warnings(headers: Column, rows: Column, domain: Column, role: Column, repeated_long: Column) -> Column:
    """Warnings of a table of another domain."""
    key = compact(headers)
    quantity, money = T.has_any(key, ("수량", "數量", "QTY", "QUANTITY")), T.has_any(key, ("금액", "金額", "단가", "單價", "AMOUNT", "PRICE"))
    flags = (
        (F.exists(rows, lambda r: F.size(r) != F.size(headers)), "header_row_key_mismatch"),
        ((domain == "estimate") & (role == "estimate_table") & quantity & ~money, "estimate_amount_column_missing"),
        ((domain == "generic") & is_estimate_item(key), "generic_estimate_misroute_suspected"),
        (repeated_long, "repeated_long_cell_value"),
    )
    return F.filter(F.array(*[F.when(F.coalesce(f, F.lit(False)), F.lit(n)) for f, n in flags]), lambda x: x.isNotNull())


def status_of(warnings: Column) -> Column:
    return F.when(F.array_contains(warnings, "header_row_key_mismatch"), "fail").when(F.size(warnings) > 0, "warning").otherwise("ok")


def worst(status: Column) -> Column:
    """Aggregate: fail over warning over ok; ok for nothing."""
    rank = F.max(F.when(status == "fail", 2).when(status == "warning", 1).otherwise(0))
    return F.when(rank == 2, "fail").when(rank == 1, "warning").otherwise("ok")


def distinct_tables(tables: DataFrame) -> DataFrame:
    return tables.dropDuplicates(TABLE)


def tables_with_rows(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Tables with their rows as array<array<string>> in order.

    The rows of one table are the unit of its contract and bounded by one document.
    """
    rows = grids(cells).groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_ord", "row"))), lambda x: x["row"]).alias("rows"))
    own = distinct_tables(tables).select(*TABLE, "table_id", "type", F.coalesce("headers", F.array().cast("array<string>")).alias("headers"), F.col("domain").alias("saved_domain"), F.col("role").alias("saved_role"), F.col("quality").alias("saved_quality"))
    return own.join(rows, TABLE, "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<array<string>>")))


def repeated_long_values(cells: DataFrame) -> DataFrame:
    """Table keys with a value of at least 24 characters, no number, three times or more."""
    v = cells.select(*TABLE, "row_ord", "col_ord", F.trim("value").alias("value")).distinct().filter((F.length("value") >= 24) & ~F.col("value").rlike(T.NUMERIC))
    return v.groupBy(*TABLE, "value").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select(*TABLE).distinct().withColumn("repeated_long", F.lit(True))


def annotate(tables: DataFrame, cells: DataFrame, preset: str | None = None) -> DataFrame:
    """(table key, domain, role, status, warnings): the contract of every table from its content."""
    t = tables_with_rows(tables, cells).join(repeated_long_values(cells), TABLE, "left")
    text = F.concat_ws(" ", F.array_join("headers", " "), F.col("type"), F.array_join(F.flatten(F.slice("rows", 1, 3)), " "))
    t = t.withColumn("c", contract(F.coalesce("type", F.lit("")), compact(F.col("headers")), text, preset))
    t = t.withColumns({"domain": F.col("c.domain"), "role": F.col("c.role")})
    w = F.when(F.col("domain") == "bom", bom_warnings(F.col("headers"), F.col("rows"))).otherwise(table_warnings(F.col("headers"), F.col("rows"), F.col("domain"), F.col("role"), F.coalesce("repeated_long", F.lit(False))))
    return t.withColumn("warnings", w).select(*TABLE, "domain", "role", status_of(F.col("warnings")).alias("status"), "warnings", "saved_domain", "saved_role", "saved_quality", "headers", "rows")


def row_style(row: Column, headers: Column) -> Column:
    """section, subtotal or body, for rendering."""
    first = strip(F.coalesce(F.try_element_at(row, F.lit(1)), F.lit("")))
    money = F.filter(F.zip_with(headers, row, lambda h, v: F.when(h.contains("금액") | h.contains("금 액"), strip(F.coalesce(v, F.lit(""))))), lambda x: x.isNotNull())
    section = (F.size(money) > 0) & F.forall(money, lambda x: x == "") & (first != "") & ~first.rlike(r"^-?[\d,]+$")
    return F.when(section, "section").when(first.rlike(r"소\s*계|합\s*계|계\s*$|간접비|직접비\s*소계"), "subtotal").otherwise("body")


def sheet_kind(domain: Column, role: Column) -> Column:
    """The sheet that a table of known contract goes to."""
    return (
        F.when((domain == "bom") & role.isin("primary_material_table", "line_list_table"), "bom_generic")
        .when((domain == "estimate") & (role == "estimate_table"), "estimate")
        .when((domain == "estimate") & (role == "detail_table"), "detail")
        .when((domain == "estimate") & (role == "condition_table"), "condition")
        .otherwise("generic")
    )


def split_conditions(rows: Column) -> Column:
    """struct(items, conditions) of an estimate table's rows.

    A row whose first cell is a condition label becomes (label, value, note): the
    first distinct value of fewer than 45 characters and the first longer one.
    Blank-below marks and rows that list three labels or more go to neither.
    """
    labels = F.create_map(*[F.lit(x) for kv in K.CONDITION_LABELS.items() for x in kv])
    label = lambda r: F.try_element_at(labels, F.replace(strip(F.coalesce(F.try_element_at(r, F.lit(1)), F.lit(""))), F.lit(" "), F.lit("")))
    listed = lambda r: reduce(lambda a, k: a + F.when(F.array_join(r, " ").contains(k), 1).otherwise(0), K.CONDITION_LABELS, F.lit(0))
    aggregate = lambda r: (listed(r) >= 3) & F.exists(r, lambda v: F.length(v) >= 50)
    dropped = lambda r: F.array_join(r, " ").contains("이하 여백") | aggregate(r)

    def condition(r: Column) -> Column:
        values = F.array_distinct(F.filter(T.filled(F.slice(r, F.lit(2), F.size(r))), lambda v: v != ""))
        return F.struct(label(r).alias("label"), F.try_element_at(F.filter(values, lambda v: F.length(v) < 45), F.lit(1)).alias("value"), F.try_element_at(F.filter(values, lambda v: F.length(v) >= 45), F.lit(1)).alias("note"))

    return F.struct(F.filter(rows, lambda r: label(r).isNull() & ~dropped(r)).alias("items"), F.transform(F.filter(rows, lambda r: label(r).isNotNull() & ~dropped(r)), condition).alias("conditions"))
