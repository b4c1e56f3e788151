"""Rows, headers and grids as array expressions.

A row is array<string>, a grid array<array<string>>; everything here is built of
higher-order functions and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions import keywords as K
from quirelake.functions.text import collapse, compact_header, strip

NUMERIC = r"^[\d,.\-\s]*$"


def filled(row: Column) -> Column:
    """The non-blank cells of a row, stripped."""
    return F.filter(F.transform(row, lambda x: strip(F.coalesce(x, F.lit("")))), lambda x: x != "")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """The words that occur in `text`, in the order of `words`."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))


def count_hits(text: Column, words: tuple[str, ...]) -> Column:
    return F.size(hits(text, words))


def is_noise_row(row: Column, words: tuple[str, ...] = K.NOISE_ROW) -> Column:
    """Blank rows, rows with a noise word, and rows of several equal cells."""
    cells = filled(row)
    return (F.size(cells) == 0) | has_any(F.upper(F.array_join(row, " ")), words) | ((F.size(cells) > 1) & (F.size(F.array_distinct(cells)) == 1))


def is_note_row(row: Column) -> Column:
    """Remarks set into a table: marked text, or one cell that is long or numbered."""
    text = F.trim(F.array_join(row, " "))
    cells = filled(row)
    marked = text.rlike(r"\[주\]|〔주〕|【주】|^[①-⑩]|^[㉮-㉷]|^[-–] |^비\s*고")
    lone = F.try_element_at(cells, F.lit(1))
    alone = (F.size(cells) == 1) & ((F.length(lone) > 50) | lone.rlike(r"^\(\d{4}\)\s*.+|^\d+-\d+(-\d+)?\s+.{4,}"))
    return (text != "") & (marked | alone)


def is_header_like(row: Column) -> Column:
    """More than half of the row's cells are words."""
    return F.size(F.filter(row, lambda x: (x != "") & ~x.rlike(NUMERIC))) > F.size(row) * 0.5


def is_repeated_marker(row: Column) -> Column:
    """A numbered section title repeated over at least two cells."""
    cells = F.transform(filled(row), collapse)
    return (F.size(cells) >= 2) & (F.size(F.array_distinct(cells)) == 1) & F.coalesce(F.try_element_at(cells, F.lit(1)).rlike(r"^\d+\.\s*\S+$"), F.lit(False))


def is_sub_header(row: Column, words: tuple[str, ...] = K.SUB_HEADERS) -> Column:
    cells = filled(row)
    named = F.size(F.filter(cells, lambda x: has_any(F.upper(x), words)))
    digits = F.size(F.filter(cells, lambda x: x.rlike(NUMERIC)))
    return (F.size(cells) >= 2) & (named >= 2) & (digits <= F.size(cells) * 0.4)


def title_of(row: Column) -> Column:
    """The one text that fills a title row, else null."""
    one = F.array_distinct(filled(row))
    t = F.try_element_at(one, F.lit(1))
    return F.when((F.size(one) == 1) & (F.length(t) >= 3) & ~t.rlike(r"^\d+$"), t)


def unique_headers(headers: Column, blank: str = "Column_", base: int = 1, keep_blank: bool = False) -> Column:
    """Repeated headers as name_2, name_3; blank ones by their place, or as they are with `keep_blank`."""
    names = F.transform(headers, lambda h, i: F.when(strip(F.coalesce(h, F.lit(""))) == "", F.lit("") if keep_blank else F.concat(F.lit(blank), (i + base).cast("string"))).otherwise(strip(h)))

    def number(h: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda x: x == h))
        return F.when((before > 1) & (h != ""), F.concat(h, F.lit("_"), before.cast("string"))).otherwise(h)

    return F.transform(names, number)


def fill_parents(parents: Column, children: Column) -> Column:
    """Blank parent headers take the last filled one to their left, where a child stands below."""

    def fill(h: Column, i: Column) -> Column:
        left = F.filter(F.slice(parents, F.lit(1), i + 1), lambda x: x != "")
        child = F.coalesce(F.try_element_at(children, i + 1), F.lit(""))
        return F.when((h == "") & (child != ""), F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit(""))).otherwise(h)

    return F.transform(parents, fill)


def composite_headers(grid: Column) -> Column:
    """Distinct header parts of every column joined by `_`, top to bottom."""
    width = F.array_max(F.transform(grid, lambda r: F.size(r)))
    return F.transform(F.sequence(F.lit(1), F.greatest(width, F.lit(1))), lambda k: F.array_join(F.array_distinct(F.filter(F.transform(grid, lambda r: F.coalesce(F.try_element_at(r, k), F.lit(""))), lambda x: x != "")), "_"))


def header_rows(grid: Column) -> Column:
    """How many rows of a grid are header: 1 to 3."""
    row = lambda k: F.coalesce(F.try_element_at(grid, F.lit(k)), F.array().cast("array<string>"))
    n = F.size(grid)
    doubled = F.size(F.array_distinct(row(1))) < F.size(row(1))
    deep = F.when(is_repeated_marker(row(3)), 2).when(is_header_like(row(2)) & is_header_like(row(3)) & ~is_header_like(row(4)), 3)
    return F.when((n < 2) | ~doubled, 1).otherwise(F.coalesce(F.when(n >= 4, deep), F.when((n >= 3) & is_header_like(row(2)), F.lit(2)), F.lit(1)))


def merge_sub_headers(parents: Column, children: Column) -> Column:
    """Parent and child as `parent | child`; equal parts once; blanks by place; made unique."""

    def join(p: Column, c: Column) -> Column:
        a, b = strip(F.coalesce(p, F.lit(""))), strip(F.coalesce(c, F.lit("")))
        return F.when((b == "") | (compact_header(a) == compact_header(b)), a).when(a == "", b).otherwise(F.concat(a, F.lit(" | "), b))

    return unique_headers(F.zip_with(parents, children, join))


def quantity_header(h: Column) -> Column:
    return compact_header(h).isin("QTY", "QUANTITY", "수량") | h.contains("수량")


def unit_header(h: Column) -> Column:
    u = F.upper(h)
    return (u.contains("UNIT") | h.contains("단위")) & ~has_any(u, ("WEIGHT", "중량", "AREA", "면적", "KG", "M2"))


def unit_like_header(h: Column) -> Column:
    return F.exists(F.split(F.upper(h), r"\s*\|\s*|_"), lambda p: p.isin("UNIT", "단위"))


def shift_columns(headers: Column) -> Column:
    """struct(qty, unit, shifted), 1-based, of a table whose unit may stand under another header."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(headers) - 1, F.lit(1))), lambda i: quantity_header(F.try_element_at(headers, i)) & F.coalesce(unit_header(F.try_element_at(headers, i + 1)), F.lit(False)))
    q = F.try_element_at(at, F.lit(1))
    later = F.filter(F.sequence(F.lit(1), F.greatest(F.size(headers), F.lit(1))), lambda i: (i > q + 1) & F.coalesce(unit_like_header(F.try_element_at(headers, i)), F.lit(False)))
    s = F.try_element_at(later, F.lit(1))
    return F.when(q.isNotNull() & s.isNotNull(), F.struct(q.alias("qty"), (q + 1).alias("unit"), s.alias("shifted")))


def repair_shift(row: Column, headers: Column) -> Column:
    """Cells from the unit to the shifted column moved one to the left, where quantity is
    blank, the unit a number and the shifted cell a unit."""
    c = shift_columns(headers)
    at = lambda i: strip(F.coalesce(F.try_element_at(row, i), F.lit("")))
    shifted = c.isNotNull() & (at(c["qty"]) == "") & at(c["unit"]).rlike(r"^-?[\d,]+\.?\d*$") & at(c["shifted"]).rlike(K.UNIT_VALUE)
    moved = F.transform(row, lambda x, i: F.when((i + 1 >= c["qty"]) & (i + 1 < c["shifted"]), F.try_element_at(row, i + 2)).when(i + 1 == c["shifted"], F.lit("")).otherwise(x))
    return F.when(shifted, moved).otherwise(row)


def pad(row: Column, width: Column) -> Column:
    return F.when(F.size(row) < width, F.concat(row, F.array_repeat(F.lit(""), (width - F.size(row)).cast("int")))).otherwise(row)


def extend_headers(headers: Column, rows: Column) -> Column:
    """Headers with Column_n for every cell beyond them in the widest row."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    return F.when(width > F.size(headers), F.concat(headers, F.transform(F.sequence(F.size(headers) + 1, width), lambda k: F.concat(F.lit("Column_"), k.cast("string"))))).otherwise(headers)


def is_empty_tail(header: Column) -> Column:
    return header.rlike(r"^(?i:Column_|col_)\d+$")


def kept_columns(headers: Column, rows: Column) -> Column:
    """How many columns remain when empty generated ones are taken off the end."""
    live = F.filter(F.sequence(F.lit(1), F.greatest(F.size(headers), F.lit(1))), lambda i: ~F.coalesce(is_empty_tail(F.try_element_at(headers, i)), F.lit(False)) | F.exists(rows, lambda r: strip(F.coalesce(F.try_element_at(r, i), F.lit(""))) != ""))
    return F.when(F.size(rows) == 0, F.size(headers)).otherwise(F.coalesce(F.array_max(live), F.lit(0)))


def pipe_rows(text: Column) -> Column:
    """Grid of the lines with at least two pipes; edge blanks off, separator rows out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    body = F.filter(lines, lambda x: ~x.rlike(r"^[\s|:\-]+$"))
    return F.transform(body, lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\||\|$", ""), r"\|", -1), strip))


def gap_rows(text: Column) -> Column:
    """Grid of the lines that two or more blanks part into at least three cells."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.split(strip(x), r"\s{2,}")), lambda r: F.size(r) >= 3)


def text_rows(text: Column) -> Column:
    """Pipe rows, or gap rows where there are none."""
    p = pipe_rows(text)
    return F.when(F.size(p) > 0, p).otherwise(gap_rows(text))


def row_map(headers: Column, row: Column) -> Column:
    """Row as map header -> stripped value; short rows padded. Headers must be unique."""
    return F.map_from_arrays(headers, F.transform(F.slice(pad(row, F.size(headers)), F.lit(1), F.size(headers)), lambda x: strip(F.coalesce(x, F.lit("")))))


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def render_html(headers: Column, rows: Column) -> Column:
    """Headers and rows as an HTML table, cells escaped."""
    cells = lambda r, tag: F.array_join(F.transform(r, lambda x: F.concat(F.lit(f"<{tag}>"), escape_html(F.coalesce(x, F.lit(""))), F.lit(f"</{tag}>"))), "")
    head = F.concat(F.lit("<thead><tr>"), cells(headers, "th"), F.lit("</tr></thead>"))
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), cells(r, "td"), F.lit("</tr>"))), "")
    return F.concat(F.lit("<table>"), head, F.lit("<tbody>"), body, F.lit("</tbody></table>"))


def html_tables(text: Column) -> Column:
    """Every <table>…</table>; if none is closed, the text from the first <table on."""
    closed = F.regexp_extract_all(text, F.lit(r"(?is)(<table[^>]*>.*?</table>)"), 1)
    tail = F.regexp_extract(text, r"(?is)(<table.*)$", 1)
    return F.when(F.size(closed) > 0, closed).when(tail != "", F.array(tail)).otherwise(F.array().cast("array<string>"))


def without_tables(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?is)<table[^>]*>.*?</table>", ""))


def two_columns(row: Column) -> Column:
    """A row of a label and value table: one cell gets a blank value, of more than two all but the last are the label."""
    n = F.size(row)
    label = F.array_join(F.slice(row, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")
    return F.when(n == 0, F.array(F.lit(""), F.lit(""))).when(n == 1, F.array(row[0], F.lit(""))).otherwise(F.array(strip(label), F.element_at(row, -1)))


def trim_doubled_tail(parents: Column, children: Column, merged: Column) -> Column:
    """Merged headers without parents that were repeated past the end of the sub-headers.

    From the end, a header without a sub-header goes while it equals the one before it.
    """
    n, m = F.size(merged), F.size(children)
    at = lambda a, i: strip(F.coalesce(F.try_element_at(a, i), F.lit("")))
    stays = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == 1) | (at(children, i) != "") | (at(parents, i) == "") | (at(parents, i) != at(parents, i - 1)))
    return F.when((n < 2) | (F.size(parents) <= m), merged).otherwise(F.slice(merged, F.lit(1), F.array_max(stays)))
