"""Python kernels for what higher-order functions cannot say, as Arrow UDFs."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

GRID = ArrayType(ArrayType(StringType()))
ROW = ArrayType(StringType())


class _Cells(HTMLParser):
    """Rows of (text, rowspan, colspan) of the first table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[list]] = []
        self.depth, self.done, self.open = 0, False, False
        self.mark: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif not self.depth:
            return
        elif tag == "tr":
            self.rows.append([])
            self.open = False
        elif tag in ("td", "th"):
            a = dict(attrs)
            span = [int(m[0]) if (m := re.match(r"\s*\d+", a.get(k) or "")) else 1 for k in ("rowspan", "colspan")]
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(["", max(1, span[0]), max(1, span[1])])
            self.open = True
        elif self.open:
            if tag in ("sup", "sub"):
                self.rows[-1][-1][0] += "^" if tag == "sup" else "_"
            else:
                self.rows[-1][-1][0] += " "

    def handle_endtag(self, tag: str) -> None:
        if tag == "table" and self.depth:
            self.depth -= 1
            self.done = self.depth == 0
        elif tag in ("td", "th", "tr"):
            self.open = False

    def handle_data(self, data: str) -> None:
        if self.open and not self.done:
            self.rows[-1][-1][0] += data


def expand(html: str) -> list[list[str]]:
    """Rectangular grid of the first table; spans repeat their text, later cells overwrite."""
    p = _Cells()
    p.feed(html)
    p.close()
    taken: dict[tuple[int, int], str] = {}
    width = 0
    for r, cells in enumerate(p.rows):
        c = 0
        for text, down, across in cells:
            while (r, c) in taken:
                c += 1
            text = re.sub(r"\s+", " ", text).strip()
            for i in range(r, min(r + down, len(p.rows))):
                for j in range(c, c + across):
                    taken[i, j] = text
            c += across
        width = max(width, c)
    width = max([width, *(j + 1 for _, j in taken)])
    return [[taken.get((r, c), "") for c in range(width)] for r in range(len(p.rows))]


def html_grid(html: Column) -> Column:
    """Grid of the first table of an HTML text; empty without one, null for null."""

    @F.pandas_udf(GRID)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else expand(x))

    return run(html)


def fit_width(row: list[str], width: int) -> list[str]:
    """A row padded, or its shortest neighbours merged, until it has `width` cells."""
    row = list(row)
    while len(row) > max(1, width):
        i = min(range(len(row) - 1), key=lambda k: len(row[k]) + len(row[k + 1]))
        row[i : i + 2] = [f"{row[i]} {row[i + 1]}".strip()]
    return row + [""] * (width - len(row))


def fitted(row: Column, width: Column) -> Column:
    @F.pandas_udf(ROW)
    def run(r: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else fit_width([y or "" for y in x], int(n)) for x, n in zip(r, w)])

    return run(row, width)


def composite_block(headers: list[str]) -> tuple[int, int] | None:
    """First composite header and the place behind the last one."""
    at = [i for i, h in enumerate(headers) if " | " in h or re.search(r"_(?!\d+$)", h)]
    return (at[0], at[-1] + 1) if at else None


def realign(row: list[str], headers: list[str]) -> list[str]:
    """A row of a table with composite headers whose last cells slid to the left.

    The filled cells at the start stay. The rest belong to the last columns: in a
    short row all that follow, in a row of full width with nothing behind the
    composite block its filled cells, if there are columns enough behind it.
    """
    width = len(headers)
    full = (list(row) + [""] * width)[:width]
    block = composite_block(headers)
    if block is None or block[0] == 0 or len(row) < 2:
        return full
    begin, end = block
    blank = [not c.strip() for c in full]
    if len(row) >= width:
        slid = [c for c, b in zip(full[begin:], blank[begin:]) if not b]
        if any(blank[:begin]) or not all(blank[end:]) or not 0 < len(slid) <= width - end:
            return full
        return full[:begin] + [""] * (width - begin - len(slid)) + slid
    lead = next((i for i in range(begin) if i >= len(row) or blank[i]), begin)
    rest = list(row[lead:])
    if lead == 0 or len(row) <= begin or len(rest) > width - begin:
        return full
    return row[:lead] + [""] * (width - lead - len(rest)) + rest


def normalise(rows: list[list[str]], headers: list[str]) -> list[list[str]]:
    """Every row at the width of the headers: longer ones merged, shorter ones set right."""
    return [fit_width(r, len(headers)) if len(r) > len(headers) else realign(r, headers) for r in rows]


def normalised(rows: Column, headers: Column) -> Column:
    @F.pandas_udf(GRID)
    def run(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else normalise([[c or "" for c in y] for y in x], list(k)) for x, k in zip(r, h)], dtype=object)

    return run(rows, headers)


def pipe_tables_to_html(text: str) -> str:
    """Pipe tables (header, separator, body) as HTML; body rows cut or padded to the header."""
    cells = lambda x: [c.strip() for c in re.sub(r"^\s*\||\|\s*$", "", x.strip()).split("|")]
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    lines, out, i = text.split("\n"), [], 0
    while i < len(lines):
        piped = lines[i].count("|") >= 2
        if piped and i + 1 < len(lines) and re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|[\s:|-]*", lines[i + 1]):
            head, j = cells(lines[i]), i + 2
            body = []
            while j < len(lines) and lines[j].count("|") >= 2:
                r = cells(lines[j])
                body.append((r + [""] * len(head))[: len(head)])
                j += 1
            row = lambda r, t: "<tr>" + "".join(f"<{t}>{esc(c)}</{t}>" for c in r) + "</tr>"
            out.append("<table><thead>" + row(head, "th") + "</thead><tbody>" + "".join(row(r, "td") for r in body) + "</tbody></table>")
            i = j
        else:
            out.append(lines[i])
            i += 1
    return "\n".join(out)


def markdown_tables_to_html(text: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else pipe_tables_to_html(x))

    return run(text)
