"""Reading material tables out of loose text lines, as a transition table.

What a line does is looked up in a table of rules for the mode: off, seek (an
anchor was seen, no header yet), read. Noise rows are left out at the end.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions import keywords as K
from quirelake.functions.text import sanitize_html

RESULT = "array<struct<kind: string, table_no: int, headers: array<string>, rows: array<array<string>>>>"


def cells_of(line: str) -> list[str]:
    """Non-blank pipe cells of a line with at least two pipes, else the line itself."""
    if line.count("|") >= 2:
        return [c.strip() for c in line.split("|") if c.strip()]
    return [line.strip()] if line.strip() else []


def _in_text(words: tuple[str, ...], text: str) -> bool:
    return any(w in text for w in words)


def material_header(cells: list[str]) -> bool:
    text = " ".join(cells).upper()
    return all(_in_text(g, text) for g in K.BOM_HEADER_GROUPS)


def line_header(cells: list[str]) -> bool:
    text = " ".join(cells).upper()
    a, b, c = K.LINE_HEADER_GROUPS
    return _in_text(a, text) or (_in_text(b, text) and _in_text(c, text))


def revision_header(cells: list[str]) -> bool:
    text = " ".join(cells).upper()
    return sum(w in text for w in K.REV_MARKERS) >= 3


@dataclass(frozen=True)
class Line:
    """One line with what the rules ask of it."""

    text: str
    cells: list[str]
    kind: str

    def header(self) -> bool:
        return material_header(self.cells) if self.kind == "bom" else line_header(self.cells)

    def ruled(self) -> bool:
        return all(not c.strip("-:= ") for c in self.cells)


#: For each mode the rules in order: what a line must be, and what then is done. Without a rule that holds nothing is done.
RULES = {
    "off": (
        (lambda x: _in_text(K.BOM_ANCHORS, x.text), "seek bom"),
        (lambda x: _in_text(K.LINE_ANCHORS, x.text), "seek line_list"),
        (lambda x: material_header(x.cells), "read bom"),
    ),
    "seek": ((lambda x: _in_text(K.BOM_KILL, x.text), "stop"), (Line.header, "read")),
    "read": (
        (lambda x: _in_text(K.BOM_KILL, x.text), "stop"),
        (lambda x: not x.cells, "blank"),
        (lambda x: revision_header(x.cells), "stop"),
        (lambda x: material_header(x.cells) or x.ruled(), "skip"),
        (lambda x: True, "take"),
    ),
}
#: Blank lines in a row that end a table.
BLANKS = 2


def is_noise(cells: list[str], words: tuple[str, ...] = K.NOISE_ROW) -> bool:
    """Blank rows, rows with a noise word, and rows of several equal cells."""
    return not cells or _in_text(words, " ".join(cells).upper()) or (len(cells) > 1 and len(set(cells)) == 1)


@dataclass
class Reader:
    """Holds the table being read and those that are done."""

    mode: str = "off"
    kind: str = ""
    headers: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)
    blanks: int = 0
    done: list[tuple[str, list[str], list[list[str]]]] = field(default_factory=list)

    def feed(self, text: str) -> None:
        line = Line(text.upper(), cells_of(text), self.kind)
        what = next((then for test, then in RULES[self.mode] if test(line)), "")
        self.blanks = self.blanks + 1 if what == "blank" else 0
        if what == "stop" or self.blanks >= BLANKS:
            self.stop()
        elif what == "take":
            self.rows.append(line.cells)
        elif what[:4] in ("seek", "read"):
            self.mode, _, kind = what.partition(" ")
            self.kind = kind or self.kind
            self.headers = line.cells if self.mode == "read" else []

    def stop(self) -> None:
        rows = [r for r in self.rows if not is_noise(r)]
        if rows:
            self.done.append((self.kind, self.headers, rows))
        self.mode, self.kind, self.headers, self.rows, self.blanks = "off", "", [], [], 0


def read_tables(text: str) -> list[tuple[str, int, list[str], list[list[str]]]]:
    """(kind, number, headers, rows) of the material tables and line lists of a text."""
    r = Reader()
    for line in text.split("\n"):
        r.feed(line)
    r.stop()
    return [(kind, i, headers, rows) for i, (kind, headers, rows) in enumerate(r.done)]


def tables_in_lines(text: Column) -> Column:
    """`read_tables` over a column, in Arrow batches; HTML rows are read as lines, null gives null."""

    @F.pandas_udf(RESULT)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"kind": k, "table_no": i, "headers": h, "rows": r} for k, i, h, r in read_tables(t)])

    return run(F.when(text.rlike("(?i)</t[dhr]"), sanitize_html(text)).otherwise(text))
