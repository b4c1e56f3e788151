"""Reading exported JSON payloads whose envelopes and table forms vary."""

from __future__ import annotations

import json
from typing import Any


def parse_top(payload: str | None) -> Any:
    """The JSON value of one payload, None where it is unreadable. A leading byte-order mark is ignored."""
    if payload is None:
        return None
    try:
        return json.loads(payload.lstrip("﻿ \t\r\n"))
    except (ValueError, RecursionError):
        return None


def sections_of(top: Any) -> list[Any] | None:
    """The sections of a parsed payload, or None where it holds none.

    Accepted envelopes: a list of sections, an object with `sections`, or one
    section by itself.
    """
    if isinstance(top, list):
        return top
    if isinstance(top, dict):
        if "sections" in top:
            return top["sections"] if isinstance(top["sections"], list) else None
        if "tables" in top or "section_id" in top:
            return [top]
    return None


def parse_sections(payload: str | None) -> list[Any] | None:
    """The list of sections of one payload, or None where it holds none, see sections_of."""
    return sections_of(parse_top(payload))


def section_tables(section: Any) -> list[Any]:
    tables = section.get("tables") if isinstance(section, dict) else None
    return tables if isinstance(tables, list) else []


def table_grid(table: Any) -> tuple[list[Any], list[Any]]:
    """(headers, data rows) of a table in `headers`/`rows` or in `array` form."""
    if not isinstance(table, dict):
        return [], []
    array = table.get("array")
    if not isinstance(table.get("headers"), list) and isinstance(array, list) and array:
        head = array[0] if isinstance(array[0], list) else []
        return head, array[1:]
    headers, rows = table.get("headers"), table.get("rows")
    return headers if isinstance(headers, list) else [], rows if isinstance(rows, list) else []


def cell(row: Any, headers: list[Any], header: str) -> Any:
    """The value under `header` in an object row or a positional row."""
    if isinstance(row, dict):
        return row.get(header)
    if isinstance(row, list) and header in headers:
        i = headers.index(header)
        return row[i] if i < len(row) else None
    return None


def text_of(value: Any) -> str | None:
    """A scalar as text, nested values as canonical JSON; None stays None."""
    if value is None or isinstance(value, str):
        return value
    return canonical(value)


def canonical(value: Any) -> str:
    """JSON text that equal values share: sorted keys, no blanks."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def is_empty(value: Any) -> bool:
    return value is None or value == ""


def kind_of(value: Any) -> str:
    """number, text, list or object."""
    if isinstance(value, bool):
        return "text"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, list):
        return "list"
    if isinstance(value, dict):
        return "object"
    return "text"


def warning_entries(table: Any) -> list[tuple[int, str]]:
    """(position, code) of each entry of quality.warnings, however it is written.

    `quality` may be an object or its JSON text; `warnings` a list, a lone text
    or object, or absent. An entry is a text or an object with `code`.
    """
    q = table.get("quality") if isinstance(table, dict) else None
    if isinstance(q, str):
        try:
            q = json.loads(q)
        except ValueError:
            return []
    w = q.get("warnings") if isinstance(q, dict) else None
    out = []
    for i, x in enumerate(w if isinstance(w, list) else [w]):
        code = x.get("code") if isinstance(x, dict) else x
        if isinstance(code, str) and code:
            out.append((i, code))
    return out
