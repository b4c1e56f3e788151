"""Schemas that drift between the files of a series.

Every file is parsed once into one compact profile row a table: its columns and
the fields of the objects and lists in them, the kinds of their non-empty values,
and the 64-bit hashes of those values. A profile is joined with that of the same
table in the series' preceding file and one tree edit script is computed a pair. Only (series, date, id) rows are ever
ordered, in month buckets, so a series that holds a third of all files is not
sorted in one task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import payload as pl
from quirelake.functions.treedit import Node, edit_script
from quirelake.plans.lineage import cut
from quirelake.plans.order import bucketed_lag

COLUMN = "struct<path: array<string>, kinds: array<string>, hashes: array<bigint>>"
PROFILE = f"file_id bigint, table_id string, occurrence int, cols array<{COLUMN}>"
CELL = "file_id bigint, table_id string, occurrence int, row_ord int, header string, value string"
SCRIPT = "file_id bigint, series string, table_id string, change string, old_path array<string>, new_path array<string>"
#: The path step of a list's items.
ITEMS = "[]"
#: Steps of a path; what lies deeper is one value.
DEEPEST = 100


def _hash(value) -> int:
    if isinstance(value, (dict, list)):
        return _digest(pl.canonical(value))
    if isinstance(value, str) and len(value) > 200:
        return _scalar_hash.__wrapped__(str, value)  # long texts are not remembered
    return _scalar_hash(type(value), value)


@lru_cache(maxsize=1 << 16)
def _scalar_hash(_, value) -> int:
    """Numbers, and texts that read as numbers, hash alike; values of a column return file after file."""
    kind = pl.kind_of(value)
    text = pl.text_of(value).strip()
    if kind in ("number", "text"):
        plain = text.replace(",", "")
        try:
            text = repr(float(plain)) if plain and plain[0] in "0123456789-+." else text
        except ValueError:
            pass
    return _digest(text)


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _visit(path: tuple[str, ...], value, at: dict[tuple, dict]) -> None:
    c = at.setdefault(path, {"path": path, "kinds": set(), "hashes": []})
    if pl.is_empty(value):
        return
    c["kinds"].add(pl.kind_of(value))
    c["hashes"].append(_hash(value))
    if len(path) < DEEPEST:
        if isinstance(value, dict):
            for k, v in value.items():
                _visit((*path, k), v, at)
        elif isinstance(value, list):
            for v in value:
                _visit((*path, ITEMS), v, at)


def profile_columns(headers: list, rows: list) -> list[dict]:
    """Columns and the fields nested in them, in order of first appearance; a repeated header is one column."""
    at: dict[tuple, dict] = {}
    for i, h in enumerate(headers):
        h = pl.text_of(h)
        if h is None:
            continue
        own = at.setdefault((h,), {"path": (h,), "kinds": set(), "hashes": []})
        for r in rows:
            v = r.get(h) if isinstance(r, dict) else (r[i] if isinstance(r, list) and i < len(r) else None)
            if isinstance(v, (dict, list)):
                _visit((h,), v, at)
            elif not pl.is_empty(v):
                own["kinds"].add(pl.kind_of(v))
                own["hashes"].append(_hash(v))
    return [{"path": list(c["path"]), "kinds": sorted(c["kinds"]), "hashes": c["hashes"]} for c in at.values()]


def _tables(payload: str | None) -> Iterator[tuple[str | None, int, dict]]:
    """(table_id, how many tables of that id stand before it, table) of a payload."""
    seen: Counter = Counter()
    for s in pl.parse_sections(payload) or []:
        for t in pl.section_tables(s):
            if isinstance(t, dict):
                name = pl.text_of(t.get("table_id"))
                yield name, seen[name], t
                seen[name] += 1


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for fid, text in zip(pdf["file_id"], pdf["payload"]):
            for name, k, t in _tables(text):
                out.append((fid, name, k, profile_columns(*pl.table_grid(t))))
        yield pd.DataFrame(out, columns=["file_id", "table_id", "occurrence", "cols"])


def column_key(path: tuple[str, ...]) -> str:
    """A header as it stands; a nested field as /header/field, slashes inside of a step as ~1."""
    escaped = [p.replace("~", "~0").replace("/", "~1") for p in path]
    return "/" + "/".join(escaped) if len(path) > 1 else escaped[0] if path[0][:1] in ("/", "~") else path[0]


def _leaves(path: tuple[str, ...], value) -> Iterator[tuple[str, str]]:
    """(column key, text) of the non-empty fields of a cell; a list is one value."""
    if isinstance(value, dict) and value and len(path) < DEEPEST:
        for k, v in value.items():
            yield from _leaves((*path, k), v)
    elif not pl.is_empty(value):
        yield column_key(path), pl.text_of(value)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for fid, text in zip(pdf["file_id"], pdf["payload"]):
            for name, n, t in _tables(text):
                headers, rows = pl.table_grid(t)
                names = [pl.text_of(h) for h in headers]
                for k, r in enumerate(rows):
                    if isinstance(r, dict):
                        items = ((h, v) for h, v in r.items())
                    else:
                        # a cell without a header goes by its position
                        items = (((names[i] if i < len(names) else None) or f"/{i}", v) for i, v in enumerate(r)) if isinstance(r, list) else ()
                    out += [(fid, name, n, k, key, x) for h, v in items for key, x in _leaves((h,), v)]
        yield pd.DataFrame(out, columns=["file_id", "table_id", "occurrence", "row_ord", "header", "value"])


def table_profiles(files: DataFrame) -> DataFrame:
    """(file_id, table_id, occurrence, cols), each table once.

    Rows without a file_id are left out; an unreadable payload, or a table
    without table_id, gives no profile. Tables of one id in one file are told
    apart by `occurrence`, their order from 0. Of rows of one file_id that differ
    the profile with more columns stands.
    """
    p = files.filter("file_id is not null").select("file_id", "payload").mapInPandas(_profiles, PROFILE)
    p = p.filter("table_id is not null")
    return p.groupBy("file_id", "table_id", "occurrence").agg(F.max_by("cols", F.struct(F.size("cols"), F.xxhash64("cols"))).alias("cols"))


def file_sequence(files: DataFrame) -> DataFrame:
    """(file_id, series, export_date, prev_file_id) of each file with a series and a date."""
    ids = files.filter("file_id is not null and series is not null and export_date is not null").select("file_id", "series", "export_date").distinct()
    return bucketed_lag(ids, ["series"], F.substring("export_date", 1, 7), ["export_date", "file_id"], "file_id", "prev_file_id")


def _tree(cols) -> Node:
    root = Node("table")
    at = {(): root}
    for c in sorted(cols, key=lambda c: len(c["path"])):
        path = tuple(c["path"])
        at[path] = Node(path[-1], frozenset(c["kinds"]), Counter(list(c["hashes"])))
        at[path[:-1]].children.append(at[path])
    return root


def table_script(old, new) -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """(change, old path, new path) between two column lists.

    Besides added, removed, renamed, retyped and moved there is `kept` for a field
    whose path differs because something above it was renamed.
    """
    names = {"add": "added", "delete": "removed", "rename": "renamed", "retype": "retyped", "move": "moved"}
    mapped: list[tuple] = []
    script = [(names[e.op], e.old, e.new) for e in edit_script(_tree(old), _tree(new), mapped)[1]]
    told = {(a, b) for _, a, b in script}
    return script + [("kept", a, b) for a, b in mapped if a != b and (a, b) not in told]


def _scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            out += [(row.file_id, row.series, row.table_id, c, list(a), list(b)) for c, a, b in table_script(row.old_cols, row.cols)]
        yield pd.DataFrame(out, columns=["file_id", "series", "table_id", "change", "old_path", "new_path"])


def schema_scripts(files: DataFrame) -> DataFrame:
    """(file_id, series, table_id, change, old_path, new_path) of each later file, nested fields too.

    A table that the preceding file lacks is compared with nothing. Files
    without a series or date have no place in the order. An empty input gives
    no row. Equal column lists are dropped before the script is computed.
    """
    prof = cut(table_profiles(files))
    seq = file_sequence(files)
    new = prof.join(seq.filter("prev_file_id is not null").select("file_id", "series", "prev_file_id"), "file_id")
    old = prof.select(F.col("file_id").alias("prev_file_id"), "table_id", "occurrence", F.col("cols").alias("old_cols"))
    names = lambda c: F.array_sort(F.transform(c, lambda x: F.struct(x["path"], x["kinds"])))
    pairs = new.join(old, ["prev_file_id", "table_id", "occurrence"]).filter(names("cols") != names("old_cols"))
    return pairs.select("file_id", "series", "table_id", "cols", "old_cols").mapInPandas(_scripts, SCRIPT)


def schema_changes(files: DataFrame) -> DataFrame:
    """(file_id, series, table_id, change, old_header, new_header): the changes of the headers.

    A header that moved into or out of a nested object is removed or added.
    """
    at = lambda p: F.when(F.size(p) == 1, F.col(p)[0]).otherwise("")
    top = schema_scripts(files).filter("change <> 'kept' and (size(old_path) = 1 or size(new_path) = 1)")
    change = F.when((F.col("change") == "moved"), F.when(F.size("old_path") == 1, "removed").otherwise("added")).otherwise(F.col("change"))
    return top.select("file_id", "series", "table_id", change.alias("change"), at("old_path").alias("old_header"), at("new_path").alias("new_header"))


def field_changes(files: DataFrame) -> DataFrame:
    """(file_id, series, table_id, change, old_field, new_field) of headers and nested fields, moves too.

    A field is given by its path, the steps joined with ` > `; items of a list
    are the step `[]`.
    """
    s = schema_scripts(files).filter("change <> 'kept'")
    return s.select("file_id", "series", "table_id", "change", F.array_join("old_path", " > ").alias("old_field"), F.array_join("new_path", " > ").alias("new_field"))


def column_names(scripts: DataFrame) -> DataFrame:
    """(series, table_id, header, column): one name for all columns and nested fields tied by renames and moves.

    The edges of one table's headers are few (distinct names, not files), but a
    chain of renames may be long: labels are lowered by pointer doubling until
    they no longer change, with lineage cut every round. The least header of a
    chain is its name.
    """
    esc = lambda x: F.replace(F.replace(x, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    key_of = lambda p: F.when(F.size(p) > 1, F.concat(F.lit("/"), F.array_join(F.transform(p, esc), "/"))).when(F.col(p)[0].rlike("^[/~]"), esc(F.col(p)[0])).otherwise(F.col(p)[0])
    e = scripts.filter("change in ('renamed', 'moved', 'kept')").filter(~F.array_contains("old_path", ITEMS) & ~F.array_contains("new_path", ITEMS)).select("series", "table_id", key_of("old_path").alias("a"), key_of("new_path").alias("b"))
    e = e.unionByName(e.select("series", "table_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    key = ["series", "table_id"]
    e = cut(e)
    label = cut(e.select(*key, "a").distinct().withColumn("l", F.col("a")))
    while True:
        near = e.join(label.withColumnRenamed("a", "b"), [*key, "b"]).groupBy(*key, "a").agg(F.min("l").alias("n"))
        step = label.join(near, [*key, "a"], "left").select(*key, "a", "l", F.least("l", "n").alias("m"))
        via = step.select(*key, F.col("a").alias("m"), F.col("m").alias("mm"))
        step = cut(step.join(via, [*key, "m"], "left").select(*key, "a", "l", F.least("m", "mm").alias("n")))
        label = step.select(*key, "a", F.col("n").alias("l"))
        if step.filter("l <> n").limit(1).count() == 0:
            break
    return label.select(*key, F.col("a").alias("header"), F.col("l").alias("column"))


def unified_rows(files: DataFrame) -> DataFrame:
    """All cells of all files under one consistent set of columns a table.

    (series, table_id, file_id, occurrence, export_date, row_ord, column, header, value):
    the scripts compiled into one projection header -> column, applied to every
    file; empty cells are left out. Fields of objects are columns of their own
    (see column_key), lists are JSON text, cells beyond the headers go by their
    position (/15). Two headers of one row that lead to one column keep their own names.
    """
    cells = files.filter("file_id is not null").select("file_id", "payload").mapInPandas(_cells, CELL).filter("table_id is not null").distinct()
    seq = files.filter("file_id is not null").select("file_id", "series", "export_date").distinct()
    names = column_names(cut(schema_scripts(files)))
    rows = cells.join(seq, "file_id").join(names, ["series", "table_id", "header"], "left").withColumn("column", F.coalesce("column", "header"))
    own = ["file_id", "table_id", "occurrence", "row_ord"]
    clash = rows.groupBy(*own, "column").agg(F.count_distinct("header").alias("_n")).filter("_n > 1").select(*own, "column", F.lit(True).alias("_clash"))
    rows = rows.join(clash, [*own, "column"], "left")
    return rows.select("series", "table_id", "file_id", "occurrence", "export_date", "row_ord", F.when(F.col("_clash"), F.col("header")).otherwise(F.col("column")).alias("column"), "header", "value")


def projected(cells: DataFrame, columns: list[str]) -> DataFrame:
    """The unified cells of one table as a wide table with the given columns."""
    keys = ["series", "table_id", "file_id", "occurrence", "export_date", "row_ord"]
    return cells.groupBy(*keys).pivot("column", columns).agg(F.max("value"))
