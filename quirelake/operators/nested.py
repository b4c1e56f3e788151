"""Deeply nested records as related flat tables with Merkle identities.

Every object is canonicalised and hashed bottom-up, so equal subtrees have
equal identities wherever they occur. Objects are stored once; each occurrence
is kept by a bridge row (parent, role, ordinal, child). A chain of bridge joins
from a file's root brings back every occurrence with its ordinals.

Roles: file -section-> section -table-> table -row-> row -cell-> cell -value-> value,
table -quality-> quality -warning-> warning, file -envelope-> object. Objects and
lists elsewhere hang on their owner as `member` (in order of their keys, which the
owner's body names) or `item`; sections, tables and rows of another type as `other`.
A node's body holds its scalars, so nothing of a payload is left out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import zip_longest
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.functions import payload as pl
from quirelake.plans.lineage import cut

RECORD = "what string, file_id bigint, hash binary, parent binary, role string, ord int, text string, body string"
#: Bridges that lead from a file to its rows and warnings.
LINKS = frozenset({"section", "table", "quality", "row", "warning"})
#: Identities remembered a task to leave out records that the task has already given.
SEEN = 200_000
#: Levels below an owner that are stored as nodes of their own; what lies deeper is one text in its node.
DEEPEST = 100


#: (role, ordinal, identity, text of the child if it is asked for by its parent)
Child = tuple[str, int, bytes, str | None]


def digest(kind: str, own: str, children: list[Child]) -> bytes:
    """Identity of a node: its kind, its own content, and its children in order."""
    parts = [kind.encode(), own.encode("utf-8", "surrogatepass")]
    for role, i, child, _ in children:
        parts.append(b"%s\x00%d\x00%s" % (role.encode(), i, child))
    return hashlib.blake2b(b"\x00".join(parts), digest_size=16).digest()


class _Store:
    """Collects the records of one payload; a subtree already given is not given again.

    With `roles` only bridges of these roles are given, and no nodes; the
    identities are the same.
    """

    def __init__(self, roles: frozenset[str] | None = None) -> None:
        self.out: list[tuple] = []
        self.seen: set[bytes] = set()
        self.cells: dict[tuple, bytes] = {}
        self.roles = roles

    def node(self, kind: str, text: str | None, body: str, children: list[Child]) -> bytes:
        # `text` is derived from the children or the body of the node
        h = digest(kind, body, children)
        if h not in self.seen:
            self.seen.add(h)
            if self.roles is None:
                self.out.append(("node", None, h, None, kind, None, text, body))
                self.out += [("edge", None, c, h, role, i, t, None) for role, i, c, t in children]
            else:
                self.out += [("edge", None, c, h, role, i, t, None) for role, i, c, t in children if role in self.roles]
        return h

    def forget(self) -> None:
        self.seen.clear()
        self.cells.clear()

    def members(self, d: dict, skip: tuple[str, ...] = (), depth: int = 0) -> tuple[list, list[Child]]:
        """[scalars, keys of nested members] of an object, and the bridges to the nested members."""
        inner = sorted(k for k, v in d.items() if k not in skip and isinstance(v, (dict, list)))
        own = {k: v for k, v in d.items() if k not in skip and not isinstance(v, (dict, list))}
        return [own, inner], [("member", i, self.value(d[k], depth=depth + 1), None) for i, k in enumerate(inner)]

    def value(self, v: Any, kind: str | None = None, text: str | None = None, depth: int = 0) -> bytes:
        """A node of any JSON value; `kind` is object, list or scalar if not given."""
        if depth > DEEPEST:
            return self.node(kind or "scalar", text, pl.canonical(["deep", v]), [])
        if isinstance(v, dict):
            own, kids = self.members(v, depth=depth)
            return self.node(kind or "object", text, pl.canonical(["object", *own]), kids)
        if isinstance(v, list):
            kids = [("item", i, self.value(x, depth=depth + 1), None) for i, x in enumerate(v)]
            return self.node(kind or "list", text, pl.canonical(["list"]), kids)
        return self.node(kind or "scalar", text, pl.canonical(["scalar", v]), [])

    def cell(self, h: str | None, v: Any) -> bytes:
        if isinstance(v, (dict, list)):
            return self.node("cell", pl.text_of(v), pl.canonical([h]), [("value", 0, self.value(v), None)])
        key = (h, type(v), repr(v) if isinstance(v, float) else v)
        known = self.cells.get(key)
        if known is None:
            known = self.cells[key] = self.node("cell", pl.text_of(v), pl.canonical([h, v]), [])
        return known

    def quality(self, q: Any) -> bytes:
        codes = dict(pl.warning_entries({"quality": q}))
        top = q
        if isinstance(q, str):
            try:
                top = json.loads(q)
            except ValueError:
                pass
        if not isinstance(top, dict):
            return self.value(q, "quality")
        own, kids = self.members(top, ("warnings",))
        w = top.get("warnings")
        each = w if isinstance(w, list) else [w] if "warnings" in top else []
        kids += [("warning", i, self.value(x, "warning", codes.get(i)), codes.get(i)) for i, x in enumerate(each)]
        form = "list" if isinstance(w, list) else "lone" if each else "none"
        return self.node("quality", None, pl.canonical([q if isinstance(q, str) else None, form, *own]), kids)

    def table(self, t: dict) -> bytes:
        headers, rows = pl.table_grid(t)
        names = [pl.text_of(x) or "" for x in headers]
        array = not isinstance(t.get("headers"), list) and isinstance(t.get("array"), list) and bool(t["array"]) and isinstance(t["array"][0], list)
        read = ("array",) if array else tuple(k for k in ("headers", "rows") if isinstance(t.get(k), list))
        own, kids = self.members(t, (*read, "quality"))
        for i, r in enumerate(rows):
            if not isinstance(r, (dict, list)):
                kids.append(("other", i, self.value(r), None))
                continue
            pairs = list(r.items()) if isinstance(r, dict) else list(zip_longest(names[: len(r)], r))
            cells = [("cell", k, self.cell(h, v), None) for k, (h, v) in enumerate(pairs)]
            d = pl.cell(r, names, "DESCRIPTION")
            text = None if pl.is_empty(d) else pl.text_of(d)
            kids.append(("row", i, self.node("row", text, "", cells), text))
        if "quality" in t:
            kids.append(("quality", 0, self.quality(t["quality"]), None))
        return self.node("table", pl.text_of(t.get("table_id")), pl.canonical([*own, list(read), headers]), kids)

    def section(self, s: dict) -> bytes:
        listed = isinstance(s.get("tables"), list)
        own, kids = self.members(s, ("tables",) if listed else ())
        kids += [("table", i, self.table(t), None) if isinstance(t, dict) else ("other", i, self.value(t), None) for i, t in enumerate(pl.section_tables(s))]
        return self.node("section", pl.text_of(s.get("section_id")), pl.canonical([*own, listed]), kids)

    def file(self, file_id: int, payload: str | None) -> None:
        top = pl.parse_top(payload)
        secs = pl.sections_of(top)
        if secs is None:
            return
        kids = [("section", i, self.section(s), None) if isinstance(s, dict) else ("other", i, self.value(s), None) for i, s in enumerate(secs)]
        form = "list" if isinstance(top, list) else "sections" if "sections" in top else "section"
        if form == "sections":
            kids.append(("envelope", 0, self.value({k: v for k, v in top.items() if k != "sections"}), None))
        self.out.append(("root", file_id, self.node("file", None, form, kids), None, None, None, None, None))


def _records(roles: frozenset[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = _Store(roles)
        for pdf in batches:
            for fid, text in zip(pdf["file_id"], pdf["payload"]):
                store.file(fid, text)
                if len(store.seen) > SEEN:
                    store.forget()
            yield pd.DataFrame(store.out, columns=[c.split()[0] for c in RECORD.split(", ")])
            store.out = []

    return run


class MerkleStore:
    """The flat tables of one input.

    roots: file_id, hash. nodes: hash, kind, text, body (each object once).
    bridges: parent, role, ord, child (each occurrence below a stored object), and
    the text of a row or warning, so that a child that half of all tables share is
    not looked up in one place.
    """

    def __init__(self, records: DataFrame) -> None:
        self.roots = records.filter("what = 'root'").select("file_id", "hash").distinct()
        self.nodes = records.filter("what = 'node'").groupBy("hash").agg(F.first("role").alias("kind"), F.first("text").alias("text"), F.first("body").alias("body"))
        self.bridges = records.filter("what = 'edge'").select("parent", "role", "ord", F.col("hash").alias("child"), "text").distinct()

    def step(self, at: DataFrame, hash_col: str, role: str, ord_col: str, child_col: str) -> DataFrame:
        """`at` with the occurrences below `hash_col` by `role`."""
        b = self.bridges.filter(F.col("role") == role).select(F.col("parent").alias(hash_col), F.col("ord").alias(ord_col), F.col("child").alias(child_col))
        return at.join(b, hash_col)


def shred(files: DataFrame, roles: frozenset[str] | None = None) -> MerkleStore:
    """Parse every payload once into the Merkle tables, kept in the checkpoint folder.

    `roles` names the bridges that are wanted; then no nodes are stored.

    Rows without a file_id and unreadable payloads give nothing; repeated rows
    are stored once; an empty input gives empty tables.
    """
    rec = files.filter("file_id is not null and payload is not null").select("file_id", "payload").mapInPandas(_records(roles), RECORD)
    return MerkleStore(cut(rec))


def table_occurrences(store: MerkleStore) -> DataFrame:
    """(file_id, section_ord, table_ord, section_hash, table_hash)."""
    s = store.step(store.roots.withColumnRenamed("hash", "file_hash"), "file_hash", "section", "section_ord", "section_hash")
    return store.step(s, "section_hash", "table", "table_ord", "table_hash").select("file_id", "section_ord", "table_ord", "section_hash", "table_hash")


def linked_children(files: DataFrame) -> DataFrame:
    """(file_id, section_ord, table_ord, child, child_ord, child_value).

    child `row` carries a non-empty DESCRIPTION, child `warning` a code. Only the
    bridges that lead there are stored.
    """
    store = shred(files, LINKS)
    kids = store.bridges.filter("role in ('row', 'warning') and text is not null").select("parent", F.col("role").alias("child"), F.col("ord").alias("child_ord"), F.col("text").alias("child_value"))
    held = store.bridges.filter("role = 'quality'").select(F.col("parent").alias("table_hash"), F.col("child").alias("parent"))
    warned = kids.filter("child = 'warning'").join(held, "parent").select("table_hash", "child", "child_ord", "child_value")
    kids = kids.filter("child = 'row'").select(F.col("parent").alias("table_hash"), "child", "child_ord", "child_value").unionByName(warned)
    return table_occurrences(store).join(kids, "table_hash").select("file_id", "section_ord", "table_ord", "child", "child_ord", "child_value")


def identity_report(files: DataFrame) -> DataFrame:
    """(kind, objects, occurrences): stored objects and bridge rows that lead to them."""
    store = shred(files)
    refs = store.bridges.groupBy(F.col("child").alias("hash")).agg(F.count(F.lit(1)).alias("n"))
    return store.nodes.join(refs, "hash", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("n"), F.lit(0)).alias("bridges"))
