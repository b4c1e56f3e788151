"""The core's operators for drift, rolling totals and nested records."""

import itertools
import json
import random
from collections import Counter
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirelake.functions import payload as pl
from quirelake.functions.treedit import Node, assign, edit_script
from quirelake.operators import drift, nested, rolling
from quirelake.plans.order import bucketed_lag, bucketed_prefix_sum

FILE = "file_id bigint, series string, source_file string, export_date string, payload string, cols string"


def files(spark, rows):
    return spark.createDataFrame([(i, s, "f", d, p if p is None or isinstance(p, str) else json.dumps(p, ensure_ascii=False), "x") for i, s, d, p in rows], FILE)


def doc(*tables):
    return [{"section_id": "S", "tables": list(tables)}]


def tab(headers, rows, **more):
    return {"table_id": "T", "headers": headers, "rows": [dict(zip(headers, r)) for r in rows], **more}


def changes(spark, rows):
    return {tuple(r) for r in drift.schema_changes(files(spark, rows)).select("file_id", "table_id", "change", "old_header", "new_header").collect()}


def test_assignment_is_minimal():
    rng = random.Random(1)
    for n in (1, 2, 3, 5):
        cost = [[rng.random() for _ in range(n)] for _ in range(n)]
        got = sum(cost[i][j] for i, j in enumerate(assign(cost)))
        assert got == pytest.approx(min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n))))


def test_edit_script_moves_and_nested_renames():
    v = Counter([1, 2, 3])
    a = Node("r", children=[Node("a", children=[Node("x", frozenset(["text"]), v)]), Node("b")])
    b = Node("r", children=[Node("a"), Node("b", children=[Node("x", frozenset(["text"]), v)])])
    assert [(e.op, e.old, e.new) for e in edit_script(a, b)[1]] == [("move", ("a", "x"), ("b", "x"))]
    c = Node("r", children=[Node("a", children=[Node("y", frozenset(["text"]), v)]), Node("b")])
    assert [(e.op, e.old, e.new) for e in edit_script(a, c)[1]] == [("rename", ("a", "x"), ("a", "y"))]
    assert edit_script(a, a) == (0.0, [])


def test_changes_of_each_kind(spark):
    one = doc(tab(["A", "B", "C"], [[1, "u", "p"], [2, "v", "q"], [3, "w", "r"]]))
    two = doc(tab(["C", "A", "Bee", "N"], [["p", "1", "u", 7], ["q", "2", "v", 8], [None, "3", "w", ""]]))
    arr = [{"section_id": "S", "tables": [{"table_id": "T", "array": [["C", "A", "N"], ["p", [1], 7]]}]}]
    got = changes(spark, [(1, "s", "2025-01-31", one), (2, "s", "2025-02-01", two), (2, "s", "2025-02-01", two), (3, "s", "2025-03-01", "﻿" + json.dumps(arr)), (9, "t", "2025-02-01", two)])
    assert got == {
        (2, "T", "renamed", "B", "Bee"),
        (2, "T", "added", "", "N"),
        (2, "T", "retyped", "A", "A"),
        (3, "T", "removed", "Bee", ""),
        (3, "T", "retyped", "A", "A"),
    }


def test_drift_of_odd_files(spark):
    one = doc(tab(["A"], [[1]]))
    rows = [(1, "s", "2025-01-01", one), (2, "s", "2025-02-01", "{bad"), (3, "s", "2025-03-01", one), (None, "s", "2025-04-01", one), (4, None, "2025-05-01", one), (5, "s", None, one), (6, "s", "2025-06-01", None), (7, "s", "2025-07-01", doc({"table_id": None, "headers": None}, 5, None))]
    assert changes(spark, rows) == set()
    assert changes(spark, []) == set()


def test_unified_rows_follow_renames(spark):
    a = doc(tab(["A", "K"], [[1, "x"], [2, "y"]]))
    b = doc(tab(["B", "K"], [[1, "x"], [2, "y"]]))
    c = doc(tab(["C", "K"], [[1, "x"], [2, "y"]]))
    u = drift.unified_rows(files(spark, [(1, "s", "2025-01-01", a), (2, "s", "2025-02-01", b), (3, "s", "2025-03-01", c)]))
    assert {(r.file_id, r.column, r.header) for r in u.collect() if r.value == "1"} == {(1, "A", "A"), (2, "A", "B"), (3, "A", "C")}
    wide = drift.projected(u, ["A", "K"]).collect()
    assert {(r.file_id, r.A, r.K) for r in wide} == {(f, v, k) for f in (1, 2, 3) for v, k in (("1", "x"), ("2", "y"))}


def cell_docs():
    """Three files: a field renamed inside an object, the object renamed, a field moved out to a column."""
    a = doc(tab(["A", "P"], [["x", {"unit": "m", "value": 1}], ["y", {"unit": "kg", "value": 2}], ["z", {"unit": "t", "value": 3}]]))
    b = doc(tab(["A", "P"], [["x", {"uom": "m", "value": 1}], ["y", {"uom": "kg", "value": 2}], ["z", {"uom": "t", "value": 3}]]))
    c = doc(tab(["A", "Q"], [["x", {"uom": "m", "value": 1}], ["y", {"uom": "kg", "value": 2}], ["z", {"uom": "t", "value": 3}]]))
    d = doc(tab(["A", "Q", "uom"], [["x", {"value": 1}, "m"], ["y", {"value": 2}, "kg"], ["z", {"value": 3}, "t"]]))
    return [(i + 1, "s", f"2025-0{i + 1}-01", x) for i, x in enumerate((a, b, c, d))]


def test_nested_renames_and_moves(spark):
    f = files(spark, cell_docs())
    got = {(r.file_id, r.change, r.old_field, r.new_field) for r in drift.field_changes(f).collect()}
    assert got == {(2, "renamed", "P > unit", "P > uom"), (3, "renamed", "P", "Q"), (4, "moved", "Q > uom", "uom")}
    assert changes(spark, cell_docs()) == {(3, "T", "renamed", "P", "Q"), (4, "T", "added", "", "uom")}
    u = drift.unified_rows(f).collect()
    assert {r.column for r in u if r.value in ("m", "kg", "t")} == {"/P/unit"} and {r.column for r in u if r.value == "3"} == {"/P/value"}
    assert len(u) == 4 * 9


def test_tables_of_one_id_and_cells_beyond_headers(spark):
    two = doc(tab(["A"], [[1]]), tab(["B"], [[2]]), {"table_id": "T", "headers": ["/x", "y/z"], "rows": [["p", {"q": [1]}, "more", {"k": 5}]]})
    u = drift.unified_rows(files(spark, [(1, "s", "2025-01-01", two), (1, "s", "2025-01-01", two)])).collect()
    assert {(r.occurrence, r.column, r.value) for r in u} == {(0, "A", "1"), (1, "B", "2"), (2, "~1x", "p"), (2, "/y~1z/q", "[1]"), (2, "~12", "more"), (2, "/~13/k", "5")}
    assert changes(spark, [(1, "s", "2025-01-01", two), (2, "s", "2025-02-01", two)]) == set()


def test_long_chain_of_renames(spark):
    rows = [(i, "s", f"2025-{i // 28 + 1:02d}-{i % 28 + 1:02d}", doc(tab([f"H{i:02d}"], [[7], [8]]))) for i in range(70)]
    u = drift.unified_rows(files(spark, rows)).collect()
    assert {r.column for r in u} == {"H00"} and len(u) == 140


EVENT = "id bigint, timestamp string, job_id string, engine string, total_tokens bigint, estimated_cost_usd double, entity string"


def brute_rolling(rows, n):
    seen, leaf = set(), {}
    for i, ts, _, eng, tok, *_ in rows:
        if i in seen or eng is None or ts is None:
            continue
        seen.add(i)
        d = pd.Timestamp(ts.strip()[:10])
        leaf.setdefault(eng.strip().lower(), {}).setdefault(d, 0)
        leaf[eng.strip().lower()][d] += tok or 0
    return {(e, d.strftime("%Y-%m-%d")): sum(v for k, v in days.items() if d - pd.Timedelta(days=n - 1) <= k <= d) for e, days in leaf.items() for d in pd.date_range(min(days), max(days))}


def test_rolling_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, (pd.Timestamp("2024-11-20") + pd.Timedelta(days=int(rng.expovariate(0.02)))).strftime("%Y-%m-%dT10:00:00+09:00"), "j", rng.choice(["a", " A", "b "]), rng.choice([None, 5, 11]), None, "clash") for i in range(300)]
    rows += rows[:20] + [(900, None, "j", "a", 5, 0.1, "x"), (901, "2025-01-01", "j", None, 5, 0.1, "x"), (902, "nonsense", "j", "a", 5, 0.1, "x")]
    got = rolling.usage_rolling(spark.createDataFrame(rows, EVENT)).collect()
    for n in (7, 30):
        assert {(r.engine, r.usage_day): r[f"tokens_{n}"] for r in got} == brute_rolling(rows[:320], n)
    assert rolling.usage_bursts(spark.createDataFrame([], EVENT)).collect() == []


def test_compact_and_spaced_timestamps(spark):
    rows = [(1, " 20250102T101010+0900", "j", "e", 4, 0.5, ""), (2, "2025-01-03 10:10:10+09:00", "j", "e", 6, 0.5, "")]
    got = {r.usage_day: (r.tokens_7, r.cost_usd_7) for r in rolling.usage_rolling(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"2025-01-02": (4, 0.5), "2025-01-03": (10, 1.0)}


def test_late_correction_touches_ancestors_only(spark):
    leaf = "entity string, day int, calls bigint, tokens bigint, cost decimal(28,10)"
    tree = rolling.build_tree(spark.createDataFrame([("e", d, 1, d, Decimal(0)) for d in range(100, 140)], leaf))
    fixed = rolling.correct_tree(tree, spark.createDataFrame([("e", 120, 0, 1000, Decimal(0))], leaf))
    key = lambda df: {(r.level, r.idx): r.tokens for r in df.collect()}
    a, b = key(tree), key(fixed)
    assert {k for k in a if a[k] != b[k]} == {(k, 120 >> k) for k in range(rolling.TOP_LEVEL + 1)}


def test_nested_children_and_identities(spark):
    t1 = {"table_id": "T", "headers": ["DESCRIPTION", "N"], "rows": [{"DESCRIPTION": "a", "N": 1}, {"N": 2}, {"DESCRIPTION": "", "N": 3}, ["b", 4]], "quality": {"warnings": ["w1", {"code": "w2"}, None]}}
    t2 = {"table_id": "U", "array": [["N", "DESCRIPTION"], [1, "c"], [2]], "quality": '{"warnings": "lone"}'}
    bare = {"section_id": "X", "tables": [t1]}
    rows = [(1, "s", "d", [{"tables": None}, {"tables": [t1, t2]}]), (1, "s", "d", [{"tables": None}, {"tables": [t1, t2]}]), (2, "s", "d", {"metadata": 1, "sections": [bare, 7]}), (3, "s", "d", bare), (4, "s", "d", "{"), (None, "s", "d", bare), (5, None, None, None)]
    got = {tuple(r) for r in nested.linked_children(files(spark, rows)).collect()}
    of_t1 = lambda f, s: {(f, s, 0, "row", 0, "a"), (f, s, 0, "row", 3, "b"), (f, s, 0, "warning", 0, "w1"), (f, s, 0, "warning", 1, "w2")}
    assert got == of_t1(1, 1) | {(1, 1, 1, "row", 0, "c"), (1, 1, 1, "warning", 0, "lone")} | of_t1(2, 0) | of_t1(3, 0)
    n = {r.kind: r.objects for r in nested.identity_report(files(spark, rows)).collect()}
    assert n["table"] == 2 and n["row"] == 5  # {"N": 2} occurs in both tables
    assert nested.linked_children(files(spark, [])).collect() == []


def test_nested_store_keeps_whole_objects(spark):
    def payload(status="ok", row=1, unit="m", meta="a"):
        t = {"table_id": "T", "headers": ["N"], "rows": [[{"value": 1, "unit": unit}, "beyond"]], "quality": {"status": status, "warnings": [{"code": "w", "row": row}, {"row": 9}]}}
        return {"metadata": {"by": meta}, "sections": [{"section_id": "S", "tables": [t, 5]}]}

    plain, other = payload(), [payload(status="bad"), payload(row=2), payload(unit="kg"), payload(meta="b")]
    rows = [(i, "s", "d", p) for i, p in enumerate([plain, plain, *other])]
    store = nested.shred(files(spark, rows))
    roots = {r.file_id: bytes(r.hash) for r in store.roots.collect()}
    assert roots[0] == roots[1] and len(set(roots.values())) == 5
    n = {r.kind: r.objects for r in nested.identity_report(files(spark, rows)).collect()}
    assert n["warning"] == 3 and n["quality"] == 3 and n["table"] == 4 and n["file"] == 5
    bodies = " ".join(r.body for r in store.nodes.collect())
    assert all(x in bodies for x in ('"status":"bad"', '"row":2', '"row":9', '"unit":"kg"', '"by":"b"', "beyond"))


def test_nested_store_of_a_deep_cell():
    store = nested._Store()
    store.file(1, '[{"section_id": "S", "tables": [{"table_id": "T", "headers": ["N"], "rows": [[' + "[" * 700 + "7" + "]" * 700 + "]]}]}]")
    assert store.out[-1][0] == "root" and any("7" in (r[7] or "") for r in store.out)


def test_payload_parsing():
    assert pl.parse_sections("\ufeff[]") == [] and pl.parse_sections("3") is None and pl.parse_sections('{"a": 1}') is None
    assert pl.kind_of(True) == "text" and pl.kind_of(1.5) == "number" and pl.kind_of({}) == "object"


def test_bucketed_order_equals_plain_window(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.randrange(50)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    lag = {(r.k, r.i): r.p for r in bucketed_lag(df, ["k"], F.floor(df.i / 10), ["i"], "i", "p").collect()}
    pre = {(r.k, r.i): r.p for r in bucketed_prefix_sum(df, ["k"], F.floor(df.i / 10), ["i"], "v", "p").collect()}
    for k in "ab":
        last, total = None, 0
        for _, i, v in sorted(r for r in rows if r[0] == k):
            assert lag[k, i] == last and pre[k, i] == total
            last, total = i, total + v


def test_correction_rewrites_only_its_shard(spark, tmp_path):
    leaf = "entity string, day int, calls long, tokens long, cost decimal(28,10)"
    rows = [("e", d, 1, d, Decimal(1)) for d in range(0, 400, 3)]
    path = str(tmp_path / "tree")
    rolling.store_tree(rolling.build_tree(spark.createDataFrame(rows, leaf)), path)
    files_of = lambda k: sorted(p.name for p in (tmp_path / "tree" / f"shard={k}").glob("*.parquet"))
    before = {k: files_of(k) for k in range(4)}
    rolling.correct_stored(spark, path, spark.createDataFrame([("e", 150, 0, 1000, Decimal(0)), ("new", 151, 1, 5, Decimal(2))], leaf))
    assert {k for k in range(4) if files_of(k) != before[k]} == {1}
    want = rolling.build_tree(spark.createDataFrame([*rows, ("e", 150, 0, 1000, Decimal(0)), ("new", 151, 1, 5, Decimal(2))], leaf))
    cols = ["entity", "level", "idx", "calls", "tokens", "cost"]
    assert sorted(map(tuple, spark.read.parquet(path).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
