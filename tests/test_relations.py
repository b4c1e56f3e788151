"""Relations over documents, ledgers, layouts, sources, sinks and streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quirelake.operators import bom, cache, contract, layout, ledger, positions, toc
from quirelake.plans import lineage, sizes
from quirelake.plans.order import bucketed_last
from quirelake.sources import readers, sinks
from quirelake.streaming import ledger as stream


def test_markers_and_as_of(spark):
    d = spark.createDataFrame([(1, "a\n<!-- PAGE 3 -->\nb\n<!-- PAGE 4 | x -->c"), (2, "none"), (3, None)], "doc_id int, text string")
    m = positions.markers(d)
    assert [(r.doc_id, r.pos, r.kind, r.page) for r in m.orderBy("doc_id", "ord").collect()] == [(1, 2, "PAGE", 3), (1, 20, "PAGE", 4)]
    lines = positions.line_starts(d).select("doc_id", "line_no", "pos")
    got = positions.as_of(lines, m.select("doc_id", "pos", "page"), ["doc_id"], "pos", "page", default_first=True)
    assert {(r.doc_id, r.line_no): r.page for r in got.collect()} == {(1, 1): 3, (1, 2): 3, (1, 3): 3, (1, 4): 4, (2, 1): None}


def test_section_markers_round_trip(spark):
    d = spark.createDataFrame([("1-1", "배관", "기계", "제1장")], "i string, t string, d string, c string")
    m = positions.section_marker(F.col("i"), F.col("t"), F.col("d"), F.col("c"))
    assert tuple(d.select(positions.parse_section_marker(m).alias("o")).first().o) == ("1-1", "배관", "기계", "제1장")


def test_toc(spark):
    lines = ["제11장 배관", "1-1 관 ···· 5", "1-1 관 ···· 7", "2-1 밸브 9"]
    t = toc.parse_toc(spark.createDataFrame([("d", i, x) for i, x in enumerate(lines)], "doc string, line_no int, line string"), ["doc"])
    assert [(r.toc_key, r.title, r.page) for r in t.orderBy("ord").collect()] == [("11-1", "관", 5), ("11-1#2", "관", 7), ("2-1", "밸브", 9)]
    pages = spark.createDataFrame([("d", p) for p in (1, 5, 8, 20)], "doc string, page int")
    got = {r.page: r.section_id for r in toc.active_section(pages, t, ["doc"]).collect()}
    assert got == {1: None, 5: "11-1", 8: "11-1", 20: "2-1"}
    assert {r.page: r.ids for r in toc.sections_by_page(t, ["doc"]).collect()}[5] == ["11-1"]


def test_bom_sums_over_files(spark):
    cells = []
    for doc, qty, wt in (("a", "2", "10"), ("b", "3", "15.0")):
        for c, (h, v) in enumerate((("SIZE", "150A"), ("MAT’L", "SS400"), ("Q'TY", qty), ("WT(KG)", wt), ("DESCRIPTION", f"d{doc}"))):
            cells.append((doc, 0, 0, 0, c, h, v))
    cells += cells[:2] + [("a", 0, 0, 1, 0, "SIZE", " "), ("a", 0, 0, 1, 2, "Q'TY", "9"), ("a", 0, 0, 2, 0, "SIZE", "20A"), ("a", 0, 0, 2, 2, "Q'TY", "0")]
    c = spark.createDataFrame(cells, "doc_id string, section_ord int, table_ord int, row_ord int, col_ord int, header string, value string")
    t = spark.createDataFrame([("a", 0, 0, "bom", "BOM_자재"), ("b", 0, 0, "bom", "BOM_자재")], "doc_id string, section_ord int, table_ord int, domain string, type string")
    got = bom.aggregate_boms(bom.bom_rows(c, t), ["doc_id", "row_ord"]).collect()
    assert [(r.item_no, r["size"], r.material, r.description, r.qty, r.weight) for r in got] == [(1, "150A", "SS400", "da", 5.0, 25.0)]


def test_contract_of_tables(spark):
    t = spark.createDataFrame([("a", 0, 0, "T", None, ["품명", "규격", "수량", "단가"], None, None, None), ("a", 0, 1, "T", "BOM_LINE_LIST", ["LINE NO", "Column_2"], None, None, None)], "doc_id string, section_ord int, table_ord int, table_id string, type string, headers array<string>, domain string, role string, quality struct<status:string,warnings:array<string>>")
    c = spark.createDataFrame([("a", 0, 1, 0, 0, "LINE NO", "L1"), ("a", 0, 1, 0, 1, "Column_2", ""), ("a", 0, 0, 0, 0, "품명", "x")], "doc_id string, section_ord int, table_ord int, row_ord int, col_ord int, header string, value string")
    got = {r.table_ord: (r.domain, r.role, r.status, r.warnings) for r in contract.annotate(t, c).collect()}
    assert got[0] == ("estimate", "estimate_table", "fail", ["header_row_key_mismatch"])
    assert got[1] == ("bom", "line_list_table", "warning", ["empty_tail_column"])


def test_cache_and_rotation(spark):
    log = spark.createDataFrame([("k", 0.0, 1, "get"), ("k", 1.0, 2, "put"), ("k", 5.0, 3, "get"), ("k", 50.0, 4, "get")], "key string, at double, seq int, op string")
    r = cache.replay(log, 10.0)
    assert [x.hit for x in r.orderBy("seq").collect()] == [False, False, True, False]
    s = cache.stats(r).first()
    assert (s.hits, s.misses, s.hit_rate_pct, s["size"]) == (1, 2, 33.3, 1)
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "n int")
    assert [(x.slot, x.cycle) for x in cache.rotate(n, "n", 3, 2).orderBy("n").collect()] == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 0), (0, 1)]
    puts = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0)], "key string, value string, created double")
    c = cache.latest(puts)
    assert c.first().value == "y"
    assert cache.read(spark.createDataFrame([("a",), ("b",)], "key string"), c, 100.0, 10).filter("value is not null").count() == 0


def test_ledger_totals(spark):
    e = spark.createDataFrame([(1, "2025-01-01T00:00:00+09:00", "j", "e", "p", 1, 2, 3, 0.1, "known"), (2, "2025-01-02T00:00:00+09:00", "j", "f", "p", 0, 0, None, None, "unknown")], "id bigint, timestamp string, job_id string, engine string, provider string, input_tokens bigint, output_tokens bigint, total_tokens bigint, estimated_cost_usd double, token_status string")
    s = {r.engine: (r["all"], r.calls, r.total_tokens, r.unknown_calls) for r in ledger.summary(e).collect()}
    assert s == {"e": (False, 1, 3, 0), "f": (False, 1, 0, 1), None: (True, 2, 3, 1)}
    assert {r.id: r.tokens_so_far for r in ledger.running_totals(e).collect()} == {1: 3, 2: 3}
    assert ledger.daily(e, "2025-01").count() == 2 and ledger.by_job(e).count() == 1


def test_layout_rules(spark):
    assert layout.keep_boxes([(0, 0, 10, 10), (0, 0, 10, 9), (20, 0, 30, 10), (0, 0, 100, 100)]) == [0, 2, 3]
    w = spark.createDataFrame([(1, 0, "a", 0.0, 10.0, 0.0, 5.0), (1, 1, "b", 12.0, 20.0, 2.5, 5.0), (1, 2, "c", 60.0, 70.0, 2.0, 5.0), (1, 3, "d", 0.0, 5.0, 5.0, 9.0)], "p int, word_ord int, text string, x0 double, x1 double, top double, bottom double")
    rows = layout.word_rows(w, ["p"])
    assert {r.text: r.row_no for r in rows.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1}
    assert {(r.row_no, r.cell_no): r.text for r in layout.row_cells(rows, ["p"]).collect()} == {(0, 0): "a b", (0, 1): "c", (1, 0): "d"}
    assert layout.drop_double_strikes(w.unionAll(w.filter("word_ord = 0").withColumn("word_ord", F.lit(9))), ["p"]).count() == 4
    h = spark.createDataFrame([(1, 7, 6.0), (1, 8, 64.0)], "p int, col int, x double")
    assert {r.text: r.col for r in layout.nearest_column(w, h, ["p"]).collect()} == {"a": 7, "b": 7, "c": 8, "d": 7}
    b = spark.createDataFrame([('[{"type":"table","bbox":[0,9,5,12],"html":"<t>"},{"label":"x","bbox_2d":[1,2,3,4],"text":"y"},{"type":"n"}]',), ("bad",), (None,)], "l string").select(layout.blocks(F.col("l")).alias("b")).collect()
    assert [x.label for x in b[0].b] == ["n", "x", "table"] and b[1].b == [] and b[2].b == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("﻿<!-- SECTION: 1-1 | 배관 | 부문:기계 | 장:제1장 -->\r\n본문이 열 글자를 넘는 절이다.\n<!-- SECTION: 1-2 | 빈 | 부문:x | 장:y -->\n짧다", encoding="utf-8")
    (tmp_path / "b.md").write_text("표지 없는 문서로 절이 하나뿐이다.", encoding="utf-8")
    s = readers.sections_of_markdown(readers.read_texts(spark, str(tmp_path))).collect()
    assert {(r.doc_id, r.section_id, r.title) for r in s} == {("a", "1-1", "배관"), ("b", "doc", "")}
    ocr = tmp_path / "ocr"
    ocr.mkdir()
    (ocr / "p.json").write_text('[{"page_num": 2, "text": "x![i](u)", "layout_details": [{"type": "t"}], "input_tokens": 5}]')
    (ocr / "q.json").write_text('{"md_results": "whole", "usage": {"prompt_tokens": 3}}')
    got = {r.doc_id: (r.page_num, r.text, r.input_tokens) for r in readers.read_ocr_json(spark, str(ocr)).collect()}
    assert got == {"p": (2, "x", 5), "q": (1, "whole", 3)}
    assert readers.list_files(spark, str(ocr), "*.json").count() == 2


def test_page_source(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one\ftwo\fthree")
    spark.dataSource.register(readers.PageSource)
    p = spark.read.format("pages").option("engine", "quirelake.sources.readers:text_engine").option("pagesPerTask", 2).load(str(tmp_path))
    assert sorted((r.page_num, r.text) for r in p.collect()) == [(1, "one"), (2, "two"), (3, "three")]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "x.xlsx")
    sinks.write_workbook(path, [("a/b", [["H", "N"], ["<x>", "1,200"], ["007", ""]]), ("a/b", [])])
    rows, cut = sinks.read_workbook(path)
    assert rows == [["H", "N"], ["<x>", "1200"], ["007"]] and not cut
    used: set = set()
    assert [sinks.sheet_name("x" * 40, used) for _ in range(2)] == ["x" * 31, "x" * 29 + "_2"]
    assert [sinks.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    d = spark.createDataFrame([("d", '{"가": 1}')], "doc_id string, json string")
    out = sinks.write_json_sig(d, str(tmp_path / "j")).collect()
    assert open(out[0].path, "rb").read().startswith(b"\xef\xbb\xbf{")
    m = spark.createDataFrame([("bom", "ok"), ("estimate", "fail")], "domain string, quality_status string")
    sinks.append_manifest(m, str(tmp_path / "m"))
    lines = sinks.run_summary(spark.read.parquet(str(tmp_path / "m")))
    assert [r.line for r in lines.orderBy("line_no").collect()] == ["# Run summary", "- tables: 2", "- verdict: FAIL", "- bom: 1", "- estimate: 1"]
    back = sinks.parse_report(lines).collect()
    assert {r.key: r.value for r in back}["verdict"] == "FAIL"
    os.makedirs(tmp_path / "jobs" / "1")
    (tmp_path / "jobs" / "1" / "JOB.json").write_text('{"job_id": "1", "status": "running"}')
    assert sinks.read_jobs(spark, str(tmp_path / "jobs")).first().status == "failed"


def run_once(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(once=True).start()
    q.awaitTermination(60)
    q.stop()
    return df.sparkSession.table(name).collect()


def test_streamed_usage(spark, tmp_path):
    rows = [(1, "2025-01-01T10:00:00+00:00", "j", "E ", None, None, 1, 1, 5, 0.5, "ok", "known"), (1, "2025-01-01T10:00:00+00:00", "j", "E ", None, None, 1, 1, 5, 0.5, "ok", "known"), (2, "2025-01-01T10:30:00+00:00", "j", "e", None, None, 1, 1, None, None, "ok", "known"), (3, "bad", "j", "e", None, None, 1, 1, 9, None, "ok", "known")]
    spark.createDataFrame(rows, stream.EVENT).write.parquet(str(tmp_path / "in"))
    got = run_once(stream.hourly_usage(stream.read_events(spark, str(tmp_path / "in"))), "usage", "update")
    assert [(r.engine, r.calls, r.tokens) for r in got] == [("e", 2, 5)]


def test_streamed_cache(spark, tmp_path):
    now = int(time.time() * 1000)
    schema = "key string, at_ms bigint, op string"
    spark.createDataFrame([("a", now, "put"), ("a", now + 5, "get"), ("a", now + 10_000_000, "get"), ("b", now, "get")], schema).write.parquet(str(tmp_path / "in"))
    got = run_once(stream.ttl_cache(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60_000), "cachelog")
    assert sorted((r.key, r.op, r.hit) for r in got) == [("a", "get", False), ("a", "get", True), ("a", "put", False), ("b", "get", False)]


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("n", [1, 2])
def test_broadcast_is_bounded(spark, n):
    from quirelake.plans.sizes import broadcast_if_small

    small = spark.range(2)
    hinted = "broadcast" in broadcast_if_small(small, n)._jdf.queryExecution().logical().toString().lower()
    assert hinted == (n >= 2)


def test_let_and_times(spark):
    from quirelake.functions.bind import let
    from quirelake.functions.times import epoch_micros

    assert spark.range(1).select(let(F.lit(2), lambda x: x + x * x).alias("o")).first().o == 6
    r = spark.sql("select timestamp_ntz '1970-01-02 00:00:01' as t").select(epoch_micros(F.col("t")).alias("o"))
    assert r.first().o == 86_401_000_000


def test_segments_and_gaps(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "# T", "b", "# U"], 1)], "doc_id int, line_no int, line string")
    got = positions.segments(lines, F.col("line").startswith("#"), ["doc_id"], "line_no")
    assert sorted((r.seg_no, r.title, r["first"], r["last"], r.n) for r in got.collect()) == [(0, None, 1, 1, 1), (1, "# T", 2, 3, 2), (2, "# U", 4, 4, 1)]
    g = positions.gap_groups(spark.createDataFrame([(1, 0), (1, 5), (1, 20)], "u int, t int"), ["u"], "t", F.lit(10), [])
    assert [r.grp for r in g.orderBy("t").collect()] == [1, 1, 2]
    c = positions.carried(spark.createDataFrame([(1, 1, "x"), (1, 2, " "), (1, 3, None)], "d int, o int, c string"), ["d"], ["o"], "c", "k")
    assert [r.k for r in c.orderBy("o").collect()] == ["x", "x", "x"]


def test_cut_tables_and_release(spark):
    df = spark.createDataFrame([(1, "가", [1.5], None), (None, None, None, {"a": 1})], "i bigint, s string, a array<double>, m map<string, int>")
    got = lineage.cut(df)
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert lineage.cut(df.limit(0)).collect() == []
    place = lineage.scratch(spark, "test")
    df.write.parquet(place)
    lineage.release(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(place)


def test_broadcasts_have_two_bounds(spark):
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    few = spark.range(10)
    wide = spark.range(10).withColumn("s", F.repeat(F.lit("x"), 1000)).withColumn("a", F.array("s", "s"))
    assert hinted(sizes.broadcast_if_small(few)) and not hinted(sizes.broadcast_if_small(few, max_rows=9))
    assert hinted(sizes.broadcast_if_small(wide)) and not hinted(sizes.broadcast_if_small(wide, max_bytes=20_000))
    assert hinted(sizes.broadcast_if_small(wide.limit(0)))


def test_last_value_over_buckets(spark):
    rows = [("a", i, float(i) if i % 7 == 0 else None) for i in range(40)] + [("b", 3, None), ("b", 30, 1.0)]
    got = bucketed_last(spark.createDataFrame(rows, "k string, t int, v double"), ["k"], F.floor(F.col("t") / 5), ["t"], "v", "last").collect()
    assert {(r.k, r.t): r.last for r in got} == {**{("a", i): float(i - i % 7) for i in range(40)}, ("b", 3): None, ("b", 30): 1.0}
