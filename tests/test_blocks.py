"""Tables read out of HTML text."""

import pytest
from pyspark.sql import functions as F

from quirelake.functions import grid as G
from quirelake.functions import tables as T
from quirelake.operators import blocks, layout, metadata, positions, reports
from quirelake.sources import readers, sinks

SPARSE = (
    "<table><thead><tr>" + "".join(f"<th rowspan='2'>{h}</th>" for h in ("ITEM", "DESCRIPTION", "SIZE", "MAT'L", "SCH", "CLASS", "ENDS", "REMARK", "TAG")) + "<th colspan='4'>WEIGHT</th><th rowspan='2'>QTY</th><th rowspan='2'>UNIT</th></tr>"
    "<tr><th>UNIT</th><th>LOSS</th><th>TOTAL</th><th>KG</th></tr></thead><tbody><tr>" + "".join(f"<td>{c}</td>" for c in ("1", "PIPE", "100A", "SS400", "40", "A1", "BE", "-", "T-1", "1", "식")) + "</tr></tbody></table>"
)
LINES = "<table><tr><td colspan='3'>LINE LIST</td></tr><tr><td>LINE NO</td><td>FROM</td><td>TO</td></tr><tr><td>L-1</td><td>P-1</td><td>V-2</td></tr><tr><td>DRW'D</td><td>x</td><td></td></tr></table>"
PLAIN = "<table><tr><th>품명</th><th>규격</th></tr><tr><td>관</td><td>20A</td></tr><tr><td>[주] 별도</td><td></td></tr></table>"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("a", "S1", f"앞 {SPARSE} 뒤 {LINES}"), ("b", None, PLAIN), ("c", "S3", None), ("d", "S4", ""), ("e", "S5", "<table></table>"), ("f", "S6", "<table><tr><td>CLIENT: x S/N SIZE QTY</td></tr></table>"), ("g", "S7", PLAIN[:40])]
    return spark.createDataFrame([(*r, "clash") for r in rows], "doc string, sid string, text string, kind string")


def test_material_tables(texts):
    got = {(r.doc, r.block_no): r for r in blocks.material_tables(texts, ["doc"], "text").collect()}
    assert set(got) == {("a", 1), ("a", 2)}
    bom, line = got["a", 1], got["a", 2]
    assert bom.kind == "bom" and len(bom.headers) == 15 and bom.headers[9:13] == ["WEIGHT | UNIT", "WEIGHT | LOSS", "WEIGHT | TOTAL", "WEIGHT | KG"]
    row = dict(zip(bom.headers, bom.rows[0]))
    assert (row["QTY"], row["UNIT"], row["TAG"], row["WEIGHT | UNIT"]) == ("1", "식", "T-1", "")
    assert (line.kind, line.title, line.raw_rows, line.rows) == ("line_list", "LINE LIST", 2, [["L-1", "P-1", "V-2"]])


def test_parsed_tables_of_sections(texts):
    got = {(r.doc, r.block_no): r for r in blocks.parsed_tables(texts, ["doc"], "sid", "text").collect()}
    assert got["a", 1].type == "BOM_자재" and got["a", 2].type == "general" and got["a", 1].table_id == "T-S1-01"
    b = got["b", 1]
    assert (b.table_id, b.type, b.headers, b.rows, b.notes, b.raw_rows, b.parsed_rows) == ("T-unknown-01", "general", ["품명", "규격"], [["관", "20A"]], ["[주] 별도"], 2, 1)
    assert ("c", 1) not in got and ("e", 1) not in got and got["g", 1].rows == []
    more = texts.filter("doc = 'a'").withColumn("text", F.replace(F.col("text"), F.lit("<td>TO</td>"), F.lit("<td>QTY</td>")))
    assert [r.type for r in blocks.parsed_tables(more, ["doc"], "sid", "text").orderBy("block_no").collect()] == ["BOM_자재", "BOM_LINE_LIST"]
    words = {"A_품셈": ("품명", "규격")}
    assert {r.type for r in blocks.parsed_tables(texts.filter("doc = 'b'"), ["doc"], "sid", "text", words).collect()} == {"A_품셈"}
    assert blocks.parsed_tables(texts.limit(0), ["doc"], "sid", "text").collect() == []


def test_sections_keep_their_numbers(spark, texts):
    t = blocks.material_tables(texts, ["doc"], "text")
    empty = spark.createDataFrame([("a", 0, "bom", None, ["S/N"], [], 1)], "doc string, block_no int, kind string, title string, headers array<string>, rows array<array<string>>, raw_rows int")
    got = {r.section_id: r for r in blocks.material_sections(t.unionByName(empty), ["doc"], ["block_no"]).collect()}
    assert set(got) == {"BOM-2", "LL-1"}
    assert (got["LL-1"].table_id, got["LL-1"].title, got["LL-1"].role) == ("T-LL-1-01", "LINE LIST #1", "line_list_table")
    assert len(got["BOM-2"].headers) == 15


H = ["N", "D", "W | A", "W | B", "Q", "U"]


@pytest.mark.parametrize(
    ("row", "want"),
    [
        (["1", "x", "5", "식", "", ""], ["1", "x", "", "", "5", "식"]),
        (["1", "x", "5", "식"], ["1", "x", "", "", "5", "식"]),
        (["1", "", "5"], ["1", "", "", "", "", "5"]),
        (["1"], ["1", "", "", "", "", ""]),
        (["1", "x"], ["1", "x", "", "", "", ""]),
        (["", "x", "5"], ["", "x", "5", "", "", ""]),
        (["1", "x", "5", "6", "7", ""], ["1", "x", "5", "6", "7", ""]),
        (["1", "", "5", "6", "", ""], ["1", "", "5", "6", "", ""]),
    ],
)
def test_realigned_rows(row, want):
    assert G.realign(row, H) == want
    assert len(G.normalise([row + ["z"] * 9], H)[0]) == len(H)


def test_small_operators(spark):
    one = lambda c, **v: spark.range(1).select(*[F.lit(x).alias(k) for k, x in v.items()] or ["id"]).select(c.alias("o")).first().o
    assert one(blocks.plain_html(F.col("h")), h="a<br/>b <b>c</b> &lt;d&gt; &amp;lt;") == "a\nb c <d> &lt;"
    assert one(blocks.context_text(F.col("h")), h="글 <table><tr><td>x</td></tr></table>\n| a | b |\n![p](q) 끝  <i>남</i>") == "글 \n 끝 남"
    f = one(blocks.composite_flags(F.col("h")), h="WEIGHT | weight_2")
    assert (f.composite, f.self_repeating) == (True, True)
    pairs = one(blocks.info_pairs(F.array(F.lit("상호"), F.lit("한빛")), F.array(F.array(F.lit("주소"), F.lit(""), F.lit("울산")), F.array(F.lit("FAX")))))
    assert pairs == [["상호", "한빛", "주소", "울산"], ["FAX", "", "", ""]]
    s = one(blocks.fallback_signals(F.lit(2), F.lit(False), F.lit(1200), F.lit(False), F.lit(True)))
    assert (s.mixed, s.quote) == (True, False)
    assert one(blocks.strong_package(F.lit(True), F.lit(True), F.lit(2))) is False
    st = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 3, "w")], "k string, s int, v string")
    assert sorted(r.v for r in blocks.first_stage(st, ["k"], "s").collect()) == ["w", "y", "z"]


def test_condition_tables(spark):
    tops = [0, 10, 20, 60, 70, 200, 210, 220, 230, 240, 250, 260, 270]
    text = {1: "일 반 사항 특기사항", 5: "일반사항 / 특기사항"}
    rows = [("d", i, text.get(i, "줄"), float(i), float(t), 100.0 + i, t + 8.0) for i, t in enumerate(tops)]
    df = spark.createDataFrame(rows, "d string, row_no int, text string, x0 double, top double, x1 double, bottom double")
    got = {r.row_no: (r.n, r.x0, r.y0, r.x1, r.y1) for r in layout.condition_tables(df, ["d"]).collect()}
    assert got == {1: (2, 1.0, 10.0, 102.0, 28.0), 5: (6, 5.0, 200.0, 110.0, 258.0)}
    t = layout.line_tolerances(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "p string, width double"), ["p"]).collect()
    assert {(r.p, r.snap, r.join_at, r.meet) for r in t} == {("a", 6.0, 12.0, 12.0), ("b", 4.0, 8.0, 8.0)}


def test_text_given_to_markers(spark):
    m = lambda *x: [{"section_id": a, "title": b} for a, b in x]
    rows = [
        ("both", "머리\n1-1 관\n본문\n1-2 밸브\n끝", m(("1-1", "관"), ("1-2", "밸브"))),
        ("title", "앞\n공통 가설 공사 일반\n본문", m(("2-1", "없는 제목"), ("2-2", "공통 가설 공사 일반"))),
        ("none", "아무 글", m(("3-1", "x"), ("3-2", None))),
        ("one", " 글 ", m(("4-1", "x"))),
        ("blank", "  ", m(("5-1", "x"), ("5-2", "y"))),
        ("null", None, m(("6-1", "x"), ("6-2", "y"))),
    ]
    df = spark.createDataFrame(rows, "g string, text string, markers array<struct<section_id: string, title: string>>")
    got = {(r.g, r.section_id): r.text for r in positions.redistribute(df, ["g"]).collect()}
    assert got == {
        ("both", "1-1"): "머리\n\n1-1 관\n본문", ("both", "1-2"): "1-2 밸브\n끝", ("title", "2-1"): "", ("title", "2-2"): "앞\n\n공통 가설 공사 일반\n본문",
        ("none", "3-1"): "", ("none", "3-2"): "아무 글", ("one", "4-1"): " 글 ", ("blank", "5-1"): "", ("blank", "5-2"): "", ("null", "6-1"): "", ("null", "6-2"): "",
    }


def test_reports_of_odd_inputs(spark):
    assert reports.batch_rollup(spark.createDataFrame([("a", None, 0), ("a", True, 4)], "b string, ok boolean, n int"), "b", "ok", "n").collect()[0].asDict() == {"b": "a", "ok": 1, "failed": 1, "rows_ok": 4, "mean_rows": 2.0, "without_rows": 1}
    a = spark.createDataFrame([("x", 0.0), ("y", 4.0)], "k string, v double")
    b = spark.createDataFrame([("x", 5.0), ("y", 5.0), ("z", 1.0)], "k string, v double")
    assert {r.k: r.change_pct for r in reports.compare_runs(a, b, "k", "v").collect()} == {"x": 0.0, "y": 25.0, "z": None}
    assert [r.line for r in reports.qa_report(a.limit(0).selectExpr("k AS verdict")).collect()] == ["# QA: PASS"]
    calls = spark.createDataFrame([(i,) for i in range(1, 9)], "id int")
    assert [r.slot for r in reports.serve_calls(calls, "id", 2, 2, exhausted=(0,)).orderBy("id").collect()] == [1] * 8


def test_columns_tails_and_words(spark):
    rows = [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)]
    got = [list(r.o) for r in spark.createDataFrame(rows, "r array<string>").select(T.two_columns(F.col("r")).alias("o")).collect()]
    assert got == [["", ""], ["a", ""], ["a", "b"], ["a b", "c"]]
    tails = spark.createDataFrame([(["A", "B", "B"], ["x", "y"], ["A | x", "B | y", "B"]), (["A", "B"], ["x", "y"], ["A | x", "B | y"]), (["A", "", ""], ["x"], ["A | x", "C", "D"])], "p array<string>, c array<string>, m array<string>")
    assert [list(r.o) for r in tails.select(T.trim_doubled_tail(F.col("p"), F.col("c"), F.col("m")).alias("o")).collect()] == [["A | x", "B | y"], ["A | x", "B | y"], ["A | x", "C", "D"]]
    words = spark.createDataFrame([("p", 0.0, 0.0, 10.0, 10.0, "in"), ("p", 50.0, 50.0, 60.0, 60.0, "out"), ("q", 0.0, 0.0, 9.0, 9.0, "alone")], "p string, x0 double, top double, x1 double, bottom double, text string")
    boxes = spark.createDataFrame([("p", 0.0, 0.0, 20.0, 20.0)], "p string, x0 double, y0 double, x1 double, y1 double")
    assert {r.text for r in layout.words_outside(words, boxes, ["p"]).collect()} == {"out", "alone"}


def test_estimate_sheet(spark):
    t = spark.createDataFrame([("d", ["N", "명", "규", "단", "수량"], [["1", "관", None, "m", "1,200"], ["소계", "", "", "", "0012"]], ["비고"]), ("e", [], [], [])], "d string, headers array<string>, rows array<array<string>>, notes array<string>")
    got = {(r.row_no, r.col_no): (r.text, r.number, r.style) for r in reports.estimate_sheet(t, ["d"]).collect()}
    assert got[3, 5] == ("1,200", 1200.0, "body") and got[4, 5] == ("0012", None, "subtotal") and got[3, 1] == ("1", None, "body") and got[3, 3] == ("", None, "body")
    assert got[2, 1] == ("N", None, "header") and got[5, 1] == ("※ 비고", None, "note") and len(got) == 16


def test_toc_files(spark, tmp_path):
    for name, text in (("a", '{"section_map": {"1-1": {"id": "1-1", "title": "관", "page": 3}}}'), ("b", '{"2-1": {"title": "밸브"}}'), ("c", "{bad"), ("e", "")):
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    got = {(r.source_file, r.toc_key, r.id, r.title, r.page) for r in readers.read_toc(spark, str(tmp_path)).collect()}
    assert got == {("a.json", "1-1", "1-1", "관", 3), ("b.json", "2-1", "2-1", "밸브", None)}


def test_files_by_uri(tmp_path):
    for path in (f"{tmp_path}/x/y.bin", f"file://{tmp_path}/z/y.bin"):
        sinks.put(path, b"abc")
    assert (tmp_path / "x" / "y.bin").read_bytes() == (tmp_path / "z" / "y.bin").read_bytes() == b"abc"


def test_names_and_calls(spark):
    one = lambda c: spark.range(1).select(c.alias("o")).first().o
    lit = lambda *x: [F.lit(v) for v in x]
    assert one(reports.sheet_name(*lit(None, "doc", None, "설명"))) == "설명" and one(reports.sheet_name(*lit("source_info_table", "x", "y", "z"))) == "업체정보"
    assert one(reports.sheet_name(*lit(None, "배관: 일", "y", "설명"))) == "배관_ 일_설명" and one(reports.material_sheet_name(*lit(None, "BOM_LINE_LIST", "x", "y"))) == "BOM_LINE_LIST"
    assert one(reports.is_rate_limit(F.lit(None).cast("string"))) is False and one(reports.fallback_mode(*lit(None, None))) == "auto"
    assert tuple(one(reports.token_counts(F.lit("{bad")))) == (0, 0)
    assert one(reports.reserved_name(F.lit("a"), F.array(*lit("a", "a_1")))) == "a_2"
    assert one(positions.context_marker(*lit(None, "t", "c", "s"))) == ""


def test_tables_of_loose_words(spark):
    def row(i, *words):
        return [("p", 100 * i + k, t, float(x), 12.0 * i, float(x) + 10, 12.0 * i + 8) for k, (t, x) in enumerate(words)]

    rows = row(0, ("제목이 아주 길어서 머리가 되지 않는 줄", 10), ("이것도 머리가 되지 않는 아주 긴 낱말", 300)) + row(1, ("NO", 10), ("NAME", 150), ("QTY", 300)) + row(2, ("1", 11), ("PIPE", 145), ("100A", 156), ("2", 302)) + row(3, ("2", 11), ("far", 230))
    other = [("q", 1, "a", 0.0, 0.0, 5.0, 5.0)]
    words = spark.createDataFrame(rows + other, "d string, word_ord int, text string, x0 double, top double, x1 double, bottom double")
    cells, boxes = layout.aligned_tables(layout.word_rows(words, ["d"]), ["d"], 600.0)
    assert {(r.row_no, r.col): r.text for r in cells.collect()} == {(0, 0): "NO", (0, 1): "NAME", (0, 2): "QTY", (1, 0): "1", (1, 1): "PIPE 100A", (1, 2): "2", (2, 0): "2"}
    assert [tuple(r) for r in boxes.collect()] == [("p", 10.0, 12.0, 312.0, 44.0)]
    ruled = spark.createDataFrame([("p", 10.0, 12.0, 311.0, 43.0), ("p", 400.0, 400.0, 500.0, 500.0)], "d string, x0 double, y0 double, x1 double, y1 double")
    assert layout.found_tables(ruled, boxes, ["d"]).count() == 2 and layout.found_tables(ruled.limit(0), boxes, ["d"]).count() == 1


def test_values_of_workbooks(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    sinks.write_workbook(path, [("s", [["H", "I"], ["a", ""], [None, 5]]), ("t", [["x"], ["  "], ["&<"]])])
    assert sinks.sheet_values(open(path, "rb").read()) == 3 and sinks.sheet_values(open(path, "rb").read(), 1) == 6
    got = sinks.workbook_values(spark.createDataFrame([("d", path), ("e", f"file://{path}")], "doc_id string, path string")).collect()
    assert [r.sheet_values for r in got] == [3, 3]


def test_notes_that_repeat_a_table(spark):
    n = spark.createDataFrame([("a", "가 나 다"), ("a", "다른 말"), ("a", " "), ("a", None), ("b", "가나다")], "d string, note string")
    t = spark.createDataFrame([("a", "[주] 가나 다 라"), ("a", ""), ("a", None), ("b", "나\n다")], "d string, note string")
    assert {(r.d, r.note) for r in metadata.unique_notes(n, t, ["d"]).collect()} == {("a", "다른 말"), ("a", " "), ("a", None)}
