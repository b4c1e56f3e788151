"""Text, number and table functions against expected pairs and round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import grid as G
from quirelake.functions import numbers as N
from quirelake.functions import tables as T
from quirelake.functions import text as X
from quirelake.functions.reflow import reflow_text
from quirelake.functions.scanlines import read_tables
from quirelake.operators import contract, detect, metadata


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("o")).first()["o"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (X.collapse, "  a 　 b\n c ", "a b c"),
        (X.cell_text, "<td>m<sup>2</sup> &amp; x<br>y</td>", "m^2 & x y"),
        (X.merge_spaced_hangul, "공 사 명\nab cd", "공사명\nab cd"),
        (X.strip_markers, "a<!-- PAGE 3 | x -->b", "ab"),
        (X.header_compare_key, "Wt. (Kg)|a_b", "WT(KG)AB"),
        (X.semantic_header_key, "Q'TY_2", "QTY"),
        (X.sanitize_html, "<tr><td>a</td><td>b &lt;</td></tr>", "a | b \n"),
        (X.chapter_number, "제12장 배관", 12),
        (X.chapter_number, None, 0),
        (X.section_name, "제3장 공 통", "제3장 공통"),
        (X.section_name, "제1장공통", "제1장 공통"),
        (X.section_name, "제1장 지붕 및 홈통공사", "제1장 지붕 및 홈통공사"),
        (X.section_name, " 부록 ", "부록"),
        (X.split_trailing_chapter, "제목 제3장 공사 12", ["제목 제3장 공사 12"]),
        (X.split_trailing_chapter, "1-2 배관 제3장 공사", ["1-2 배관 제3장 공사"]),
        (X.split_trailing_chapter, "1-2-1 배관 5 제3장 지붕 공사 12 ", ["1-2-1 배관 5", "제3장 지붕 공사 12"]),
        (X.file_name, "a/b/견적 1?.pdf", "견적 1_.pdf"),
        (X.file_name, "a/..", "input.pdf"),
        (X.sheet_token, " a/b:\nc' ", "a_b_ c"),
        (X.strip_code_fence, "```html\n<p>\n```", "<p>"),
        (X.display_width, "ab가", 4),
        (X.correct_ocr, "건적금액 충합계", "견적금액 총합계"),
        (X.mask_secrets, "api_key=abcdefgh12 x", "api_key=***MASKED*** x"),
        (X.ends_sentence, "적는다.  ", True),
        (X.ends_sentence, "적는", False),
        (X.valid_page_spec, "1-3, 5", True),
        (X.valid_page_spec, "3-1", False),
        (N.strict_number, "1,234.5", 1234.5),
        (N.strict_number, "007", None),
        (N.strict_number, "-", None),
        (N.strict_number, "0.5", 0.5),
        (N.lenient_number, "12.5kg", 12.5),
        (N.lenient_number, "1e3", 1000.0),
        (N.lenient_number, None, 0.0),
        (N.lenient_number, "1-2", 0.0),
        (N.amount, "일금 1,200 원", 1200),
        (X.normalize_header, "名　稱_ 단\n가", "名稱_단가"),
        (X.canonical_detail_key, "재료비_단가_2", "재료비_단가"),
        (metadata.revision_year, "x('02, '24년 보완)", 2024),
        (metadata.revision_year, "('98년 보완)", 1998),
        (metadata.unit_basis, "표 (100m당)", "100m당"),
    ],
)
def test_scalar(spark, f, value, want):
    assert one(spark, value, f) == want


def test_repair_of_ids_and_hash_inputs(spark):
    r = spark.createDataFrame([("1-2", 11), ("2-2", 11), ("1-1", 1)], "s string, c int").select(X.repair_section_id(F.col("s"), F.col("c")).alias("o")).collect()
    assert [x.o for x in r] == ["11-2", "2-2", "1-1"]


def test_page_spec():
    assert X.page_spec("3", 10) == [0, 1, 2] and X.page_spec("2-3,5", 10) == [1, 2, 4] and X.page_spec("8-", 9) == [7, 8] and X.page_spec("-2", 9) == [0, 1]
    with pytest.raises(ValueError):
        X.page_spec("5-2", 9)


ROW = "array<string>"
GRID = "array<array<string>>"


@pytest.mark.parametrize(
    "f, value, want, kind",
    [
        (T.is_noise_row, ["", " "], True, ROW),
        (T.is_noise_row, ["a", "a"], True, ROW),
        (T.is_noise_row, ["x", "chk'd by"], True, ROW),
        (T.is_noise_row, ["a", "b"], False, ROW),
        (T.is_note_row, ["[주] 보기", ""], True, ROW),
        (T.is_note_row, ["가", "나"], False, ROW),
        (T.is_repeated_marker, ["1. 공사", "1. 공사"], True, ROW),
        (T.is_sub_header, ["UNIT", "QTY", ""], True, ROW),
        (T.title_of, ["", "BILL", "BILL"], "BILL", ROW),
        (T.unique_headers, ["A", "", "A", None, "A"], ["A", "Column_2", "A_2", "Column_4", "A_3"], ROW),
        (T.composite_headers, [["a", "a", "b"], ["x", "y", "b"]], ["a_x", "a_y", "b"], GRID),
        (T.header_rows, [["a", "a"], ["x", "y"], ["1", "2"]], 2, GRID),
        (T.header_rows, [["a", "b"], ["1", "2"]], 1, GRID),
        (T.pipe_rows, "x\n| a | | b |\n|---|---|---|\n| 1 | 2 | 3 |", [["a", "", "b"], ["1", "2", "3"]], "string"),
        (T.gap_rows, "a  b  c\nx y z", [["a", "b", "c"]], "string"),
        (T.html_tables, "x<table a>1</table>y<TABLE>2</TABLE>", ["<table a>1</table>", "<TABLE>2</TABLE>"], "string"),
        (T.html_tables, "x<table>cut", ["<table>cut"], "string"),
        (T.without_tables, " a<table>1</table> ", "a", "string"),
    ],
)
def test_rows_and_grids(spark, f, value, want, kind):
    assert one(spark, value, f, kind) == want


def test_parent_fill_and_sub_headers(spark):
    df = spark.createDataFrame([(["W", "", "N", ""], ["a", "b", "", "c"])], "p array<string>, c array<string>")
    assert df.select(T.fill_parents(F.col("p"), F.col("c")).alias("o")).first().o == ["W", "W", "N", "N"]
    assert df.select(T.merge_sub_headers(F.col("p"), F.col("c")).alias("o")).first().o == ["W | a", "b", "N", "c"]


def test_quantity_unit_shift(spark):
    h, row = ["ITEM", "수량", "단위", "WEIGHT | UNIT"], ["x", "", "3", "EA"]
    df = spark.createDataFrame([(h, row)], "h array<string>, r array<string>")
    assert df.select(T.repair_shift(F.col("r"), F.col("h")).alias("o")).first().o == ["x", "3", "EA", ""]
    w = df.select(contract.bom_warnings(F.col("h"), F.array(F.col("r"))).alias("o")).first().o
    assert w == ["qty_unit_shift_suspected"]


def test_html_spans():
    html = "<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><td>c</td><td>d &amp; e</td></tr><tr><td>1</td></tr></table>"
    assert G.expand(html) == [["A", "B", "B"], ["A", "c", "d & e"], ["1", "", ""]]
    assert G.expand("none") == []


def test_width_and_realignment():
    assert G.fit_width(["a", "b", "cc", "d"], 3) == ["a b", "cc", "d"] and G.fit_width(["a"], 3) == ["a", "", ""]
    assert G.realign(["1", "x", "9"], ["N", "D", "W | A", "W | B", "W | C"]) == ["1", "x", "", "", "9"]


cell = st.text(alphabet="ab 가<>&|1", max_size=6).map(str.strip).map(lambda s: " ".join(s.split()))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(cell, min_size=2, max_size=2), min_size=1, max_size=4))
def test_html_round_trip(rows):
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    html = "<table>" + "".join("<tr>" + "".join(f"<td>{esc(c)}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    assert G.expand(html) == rows


def test_markdown_tables_become_html():
    md = "x\n| a | b |\n|---|---|\n| 1 | 2 | 3 |\n| 4 |\ny"
    assert G.pipe_tables_to_html(md) == "x\n<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>4</td><td></td></tr></tbody></table>\ny"


def test_line_reader():
    text = "NOTE\nBILL OF MATERIALS\nS/N | SIZE\n| S/N | SIZE | Q'TY |\n|---|---|---|\n| 1 | 20A | 2 |\n\n| 2 | 25A | 3 |\n| S/N | SIZE | Q'TY |\n| 3 | 32A | 1 |\nTOTAL WEIGHT 5\n| 9 | 9 | 9 |\nLINE LIST\n| LINE NO | FROM |\n| L-1 | A |\n\n\n| L-2 | B |"
    got = read_tables(text)
    assert [(k, len(r)) for k, _, _, r in got] == [("bom", 3), ("line_list", 1)]
    assert read_tables("") == []
    noisy = "BILL OF MATERIALS\n| S/N | SIZE | Q'TY |\n| 1 | 20A | 2 |\n| DRW'D | x | y |\n| a | a | a |\n\n| 2 | 25A | 3 |"
    assert [r for _, _, _, r in read_tables(noisy)] == [[["1", "20A", "2"], ["2", "25A", "3"]]]


def test_reflow():
    assert reflow_text("관을\n공장에서 자른다. 다음\n1. 항목\n본문") == "관을 공장에서 자른다. 다음\n1. 항목 본문"
    assert reflow_text("자른\n다.") == "자른다."
    assert reflow_text("") == ""
    assert reflow_text("머리 1-2-3 관 공사\n본문\n\n\n\n끝") == "머리\n\n1-2-3 관 공사 본문\n\n끝"
    assert reflow_text("재료를 쓴다. ① 첫째  것 ② 둘째\n[주] 셋째") == "재료를 쓴다.\n① 첫째 것 ② 둘째\n\n[주] 셋째"
    assert reflow_text("앞 글\n토목부문\n뒤 글", ("토목부문",)) == "앞 글\n\n토목부문\n뒤 글"
    assert reflow_text("가" * 90 + "\n나비") == "가" * 90 + "\n나비"
    assert reflow_text("관을 자른\n다\n한다") == "관을 자른다한다"


def test_detection(spark):
    r = one(spark, "견적서 견적금액 내역서 납품기일 결제조건 수량 단가", lambda c: detect.detection(c))
    assert (r.label, r.confidence) == ("estimate", "high")
    assert one(spark, "hello", lambda c: detect.detection(c)).label is None
    assert one(spark, None, lambda c: detect.detection(c)).confidence == "low"
    assert one(spark, "항목 치수 수량 단가 공급가액", detect.material_quote) is True
    m = one(spark, "<!-- PAGE 1 -->ab <table></table>\n| a | b |\n|---|---|", lambda c: detect.extraction_metrics(c))
    assert (m.html_tables, m.pipe_tables, m.score) == (1, 1, m.visible_chars + 850)
    assert "visible_chars<200" in m.weak_reason


def test_metadata(spark):
    text = "본문\n[주]\n① 첫째\n② 둘째\n\n야간인 경우 본 품의 20% 가산. 15% 할증\n제6장 6-1-1 참조"
    m = one(spark, text, metadata.section_text)
    assert m.notes == ["첫째", "둘째"]
    assert [(c.type, c.rate) for c in m.conditions] == [("가산", "20%"), ("할증", "15%")]
    assert [(r.target, r.chapter) for r in m.references] == [("6-1-1", "6")]
    m = one(spark, "[주]\n① 하나\n이어서\n\n② 둘\n\n본문 (m당) ('98, '24년 보완)\n[주]\n셋\n1-2 다음 절\n1-3항 준용, 2-4 표", metadata.section_text)
    assert m.notes == ["하나\n이어서", "둘", "셋"] and "본문" in m.clean_text and "다음 절" in m.clean_text
    assert [(r.target, r.chapter) for r in m.references] == [("1-3", "")] and (m.revision_year, m.unit_basis) == (2024, "m당")
    many = one(spark, "야간인 경우 본 품의 20% 가산 주간일 때 시공량의 5% 감한다\n8% 할증", metadata.conditions)
    assert [(c.type, c.condition, c.rate) for c in many] == [("가산", "야간인 경우", "20%"), ("감산", "주간일 때", "5%"), ("할증", "야간인 경우 본 품의 20% 가산 주간일 때 시공량의 5% 감한다"[-29:], "8%")]
    empty = one(spark, None, metadata.section_text)
    assert empty.notes is None and one(spark, "", metadata.notes) == []
    t = one(spark, "DWG NO. K-1 | REV. 0\nTITLE: PIPE\nCLIENT: A\nOWNER: B", metadata.title_block)
    assert (t.dwg_no, t.rev, t.title, t.client, t.scale) == ("K-1", "0", "PIPE", "A", None)
    c = one(spark, "제 출 처 : 한빛 貴中\n견적금액: 1,200 원정", metadata.cover)
    assert (c.client, c.amount) == ("한빛", 1200)


def test_conditions_of_estimates(spark):
    rows = [["볼트", "1"], ["납 기", "30일", "x" * 50], ["비고", "이하 여백"]]
    r = one(spark, rows, contract.split_conditions, GRID)
    assert r["items"] == [["볼트", "1"]] and (r.conditions[0].label, r.conditions[0].value) == ("납기", "30일")
