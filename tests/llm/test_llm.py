"""Operators for training text: brute force, held rules, odd inputs."""

import random
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirelake.llm import canonical, leakage, lookalike, mixing, residue, scans
from quirelake.llm.automaton import Automaton, Trie, jamo


def osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_brute_force():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(150)})
    t = Trie()
    for w in words:
        t.add(w, w)
    for k in (0, 1, 2):
        for q in words[::9]:
            got = {(e, p) for e, p in t.within(Automaton(q, k))}
            assert got == {(osa(q, w), w) for w in words if osa(q, w) <= k}


def test_merges_and_jamo():
    t = Trie()
    for w in ("modern", "기사는"):
        t.add(jamo(w), w)
    assert t.within(Automaton("modem", 1, [("rn", "m")])) == [(1, "modern")]
    assert t.within(Automaton(jamo("기사른"), 1)) == [(1, "기사는")]


HEADS = [(2, ["품명", "ITEM NAME", "品名"]), (6, ["수량", "QUANTITY", "數量"]), (7, ["단가", "UNIT PRICE", "單 價"]), (8, ["금액", "AMOUNT", "金 額"]), (9, ["비고", "REMARKS"]), (14, ["경비 단가"])]


@pytest.mark.parametrize(
    "typed, want",
    [("* 수량 :", 6), ("Qunatity", 6), ("AМOUNT", 8), ("ＡMOUNT", 8), ("1) 金 額", 8), ("비교", 9), ("U/PRICE", 7), ("Q'TY", 6), ("경비_단가", 14), ("수량별", 6), ("((품 명)", 2), ("현장소장 의견", 0), ("", 0), ("TAG", 0), ("수" * 5000, 0)],
)
def test_typed_headers(typed, want):
    assert canonical.Canonicaliser(HEADS).best(typed) == want


def test_map_values_rows(spark):
    df = spark.createDataFrame([(1, "수량", "x"), (2, None, "x"), (3, "수 량", "x"), (4, "날씨", None)], "k int, v string, header_id string")
    got = canonical.map_values(df, ["k"], "v", HEADS, "id").collect()
    assert sorted(tuple(r) for r in got) == [(3, 6), (4, 0)]
    assert canonical.map_values(df.limit(0), ["k"], "v", HEADS, "id").collect() == []


NAMES = [(1, "Check Valve A형"), (2, "면적당 방청비 (㎡)"), (3, "용접봉 E-7016"), (4, "소모자재·공구손료"), (5, "Façade 패널"), (6, "運搬 및 揚重")]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Сhесk Vаlvе Α형", 1),
        ("Check Valve　A형 ", 1),
        ("Ｃｈｅｃｋ Ｖａｌｖｅ Ａ형", 1),
        ("Check​ Val­ve A형", 1),
        ("용접봉 Ｅ－７０１６", 3),
        ("용접봉 E‐7016", 3),
        ("소모자재ㆍ공구손료", 4),
        (unicodedata.normalize("NFD", "Façade 패널"), 5),
        ("面적당", None),
        ("Check Valve A형", None),
        ("  Check Valve A형\t", None),
        ("CHECK VALVE A형", None),
        ("면적당 방청비 (m2)", None),
        ("Check  Valve A형", None),
        ("CheckValve A형", None),
        ("", None),
    ],
)
def test_same_reading(text, want):
    assert lookalike.Matcher(NAMES).ref(text) == want


def test_unseen_differences(spark):
    t = spark.createDataFrame([("d", 0, 0, "estimate", ["N​O", "NO", None]), ("d", 0, 0, "estimate", ["N​O", "NO", None]), ("d", 0, 1, "bom", ["N​O"]), (None, None, None, None, None)], "doc_id string, section_ord int, table_ord int, domain string, headers array<string>")
    c = spark.createDataFrame([("d", 0, 0, 3, 0, "Check Valve A형", "x"), ("d", 0, 1, 3, 0, "Check Valve A형", "x"), ("d", 0, 0, 4, 0, None, "x")], "doc_id string, section_ord int, table_ord int, row_ord int, col_ord int, value string, ref_id string")
    got = lookalike.unseen_differences(t, c, [(1, "NO")], NAMES)
    assert sorted(tuple(r) for r in got.collect()) == [("d", 0, 0, -1, 0, 1), ("d", 0, 0, 3, 0, 1)]
    assert lookalike.unseen_differences(t.limit(0), c.limit(0), [(1, "NO")], NAMES).collect() == []


def test_consistent_column_form(spark):
    df = spark.createDataFrame([("Ｖａｌｖｅ",), ("plain",), (None,)], "v string")
    assert [r.o for r in df.select(lookalike.consistent_form(F.col("v"), NAMES).alias("o")).collect()] == ["Valve", "plain", None]


def exact_leaks(docs, items, n=10):
    out = set()
    for d, t in docs:
        w = leakage.words(t or "")
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, it in items:
            v = leakage.words(it or "")
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocab = ["a", "bb", "물량", "단위를", "plate", "12", "of", "밝히시오", "x9", "관"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(3, 30)))) for i in range(20)] + [(20, None), (21, "")]
    docs = [(0, None), (1, ""), (2, "짧은 글")]
    for d in range(3, 60):
        w = [rng.choice(vocab) for _ in range(40)]
        src = leakage.words(items[rng.randrange(20)][1])
        n = rng.choice([8, 9, 10, 12])
        w[5:5] = src[:n]
        text = rng.choice([", ", "  ", "\n"]).join(w)
        docs.append((d, rng.choice([text, text.upper(), unicodedata.normalize("NFD", text), text.replace("a", "​a")])))
    docs.append((99, ("filler " * 30_000) + items[0][1] + (" filler" * 1000)))
    df = spark.createDataFrame([(*x, "clash") for x in docs + docs[:3]], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    for blocks in (4_000_000, 300):
        got = leakage.leaks(df, it, block_chars=blocks).filter("exact_words >= 10").select("doc_id", "item_id").collect()
        assert {tuple(r) for r in got} == exact_leaks(docs, items)
    assert leakage.leaks(df.limit(0), it).collect() == []


def test_near_passages_within_budget(spark):
    item = "the insulation jacket overlaps many millimetres per joint across the long run of pipe"
    doc = item.replace("millimetres", "milimetres")
    r = leakage.leaks(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()
    assert len(r) == 1 and r[0].exact_words < 10 <= r[0].near_words


def test_script_consistency_beats_a_letter_table():
    model = lookalike.NgramScores(["PIPE", "COUPLING", "수량", "PRICE"])
    table = str.maketrans(lookalike.LOOKS)
    # a word of another script that only seems to hold Latin letters keeps its own
    for word in ("насос", "клапан", "Эскиз", "διάμετρος"):
        assert lookalike.consistent(word, model) == word != word.translate(table)
    for word in ("РIРЕ", "СОUPLING", "Ρrice".upper()):
        assert lookalike.consistent(word, model) in {"PIPE", "COUPLING", "PRICE"}
    assert lookalike.consistent("насос РIРЕ", model) == "насос PIPE"


TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("none", 0.1, 1)]


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(6)
    rows = [(i, "a" if i % 3 else "b" if i % 2 else "c", rng.randint(1, 60)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    have = {s: sum(t for _, x, t in rows if x == s) for s in "abc"}
    plan = mixing.plan_mix(have, TARGETS)
    got = mixing.place_documents(df, plan).toPandas()
    used = got.groupby("source").tokens.sum()
    for s, w, r in TARGETS[:3]:
        assert abs(used[s] / used.sum() - w) < 0.01
        assert got[got.source == s].groupby("doc_id").size().max() <= r
    assert got.groupby("doc_id").copy.apply(lambda c: sorted(c) == list(range(len(c)))).all()
    assert got.position.between(0, 1).all()
    # the share of each source in the first half follows the integral of its schedule
    half = got[got.position < 0.5].groupby("source").tokens.sum() / used
    for p in plan:
        assert abs(half[p.source] - p.share_before(0.5)) < 0.05


def test_mix_follows_given_schedules(spark):
    rng = random.Random(16)
    rows = [(i, "abc"[i % 3], rng.randint(1, 60)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    have = {s: sum(t for _, x, t in rows if x == s) for s in "abc"}
    own = {"a": ((0.0, 0.0), (0.5, 2.0), (0.5, 0.0), (0.8, 0.0), (1.0, 3.0)), "b": ((0.4, 1.0), (0.6, 5.0))}
    plan = mixing.plan_mix(have, TARGETS, schedules=own)
    got = mixing.place_documents(df, plan).toPandas()
    used = got.groupby("source").tokens.sum()
    for p in plan:
        for t in (0.1, 0.3, 0.5, 0.7, 0.9):
            here = got[(got.source == p.source) & (got.position < t)].tokens.sum() / used[p.source]
            assert abs(here - p.share_before(t)) < 0.03, (p.source, t)
        assert p.share_before(1.0) == pytest.approx(1.0) and p.share_before(0.0) == 0.0
    assert not ((got.source == "a") & (got.position > 0.51) & (got.position < 0.79)).any()
    for bad in ((), ((0.0, 0.0),), ((2.0, 1.0),), ((0.1, -1.0),)):
        with pytest.raises(ValueError):
            mixing.checked_schedule(bad)


def test_mix_with_a_total_beyond_a_source():
    plan = mixing.plan_mix({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 2)], total=100)
    assert {p.source: p.demand for p in plan} == {"a": 80, "b": 20}
    assert mixing.plan_mix({}, TARGETS) == [] and mixing.plan_mix({"a": 5}, [("a", 0.0, 1)]) == []


def test_token_counts_and_odd_documents(spark):
    d = spark.createDataFrame([(1, "a", "hello world", 7), (1, "a", "hello world", 7), (2, None, "x", 7), (3, "a", None, 7), (4, "a", "", 7), (None, "a", "x", 7)], "doc_id bigint, source string, text string, tokens int")
    assert [tuple(r) for r in mixing.sized_documents(d, mixing.TOKENIZER).collect()] == [(1, "a", len(mixing.encoding(mixing.TOKENIZER).encode_ordinary("hello world")))]


@pytest.mark.parametrize(
    "text",
    ["수신: %공사명% 귀중", "Dear {{ name }}, hello", "총액은 [금액 입력] 원이다.", "본 견적은 ○○○(고객사) 앞으로 한다.", "Please enable JavaScript to continue!", "자바스크립트를 켜야 볼 수 있습니다.", "<h1>Error 404</h1>", "Oops! (502) Service is down for upkeep.", '{"status": 500, "message": "x"}', "Lorem ipsum dolor sit amet tempor.", "Curabit massam velitis tempor porttia.", "좋은 글.\n여기에 본문 내용이 들어갑니다.", "20XX. XX. XX. 기준으로 작성", "Issued on [INSERT date HERE]."],
)
def test_residue_seeds(text):
    assert set(residue.units(text)) & set(residue.seed_keys())


@pytest.mark.parametrize(
    "text",
    ["The manual shows how a tag such as '{{client}}' is swapped.", "치환 변수(예: ${납기})를 쓰는 방법은 부록에 정리했다.", "The vendor portal asks for JavaScript, so we mailed the list.", "도면 3장을 접수했고 그중 오류가 있는 장은 없다.", "재료 할증은 5%로 본다.", "서버 장애가 났던 날의 보고서는 종이로 받았다.", "Lorem-style dummy copy was removed last year.", "a < b and c > d", ""],
)
def test_talk_is_no_residue(text):
    assert not set(residue.units(text)) & set(residue.seed_keys())


def test_labels_spread_along_near_duplicates(spark):
    d = spark.createDataFrame(
        [(1, "The page you asked for could not be located."), (2, "The page you asked for could not be located, sir."), (3, "A plain sentence about the pump house and its valves."), (4, None), (5, ""), (3, "A plain sentence about the pump house and its valves."), (6, "x" * 200_000), (None, "Try again in a few minutes."), (7, "Dear {{ client }}, see (draft) below."), (8, "a {{ client }} b " * 20_000)],
        "doc_id bigint, text string",
    ).withColumns({"label": F.lit("clash"), "seg": F.lit(1), "key": F.lit("clash")})
    got = {(r.doc_id, r.label, r.hop) for r in residue.residue_units(d).collect()}
    assert got == {(1, "error", 0), (2, "error", 1), (7, "placeholder", 0), (8, "placeholder", 0)}
    assert residue.residue_units(d.limit(0)).collect() == []


def frame(spark, keys):
    return residue.fingerprints(spark.createDataFrame(list(enumerate(keys)), "seg bigint, key string"))


def test_links_reach_most_of_brute_force(spark):
    rng = random.Random(9)
    seeds = [k for k in residue.seed_keys() if len(k) > 12]
    near = ["the page you asked for could not be located, sir", "please sign in again", "an unexpected problem has stopped this request", "찾을 수 없습니다만"]
    for s in seeds:
        for _ in range(30):
            x = list(s)
            for _ in range(rng.randint(1, 4)):
                i = rng.randrange(len(x))
                x[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "다", " x", "ab"])
            near.append("".join(x).strip() or "x")
    keys = seeds + sorted(set(near) - set(seeds))
    segs = frame(spark, keys).cache()
    got = {(r.seg, r.a) for r in residue.neighbours(segs, segs.filter(F.col("seg") < len(seeds))).collect()}
    grams = [residue.trigrams(k) for k in keys]
    want = {(i, j) for i in range(len(keys)) for j in range(len(seeds)) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= residue.SIMILARITY}
    assert len(want) > 1000 and got <= want and len(got) >= 0.97 * len(want)


def test_labels_reach_the_end_of_a_long_chain(spark):
    a, b = "the page you asked for could not be located", "now three blue pumps hum beside our old river gate"
    alike = lambda x, y: len(x & y) / len(x | y) >= residue.SIMILARITY
    keys = [b[:i] + a[i:] for i in range(len(a) + 1)]
    grams = [residue.trigrams(k) for k in keys]
    hops, reached = 0, {0}
    while more := {i for i in range(len(keys)) if i not in reached and any(alike(grams[i], grams[j]) for j in reached)}:
        reached |= more
        hops += 1
    assert hops > 6 and len(reached) == len(keys)
    segs = frame(spark, keys)
    got = residue.propagate(segs, spark.createDataFrame([(0, keys[0], "error")], "seg bigint, key string, label string")).collect()
    assert {r.seg for r in got} == reached and max(r.hop for r in got) > 6


def test_probes_hold_the_own_part_and_differ():
    m = residue._margins(*residue._gram_hashes(["service is down for upkeep", "단가는 부가세를 뺀 값이다"]))
    own = residue._packed(m).view(np.uint64)
    for t in range(residue.TABLES):
        part = (own >> np.uint64(16 * t)) & np.uint64(0xFFFF)
        p = residue.probes(m)[:, t]
        assert all(int(part[i]) in p[i] and len(set(p[i])) == 64 for i in range(2))


def test_simhash_distance_of_near_texts():
    a, b, c = residue.simhashes(["스크립트가 꺼져 있어 목록을 그리지 못했습니다", "스크립트가 꺼져 있어 목록을 그리지 못했습니다!", "단가는 부가세를 뺀 값이다"]).tolist()
    gap = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    assert gap(a, b) < gap(a, c)


def scan_rows(spark):
    body = ["the welding foreman tags the flange gaskets", "and the piping crew records the weld coupons", "near the cooling tower before the crane lift"]
    pages = []
    for d in range(12):
        for p in (1, 2):
            lines = [f"Tank Yard Spec | Rev.{d}  {p}", *body, *body, "Uncontrolled copy", f"- {p} -"]
            pages.append((f"D{d}", p, lines))
    pages[0][2][1] = "the welcling foreman tags the flange gaskets"
    pages[1][2][2] = "and the piping crew rec0rds the weld coup-"
    pages[1][2][3] = "ons near the cooling tower before the crane lift"
    pages[2][2][6] = "near the cooling tower before the cra-"
    pages[3][2][1] = "ne lift and the welding foreman tags"
    pages[4][2][7] = "Uncontrolied copy"
    rows = [(d, p, "\n".join(x), "clash") for d, p, x in pages]
    p = spark.createDataFrame(rows + rows[:2] + [("E", 1, None, ""), ("F", 1, "", ""), (None, 1, "x", "")], "doc_id string, page_num int, text string, noise string")
    s = spark.createDataFrame([("D0", 0, "the piping crew\nUncontrolled copy\n7 / 9\nrecords the weld coupons"), ("D0", 1, None)], "doc_id string, section_ord int, clean_text string")
    return p, s


def test_scan_repair(spark):
    r = scans.Repairs(*scan_rows(spark))
    got = {tuple(x) for x in r.found().collect()}
    assert {x for x in got if x[4] == "char"} == {("page", "D0", 1, 2, "char", "welding"), ("page", "D0", 2, 3, "char", "records")}
    assert {x for x in got if x[4] == "hyphen"} == {("page", "D0", 2, 3, "hyphen", "coupons"), ("page", "D1", 1, 7, "hyphen", "crane")}
    assert len([x for x in got if x[4] == "pageno"]) == 25 and ("section", "D0", 0, 3, "pageno", "") in got
    assert len([x for x in got if x[4] == "running"]) == 49 and ("page", "D2", 1, 8, "running", "") in got
    paras = {(x.place, x.doc_id, x.ord_no): x.text for x in r.paragraphs().collect()}
    assert paras["section", "D0", 0] == "the piping crew records the weld coupons"
    assert "records the weld coupons near the cooling tower" in paras["page", "D0", 2]
    assert paras["page", "D1", 1].endswith("before the crane") and paras["page", "D1", 2].startswith("lift and")


def test_scan_repair_of_nothing(spark):
    p, s = scan_rows(spark)
    r = scans.Repairs(p.limit(0), s.limit(0))
    assert r.found().collect() == [] and r.paragraphs().collect() == []


@pytest.mark.parametrize("line, want", [("- 3 -", True), ("Page 1 of 9", True), ("xiv", True), ("12", True), ("쪽 4", True), ("4쪽", True), ("3 / 12", True), ("3 SET", False), ("56.5", False), ("(9)", False), ("12.", False), ("mix", False)])
def test_page_numbers(line, want):
    assert bool(scans.PAGENO.match(line)) == want


def test_retrieval_is_complete(spark):
    rng = random.Random(8)
    vocab = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(3, 8))) for _ in range(80)})
    queries = sorted({w[:i] + rng.choice("abcd") + w[i + rng.randint(0, 1) :] for w in vocab for i in [rng.randrange(len(w))]})
    v = spark.createDataFrame(pd.DataFrame({"word": vocab, "n": [100] * len(vocab)}))
    q = spark.createDataFrame(pd.DataFrame({"word": queries, "n": [1] * len(queries)}))
    got = {(r.word, r.cand) for r in scans.retrieve(v, q).collect()}
    assert {(a, b) for a in queries for b in vocab if a != b and osa(a, b) <= 1} <= got


def test_misread_furniture_is_complete(spark):
    rng = random.Random(5)
    known = ["tank yard spec | rev.#", "한빛 플랜트 시방서 제#판", "uncontrolled copy", "the piping class index"]
    near = []
    for k in known:
        for _ in range(120):
            i = rng.randrange(len(k))
            near.append(k[:i] + rng.choice(["", "x", "rn", "m", "강", "ni"]) + k[i + rng.randint(0, 2) :])
    near = sorted(set(near) - set(known))
    want = set()
    for k in known:
        trie = scans.Trie()
        trie.add(jamo(k), k)
        want |= {x for x in near if len(x) >= 8 and any(True for _ in trie.within(Automaton(jamo(x), 1, scans.MERGES)))}
    lines = spark.createDataFrame([("text", i, k) for i, k in enumerate(known + near)], "kind string, kh bigint, key string")
    got = {r.key for r in scans.misread_furniture(lines, lines.filter(F.col("kh") < len(known))).collect()}
    assert len(want) > 100 and got == want


@pytest.mark.parametrize("token", ["word", "(word)", "-", "", "'a-b'.", "①관", "½.", "가.나"])
def test_bare_token(token):
    assert scans.bare(token) == token.strip("()-'.")


def test_a_word_of_its_own_is_no_misreading(spark):
    place = lambda i: ("page", f"D{i}", 1, 1, 0)
    seen = [(*place(i), "go", "crews", "home", "to", 500) for i in range(5)] + [(*place(i), "tray5", "cable", "and", "trays", 90) for i in range(10, 15)] + [(*place(20), "tbe", "x", "y", "the", 70)]
    df = spark.createDataFrame(seen, "place string, doc_id string, ord_no int, line_no int, pos int, word string, before string, after string, cand string, cand_n long")
    pairs = spark.createDataFrame([("cable", "trays"), ("up", "to")], "word string, after string")
    got = {(r.word, r.right) for r in scans.rank_in_context(df, pairs).collect()}
    assert got == {("tray5", "trays"), ("tbe", "the")}


def test_report_names_every_entry_within_distance(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "QUANTITY", None, None), (2, "QUANTITIES", None, None), (3, "수량", None, None)], "header_id int, label string, label_en string, label_hanja string").write.parquet(f"{d}/canonical_headers.parquet")
    cols = "doc_id string, section_ord int, table_ord int, domain string, headers array<string>"
    spark.createDataFrame([("a", 0, 0, "estimate", ["QUANTITTY", "QUANTITIEZ", "zzzzzzzz", None, "수량", ""]), ("b", 0, 0, "bom", ["QUANTITTY"])], cols).write.parquet(f"{d}/doc_tables.parquet")
    got = {r.header: r for r in canonical.p2_values(spark, d).collect()}
    assert (got["QUANTITTY"].header_id, got["QUANTITTY"].errors) == (1, 1) and [x.header_id for x in got["QUANTITIEZ"].within][0] == 2
    assert (got["zzzzzzzz"].header_id, got["zzzzzzzz"].matched, got["zzzzzzzz"].errors, got["zzzzzzzz"].within) == (0, None, None, [])
    c = canonical.Canonicaliser([(1, ["QUANTITY"]), (2, ["QUANTITIES"]), (3, ["수량"])])
    for h, r in got.items():
        assert {x.header_id for x in r.within} == {i for _, _, i, _ in c.candidates(h)}
