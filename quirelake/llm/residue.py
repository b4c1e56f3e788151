"""Template residue, filler, error pages and script notices in documents.

A document is cut into units: its lines and sentences, the heads of status lines,
and the bracketed spans inside them. Each unit is brought to a key in which
numbers, the names inside brackets and runs of dummy text are masked. A small set
of labelled keys (`seed_keys`) is the only source of labels. Near-duplicates of a
labelled key are looked up in four tables, one a 16-bit part of the 64-bit SimHash;
a query is looked up under its own part and under those that differ in its least
certain bits. Candidates are verified by Hamming distance and by trigram
similarity, and labels spread along verified links until a round adds nothing:
connected components, restricted to those that hold a trusted label, so links
among ordinary sentences are never made. A document with a labelled unit is
residue.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from xxhash import xxh64_intdigest

from quirelake.plans.lineage import cut
from quirelake.plans.sizes import broadcast_if_small
from quirelake.sources.tables import table

#: Links of similarity 0.8 lie at a distance of about 10 (standard deviation 3), unrelated units at 32.
HAMMING = 24
SIMILARITY = 0.8
#: Tables, bits of the fingerprint in each, and least certain bits of a part that a query also looks up flipped.
TABLES, PART, FLIPS = 4, 16, 6
#: Rows of probes that may be broadcast: three numbers each.
PROBE_ROWS = 500_000
MASK = "⟦⟧"

_HTML = "html|head|body|title|h[1-6]|hr|br|p|div|span|a|b|i|u|em|strong|ul|ol|li|table|thead|tbody|tr|td|th|pre|code|center|font|img|nav|header|footer|main|section|article|small|sup|sub|script|noscript|style|form|input|button|label|meta|link"
_TAG = re.compile(rf"<!--.*?-->|</?(?:{_HTML})\b[^<>]*>", re.IGNORECASE | re.DOTALL)
_NAME = r"[^\W\d_][^\[\]{}<>«»()%@\n]{0,48}?"
#: Spans in brackets or blanks to be written over, of any meaning; what they mean is decided by their key.
SPAN = re.compile(
    rf"""\{{\{{\s*{_NAME}\s*\}}\}} | \{{%\s*{_NAME}\s*%\}} | \[\[\s*{_NAME}\s*\]\] | <<\s*{_NAME}\s*>> | «\s*{_NAME}\s*» | @@\s*{_NAME}\s*@@
    | [$\#]?\{{\s*{_NAME}\s*\}} | __{_NAME}__ | %[^\W\d_]\w{{0,30}}(?:\s\w+)?% | <{_NAME}> | \[\s*{_NAME}\s*\]
    | ○{{2,}}\s*\({_NAME}\) | \({_NAME}(?:\([^()]{{1,3}}\)[^()]{{0,40}})?\)
    | \d*○{{2,}}(?:년(?:\s*○+월)?(?:\s*○+일)?|(?:,○{{3}})+) | X{{3}}-{_NAME}-X{{3}} | \b\d\dXX(?:[.\-/년]\s*XX[.\-/월]?){{1,2}}
    | \btodo:\s*\w+(?:\s(?:in|here))?\s+\w+""",
    re.VERBOSE | re.IGNORECASE,
)
#: Around a span: the text speaks about the notation and does not leave it unfilled.
BEFORE = re.compile(r"(?:['\"“‘`「]|예\s*[:：]|e\.g\.|such as|like|변수|태그|표기|기호|notation|variable|tag|token)[\s(]*$", re.IGNORECASE)
AFTER = re.compile(r"^\s*(?:['\"”’`」]|\)?\s*(?:라는|이라는|표기|기호|변수|구문|notation|syntax|token|tag|variable|placeholder)\b)", re.IGNORECASE)
# Words that ask for a value; inside a span they stay, all else is masked.
CUES = ("insert", "enter", "your", "add", "here", "goes", "todo", "fill", "write", "입력하세요", "입력", "기재", "미정", "추후", "여기에", "을(를)")
_CUE = re.compile("|".join(map(re.escape, CUES)) + r"|\bin\b", re.IGNORECASE)
# The customary dummy text's words.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur "
    "sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum curabitur pellentesque habitant morbi tristique senectus netus "
    "malesuada fames ac turpis egestas vestibulum pharetra faucibus porttitor massa ornare nullam"
).split()
_LOREM_STEMS = {w[:4] for w in LOREM if len(w) >= 4} | {"ipsa"}
DUMMY = "⟦dummy⟧"

# Labelled examples, sentences that are residue as a whole.
SEEDS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("placeholder", (
        "{{name}}", "{name}", "${name}", "#{name}", "{% name %}", "[[name]]", "<<name>>", "«name»", "@@name@@", "__name__", "%name%", "<name>", "<enter name>",
        "[insert name here]", "[enter name]", "[name goes here]", "[your name]", "[add name]", "[여기에 name]", "[name 입력]", "[name 기재]", "[name 미정 - 추후 기재]",
        "(name을(를) 입력하세요)", "○○○(name)", "20○○년", "20○○년 ○월 ○일", "○○○,○○○", "XXX-name-XXX", "20XX. XX. XX.", "20XX. XX.", "TODO: fill in name", "TODO: add name", "TODO: insert name",
    )),
    ("filler", (
        DUMMY, "asdf asdf qwer asdf", "test test test 1", "가나다라 마바사아 자차카타파하",
        "여기에 본문 내용이 들어갑니다.", "샘플 내용으로 채워진 문단입니다.", "제목을 넣어 주세요.", "텍스트를 입력하는 자리입니다.", "예시 문장입니다.",
        "Sample paragraph text, replace before publishing.", "Type your description in this box.", "Placeholder copy for layout only.", "Your text goes here.", "This is a sample page.",
    )),
    ("error", (
        "접속 오류(404)", "오류 404", "Error 404", "HTTP 404", "Status: 404", "Oops! (404)", "404 - request failed", "404 오류가 발생했습니다", "trace 1a2b3c4d", "reference id 1a2b3c4d", "request id 1a2b3c4d",
        "식별 번호 1a2b3c4d", "추적 번호 1a2b3c4d", "trace n/a", '{"status": 404, "message": "a"}', '{"code": 404, "message": "a"}', '{"error": "a"}', "reference id n/a", "식별 번호 n/a", "at handler.render (view:1)",
        "요청하신 페이지를 찾을 수 없습니다.", "접근 권한이 없는 문서입니다.", "서버 응답 시간이 지났습니다.", "시스템 점검 중이라 이용할 수 없습니다.", "일시적인 장애로 내용을 표시하지 못했습니다.",
        "로그인 시간이 만료되었으니 다시 접속해 주세요.", "The page you asked for could not be located.", "The requested page was not found.", "You do not have permission to view this resource.",
        "The server took too long to answer.", "Service is down for upkeep.", "An unexpected problem stopped this request.", "Your session has run out, sign in again.", "The database link was lost.",
        "처음 화면으로 돌아가기", "문제가 이어지면 관리자에게 알려 주세요.", "잠시 후 다시 시도해 주십시오.", "Go back to the start page.", "Try again in a few minutes.", "If this goes on, tell the administrator.",
    )),
    ("script", ("스크립트가 꺼져 있어 목록을 그리지 못했습니다.", "Loading… (scripts are blocked)", "noscript: interactive table unavailable")),
)
# Halves of script notices; each first half goes with each second one of its language.
NOTICES: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
    (
        ("자바스크립트를 켜야", "JavaScript 사용 설정을 해야", "브라우저에서 스크립트 실행을 허용해야", "스크립트 차단을 풀어야", "자바 스크립트(JS) 기능을 활성화해야"),
        ("볼 수 있습니다", "이 페이지를 볼 수 있습니다", "계속할 수 있습니다", "표를 불러올 수 있습니다", "견적 포털을 이용할 수 있습니다", "도면 보기가 열립니다"),
    ),
    (
        ("Please turn on JavaScript", "You need to enable JS", "Scripts must be allowed", "Kindly activate scripting", "JavaScript is required", "Please enable JavaScript"),
        ("to continue", "to use the quote portal", "to view this content", "so that the table can be drawn", "for the parts list to appear", "before the drawing viewer can load"),
    ),
    (
        ("Your browser has scripting switched off; change that", "We noticed that client-side code is blocked; permit it"),
        ("to continue", "to use the quote portal", "to view this content", "so that the table can be drawn", "for the parts list to appear", "before the drawing viewer can load"),
    ),
)

#: Ends of lines and sentences; Korean sentences also end without a mark.
# The test of one character comes first: most places of a text fail it.
_CUT = re.compile(r"(?=[\s\"'”’])(?:[\r\n]+|\s+and\s+(?=\w+[.!](?:\s|$))|(?<!XX\.)(?<=[.!?。])[\"'”’]?\s+|(?<=습니다)\s+|(?<=\d\))\s+|(?<=[a-z]\))\s+(?=[A-Z가-힣]))")
#: A status line's number with what leads to it, before a sentence on the same line.
_HEAD = re.compile(r"^(?:[^\W\d]+[\s:!(]{1,2}){0,3}\(?[45]\d\d\)?(?:\s*-\s*request failed|\s*오류가 발생했습니다)?(?:\s*[:.\-])?(?=\s|$)", re.IGNORECASE)
_NOTE = re.compile(r"^(?:알림|요청 실패|안내|notice)\s*[:.\-]?\s+", re.IGNORECASE)
_TEXT = re.compile(r"\"([^\"]*)\"(?=\s*[,}])")
_ODD = {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None, 0x200E: None, 0x200F: None}
_UNSEEN = tuple(map(chr, _ODD))
_DIGIT = re.compile(r"\d")
_MAY_SPAN = re.compile(r"[{\[<«○(]|@@|__|XX|todo:|%[^\W\d]", re.IGNORECASE)
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")




def segments(text: str) -> list[str]:
    """Lines and sentences of a document without markup, heads of status lines on their own."""
    t = text.translate(_ODD) if any(c in text for c in _UNSEEN) else text
    if "<" in t:
        t = _TAG.sub("\n", t)
    out = []
    for s in map(str.strip, _CUT.split(t)):
        if s.startswith('{"') and "}" in s:
            body, rest = s[: s.rindex("}") + 1], s[s.rindex("}") + 1 :]
            out += [_TEXT.sub('"a"', body), *_TEXT.findall(body), rest.strip()]
        elif head := _HEAD.match(s) if "4" in s[:32] or "5" in s[:32] else None:
            out += [head.group(0), s[head.end() :].strip()]
        else:
            out.append(s)
    return [s for s in out if s]


def _masked(s: str) -> str:
    return " ".join((_HEX.sub("0", s) if _DIGIT.search(s) else s).split()).strip(" .!?\"'")


def span_key(span: str) -> str:
    """The notation of a span: its marks and asking words stay, its name is `a`."""
    out, at = [], 0
    s = unicodedata.normalize("NFKC", span).casefold()
    for m in _CUE.finditer(s):
        out += [re.sub(r"[^\W\d_○x][\w .\-/]*", "a", s[at : m.start()]), m.group(0)]
        at = m.end()
    out.append(re.sub(r"[^\W\d_○x][\w .\-/]*(?<!-)", "a", s[at:]))
    return MASK + re.sub(r"\s+", "", _HEX.sub("0", "".join(out)))


def segment_key(segment: str) -> str:
    """Comparable form of a line or sentence: spans, numbers and dummy text masked, case and end marks off."""
    s = SPAN.sub(MASK, segment) if _MAY_SPAN.search(segment) else segment
    s = (s if s.isascii() else unicodedata.normalize("NFKC", s)).casefold()
    if "a" <= s[-2:-1] <= "z":
        w = s.split()
        dummy = [x[:4] in _LOREM_STEMS for x in w]
        if len(w) >= 4 and sum(dummy) >= 0.6 * len(w):
            return DUMMY
    return _masked(_NOTE.sub("", s))


def units(text: str) -> list[str]:
    """Keys of all units of a document, once each."""
    out = {}
    for s in segments(text):
        out[segment_key(s)] = None
        if _MAY_SPAN.search(s):
            for m in SPAN.finditer(s):
                if not (BEFORE.search(s, max(0, m.start() - 40), m.start()) or AFTER.search(s[m.end() : m.end() + 40])):
                    out[span_key(m.group(0))] = None
    out.pop("", None)
    out.pop(MASK, None)
    return list(out)


def seed_keys() -> dict[str, str]:
    """key -> label of the labelled examples."""
    out = {span_key(x) if kind == "placeholder" else x if x == DUMMY else segment_key(segments(x)[0]): kind for kind, texts in SEEDS for x in texts}
    return out | {segment_key(f"{a} {b}"): "script" for first, second in NOTICES for a in first for b in second}


def trigrams(key: str) -> set[str]:
    s = f"  {key} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _gram_hashes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all trigrams of all keys, and how many each key has.

    Three code points are mixed one to one into 64 bits: different trigrams never
    have equal hashes.
    """
    texts = [f"  {k} " for k in keys]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    grams = sizes - 2
    first = np.cumsum(sizes) - sizes
    at = np.repeat(first - (np.cumsum(grams) - grams), grams) + np.arange(int(grams.sum()))
    h = (codes[at] << np.uint64(42)) ^ (codes[at + 1] << np.uint64(21)) ^ codes[at + 2]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31)), grams


def _margins(h: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Twice the share of trigrams that have each of 64 bits set, less one; its sign is the SimHash."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(grams) - grams, axis=0, dtype=np.int32)
    return (ones * 2 - grams[:, None]) / grams[:, None]


def _packed(margins: np.ndarray) -> np.ndarray:
    return np.packbits(margins > 0, axis=1, bitorder="little").view(np.int64).ravel()


def simhashes(keys: list[str]) -> np.ndarray:
    """64-bit SimHash of each key's character trigrams, signed, a batch at once."""
    return _packed(_margins(*_gram_hashes(keys)))


def probes(margins: np.ndarray) -> np.ndarray:
    """(keys, TABLES, 2 ** FLIPS) parts that each key is looked up under.

    Of every part the FLIPS bits of least margin are flipped in all combinations:
    those are the bits in which a near-duplicate differs most often.
    """
    own = _packed(margins).view(np.uint64)
    out = np.empty((len(margins), TABLES, 1 << FLIPS), dtype=np.int64)
    for t in range(TABLES):
        part = ((own >> np.uint64(t * PART)) & np.uint64((1 << PART) - 1)).astype(np.int64)
        weak = np.abs(margins[:, t * PART : (t + 1) * PART]).argsort(axis=1, kind="stable")[:, :FLIPS]
        masks = np.zeros((len(margins), 1), dtype=np.int64)
        for j in range(FLIPS):
            masks = np.concatenate([masks, masks ^ (1 << weak[:, j : j + 1])], axis=1)
        out[:, t] = part[:, None] ^ masks
    return out


def size_class(grams: np.ndarray) -> np.ndarray:
    """Class of a trigram count: counts of similar keys differ by at most one class."""
    return np.floor(np.log(grams) / np.log(1 / SIMILARITY)).astype(np.int64)


def _unit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        docs, keys = [], []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            own = units(text)
            docs += [doc] * len(own)
            keys += own
        yield pd.DataFrame({"doc_id": docs, "seg": [xxh64_intdigest(k.encode("utf-8", "surrogatepass")) - (1 << 63) for k in keys], "key": keys})


def _distinct_grams(h: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Distinct trigrams of each key; 44 bits of a hash tell those of one key apart."""
    owner = np.repeat(np.arange(len(grams), dtype=np.uint64), grams)
    packed = np.sort((owner << np.uint64(44)) | (h >> np.uint64(20)))
    new = np.append(True, packed[1:] != packed[:-1])
    return np.bincount((packed[new] >> np.uint64(44)).astype(np.int64), minlength=len(grams))


def _fingerprint_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), 1000):
            part = pdf.iloc[i : i + 1000]
            keys = part["key"].tolist()
            h, n = _gram_hashes(keys)
            yield part.assign(fp=_packed(_margins(h, n)), z=size_class(_distinct_grams(h, n)).astype(np.int32))


def fingerprints(keys: DataFrame) -> DataFrame:
    """`keys` (seg, key) with fp and z: SimHash and size class."""
    return keys.select("seg", "key").mapInPandas(_fingerprint_rows, "seg bigint, key string, fp bigint, z int")


def _probe_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), 200):
            part = pdf.iloc[i : i + 200]
            keys = part["key"].tolist()
            h, grams = _gram_hashes(keys)
            m = _margins(h, grams)
            p = probes(m) | (np.arange(TABLES)[None, :, None] << PART)
            z = size_class(_distinct_grams(h, grams))
            p = p[:, None] | ((z[:, None] + np.array([0, 1, 2])) << (PART + 2))[:, :, None, None]
            n = p[0].size
            yield pd.DataFrame({"at": p.ravel(), "a": np.repeat(part["seg"].to_numpy(), n), "fa": np.repeat(_packed(m), n)})


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        p, q = trigrams(x), trigrams(y)
        return len(p & q) / len(p | q)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def neighbours(segs: DataFrame, asked: DataFrame) -> DataFrame:
    """(seg, a, similarity) of the keys of `segs` that are near-duplicates of keys of `asked`.

    `segs` is (seg, key, fp, z), `asked` (seg, key). Rows of `segs` are read in place
    as long as the probes are few enough to be broadcast; their texts are
    fetched for candidates only.
    """
    look = cut(asked.select("seg", "key").mapInPandas(_probe_rows, "at bigint, a bigint, fa bigint"))
    z = (F.col("z").cast("bigint") + 1) * (1 << (PART + 2))
    entries = F.array(*[F.shiftrightunsigned("fp", t * PART).bitwiseAND((1 << PART) - 1) + (t << PART) + z for t in range(TABLES)])
    near = segs.select("seg", "fp", F.explode(entries).alias("at")).join(broadcast_if_small(look, PROBE_ROWS), "at").filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fa"))) <= HAMMING)
    near = cut(near.select("seg", "a").distinct())
    texts = segs.select("seg", "key").join(broadcast_if_small(near), "seg").join(broadcast_if_small(asked.select(F.col("seg").alias("a"), F.col("key").alias("ka"))), "a")
    return texts.select("seg", "a", _similarity("key", "ka").alias("similarity")).filter(F.col("similarity") >= SIMILARITY)


def propagate(segs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seg, label, hop): `segs` (seg, key, fp, z) that links tie to `seeds` (seg, key, label).

    A link needs a trigram similarity of at least SIMILARITY and a Hamming distance
    of at most HAMMING. hop 0: the key is that of a seed; hop n: reached in round
    n. Of two labels that reach a key in one round the alphabetically first
    stands. Rounds go on until one adds nothing.
    """
    frontier, known = cut(seeds.select("seg", "key", "label")), None
    for hop in itertools.count(1):
        links = neighbours(segs, frontier).join(broadcast_if_small(frontier.select(F.col("seg").alias("a"), "label")), "a")
        got = links.groupBy("seg").agg(F.min("label").alias("label"), F.max(F.col("seg") == F.col("a")).alias("self"))
        if known is not None:
            got = got.join(broadcast_if_small(known.select("seg")), "seg", "left_anti")
        same = F.lit(hop == 1) & F.col("self")
        added = cut(got.select("seg", "label", F.when(same, 0).otherwise(hop).alias("hop")))
        if added.limit(1).count() == 0:
            return added if known is None else known
        known = added if known is None else cut(known.unionByName(added))
        frontier = cut(segs.select("seg", "key").join(broadcast_if_small(added.select("seg", "label")), "seg"))


def residue_units(docs: DataFrame) -> DataFrame:
    """(doc_id, label, seg, hop) of every residue unit of every document.

    hop is the number of links from a labelled example, 0 if the key is one.
    Null or empty texts have no unit; rows without doc_id are left out; repeated
    rows count once; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = cut(docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(_unit_rows, f"doc_id {dict(docs.dtypes)['doc_id']}, seg bigint, key string"))
    segs = cut(fingerprints(rows.groupBy("seg").agg(F.first("key").alias("key"))))
    seeds = spark.createDataFrame([(xxh64_intdigest(k.encode()) - (1 << 63), k, label) for k, label in seed_keys().items()], "seg bigint, key string, label string")
    return rows.select("doc_id", "seg").join(broadcast_if_small(propagate(segs, seeds)), "seg").select("doc_id", "label", "seg", "hop").distinct()


def p9_found(spark, sf_dir: str) -> DataFrame:
    return residue_units(table(spark, sf_dir, "documents")).select("doc_id").distinct()


def p9_report(spark, sf_dir: str) -> DataFrame:
    """(doc_id, labels, segments, hops): what residue each found document holds; hops 0 if an example's key is among it."""
    r = residue_units(table(spark, sf_dir, "documents"))
    return r.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.count_distinct("seg").alias("segments"), F.min("hop").alias("hops"))


def p9_clean(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars) of the documents without residue."""
    docs = table(spark, sf_dir, "documents")
    bad = residue_units(docs).select("doc_id").distinct()
    return docs.select("doc_id", "n_chars").join(bad, "doc_id", "left_anti").distinct()
