"""Mapping freely typed values to the entries of a reference list.

The reference names and their aliases are paths of one trie; a typed value is
cleaned of decoration and searched with a Levenshtein automaton whose number of
errors depends on the value's length. The list is fixed and small, so the trie
is built in every task and values are mapped where they lie: no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.automaton import Automaton, Trie, jamo
from quirelake.llm.lookalike import NgramScores, consistent
from quirelake.sources.tables import table

# Other names of single words and whole names, as written in trade documents.
WORD_ALIASES: dict[str, tuple[str, ...]] = {
    "AMOUNT": ("AMT",),
    "UNIT PRICE": ("U/PRICE", "UNIT PR.", "UP"),
    "MATERIAL": ("MAT'L", "MATL"),
    "LABOR": ("LABOUR",),
    "EXPENSE": ("EXP.",),
    "INSULATION": ("INSUL.",),
    "INSPECTION": ("INSP.",),
    "CALCULATION": ("CALC.",),
    "INSTALLATION": ("INSTALL",),
    "DRAWING": ("DWG", "DRG."),
    "THICKNESS": ("THK", "THK."),
    "SPECIFICATION": ("SPEC",),
    "PAINTING": ("PAINT",),
    "DESCRIPTION": ("DESC", "DESCR"),
    "NAME": ("NM",),
    "재료비": ("재료", "자재비"),
    "노무비": ("노무", "인건비"),
}
NAME_ALIASES: dict[str, tuple[str, ...]] = {
    "번호": ("순번", "일련번호", "NR", "NO."),
    "품명": ("품목", "품목명", "ITEM"),
    "명칭": ("내역 명칭", "공사명칭"),
    "규격": ("사양",),
    "단위": ("U/M", "UOM"),
    "수량": ("Q'TY", "QTY", "소요수량"),
    "금액": ("AMT",),
    "비고": ("RMK", "REMARK", "NOTE"),
    "합계 금액": ("총 합계 금액", "총합계"),
    "재질": ("MAT'L", "MATL"),
    "중량": ("WT", "무게"),
    "제조사": ("MAKER", "MFR", "메이커", "제조자", "제작사"),
    "납기": ("DELIV", "DELIVERY DATE", "납품기한", "납품일"),
    "도면번호": ("도면 NO", "DWG NO."),
    "길이": ("LEN", "L(MM)"),
    "두께": ("THK.(T)",),
    "할증률": ("할증", "할증율", "LOSS", "LOSS(%)"),
    "설치위치": ("위치", "설치장소", "LOC"),
    "공급처": ("공급업체", "VENDOR NAME"),
    "산출근거": ("산출내역근거", "산출 내역"),
    "설치비": ("설치비용",),
    "운반비": ("운반비용", "FREIGHT"),
    "검사방법": ("검사 방식",),
    "보온두께": ("보온 T", "보온 두께(T)"),
    "도장사양": ("도장사양서", "도장 사양"),
}
#: Marks before and after a name that are no part of it.
LEAD = re.compile(r"^(?:[\s*‥….,:;/\-–—(\[{<「【]|\d+\))+")
TAIL = re.compile(r"[\s*‥….,:;/\-–—)\]}>」】]+$")
NOTE = re.compile(r"(?<=\S)\s*[(\[][^()\[\]]*[)\]]?$")
COLUMN_WORD = re.compile(r"(?<=..)(?:란|별)$")


def search_key(text: str) -> str:
    """Letters and digits of `text`, case and compatibility forms removed, Hangul as letters."""
    t = unicodedata.normalize("NFKC", text).casefold()
    return jamo("".join(c for c in t if c.isalnum()))


def stripped_forms(text: str) -> list[str]:
    """`text` and what is left of it as decoration is taken off, in that order."""
    forms = [text]
    t = TAIL.sub("", LEAD.sub("", text))
    if text.count("(") == text.count(")") and t.count("(") > t.count(")"):
        forms.append(t + ")")
    forms.append(t)
    for rule in (NOTE, TAIL, COLUMN_WORD, NOTE, COLUMN_WORD):
        t = rule.sub("", t)
        forms.append(t)
    out = []
    for f in forms:
        if f and f not in out:
            out.append(f)
    return out


def allowed_errors(key: str) -> int:
    """None up to 3 letters, 1 up to 9, 2 beyond; Han names count as they are long."""
    n = len(key)
    return 0 if n <= 3 else 1 if n <= 9 else 2


def alias_paths(name: str) -> list[str]:
    """All spellings of a name that its words' aliases give, the name first."""
    out = [name]
    for word, others in WORD_ALIASES.items():
        pattern = re.compile(rf"(?<![A-Z가-힣]){re.escape(word)}(?![A-Z가-힣])")
        out += [pattern.sub(o.replace("\\", ""), n) for n in list(out) if n != word and pattern.search(n) for o in others]
        if name == word:
            out += others
    return list(dict.fromkeys(out))


class Canonicaliser:
    """Reference entries: id and up to several names each."""

    def __init__(self, entries: list[tuple[int, list[str]]]) -> None:
        self.exact = {n for _, names in entries for n in names}
        self.model = NgramScores(self.exact)
        self.trie = Trie()
        seen: set[tuple[str, int]] = set()
        for i, names in entries:
            paths = [(p, 0) for n in names for p in [n]]
            paths += [(p, 1) for n in names for p in [*alias_paths(n)[1:], *NAME_ALIASES.get(n, ())]]
            for p, alias in paths:
                k = search_key(p)
                if (k, i) not in seen:
                    seen.add((k, i))
                    self.trie.add(k, (alias, i, p))
        self.known: dict[str, list[tuple[int, int, int, str]]] = {}

    def candidates(self, value: str) -> list[tuple[int, int, int, str]]:
        """(errors, is alias, id, path) of every entry within the allowed distance, best first.

        Forms with more decoration taken off are searched as long as nothing is
        found, so a name that itself ends like decoration is not cut.
        """
        if value in self.known:
            return self.known[value]
        got: list[tuple[int, int, int, str]] = []
        for form in stripped_forms(consistent(value, self.model)):
            key = search_key(form)
            if not key:
                continue
            hits = [(e, a, i, p) for e, (a, i, p) in self.trie.within(Automaton(key, allowed_errors(key)))]
            got = sorted(set(got) | set(hits))
            if got and got[0][0] == 0:
                break
        if len(self.known) < 1_000_000:
            self.known[value] = got
        return got

    def best(self, value: str) -> int:
        """Id of the entry meant, 0 if there is none."""
        c = self.candidates(value)
        return c[0][2] if c else 0


def header_entries(spark, sf_dir: str) -> list[tuple[int, list[str]]]:
    rows = table(spark, sf_dir, "canonical_headers").collect()  # fixed size
    return [(r.header_id, [n for n in (r.label, r.label_en, r.label_hanja) if n]) for r in sorted(rows, key=lambda r: r.header_id)]


def map_values(rows: DataFrame, keys: list[str], value: str, entries: list[tuple[int, list[str]]], out: str) -> DataFrame:
    """`keys` + `out`: the entry each value that is no exact name stands for, 0 if none.

    Null values give no row. Ties go to the fewest errors, then to a name before
    an alias, then to the smaller id.
    """
    types = dict(rows.dtypes)
    exact = [n for _, names in entries for n in names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Canonicaliser(entries)
        for pdf in batches:
            o = pdf[keys].copy()
            o[out] = [c.best(v) for v in pdf["_v"]]
            yield o

    picked = rows.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.col("_v").isin(exact))
    return picked.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", {out} int")


def estimate_headers(tables: DataFrame) -> DataFrame:
    """(doc_id, section_ord, table_ord, col_ord, header) of estimate tables, repeated rows once."""
    return tables.filter("domain = 'estimate'").select("doc_id", "section_ord", "table_ord", F.posexplode("headers").alias("col_ord", "header"))


def p2_found(spark, sf_dir: str) -> DataFrame:
    h = estimate_headers(table(spark, sf_dir, "doc_tables"))
    return map_values(h, ["doc_id", "section_ord", "table_ord", "col_ord"], "header", header_entries(spark, sf_dir), "header_id").distinct()


def p2_values(spark, sf_dir: str) -> DataFrame:
    """(header, n, header_id, matched, errors, within): the report over distinct typed headers.

    within holds every entry within the allowed distance, once each by its best
    path: id, path and errors, best first. header_id 0 and null matched are the
    unmatched values.
    """
    entries = header_entries(spark, sf_dir)

    def row(found: list[tuple[int, int, int, str]]) -> dict:
        best: dict[int, dict] = {}
        for e, _, i, path in found:
            best.setdefault(i, {"header_id": i, "path": path, "errors": e})
        first = next(iter(best.values()), {"header_id": 0, "path": None, "errors": None})
        return {"header_id": first["header_id"], "matched": first["path"], "errors": first["errors"], "within": list(best.values())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Canonicaliser(entries)
        for pdf in batches:
            got = pd.DataFrame([row(c.candidates(v)) for v in pdf["header"]], columns=["header_id", "matched", "errors", "within"], index=pdf.index)
            got["errors"] = got["errors"].astype("Int32")
            yield pd.concat([pdf[["header", "n"]], got], axis=1)

    n = estimate_headers(table(spark, sf_dir, "doc_tables")).filter("header is not null").distinct().groupBy("header").agg(F.count(F.lit(1)).alias("n"))
    return n.mapInPandas(run, "header string, n bigint, header_id int, matched string, errors int, within array<struct<header_id: int, path: string, errors: int>>")
