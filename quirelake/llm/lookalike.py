"""One consistent form for text that looks the same.

Three steps: delete ignorable characters, apply the compatibility mappings that
keep the picture of a character, then choose among look-alike letters by a
Viterbi search over the token's lattice of look-alikes, scored by character
n-grams and by script consistency.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.sources.tables import table

# Letters of other scripts and the Latin letters they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮԌԚԜҺаеѕіјорсухһԁԛԝӏ"
CYRILLIC_AS = "ABESIJKMHOPCTYXYGQWhaesijopcyxhdqwl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ"
GREEK_AS = "ABEZHIKMNOPTYXCjovc"
# Hyphens and middle dots of one picture.
HYPHENS = "‐‑−﹣－˗⁃"
DOTS = "··‧∙⋅ㆍ・･᛫⸱ꞏ"
#: Compatibility mappings that leave the picture of a character as it is.
SAME_PICTURE = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
#: Drawn blank, though not of category Cf.
FILLERS = "ᅟᅠㅤﾠ͏឴឵"

LOOKS: dict[str, str] = {}
for _own, _latin in (*zip(CYRILLIC, CYRILLIC_AS), *zip(GREEK, GREEK_AS)):
    LOOKS[_own] = _latin
ALIKE: dict[str, tuple[str, ...]] = {}
for _c, _latin in LOOKS.items():
    ALIKE.setdefault(_latin, (_latin,))
    ALIKE[_latin] += (_c,)
for _c, _latin in LOOKS.items():
    ALIKE[_c] = ALIKE[_latin]


@lru_cache(maxsize=65536)
def picture(c: str) -> str:
    """The form one character is brought to; '' for ignorable ones."""
    if c in HYPHENS:
        return "-"
    if c in DOTS:
        return "·"
    cat = unicodedata.category(c)
    if cat == "Cf" or c in FILLERS or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef":
        return ""
    if cat == "Zs":
        return " "
    d = unicodedata.decomposition(c)
    if d and (not d.startswith("<") or d.split()[0] in SAME_PICTURE):
        # a decomposed accent or syllable is composed again by fold()
        return unicodedata.normalize("NFKC", c)
    return c


def fold(text: str) -> str:
    """Compatibility normalisation that keeps the picture, ignorables deleted, NFC."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", "".join(map(picture, text)))


@lru_cache(maxsize=65536)
def script(c: str) -> str:
    """L, C, G for the scripts whose letters are confused; '' for all else."""
    if c.isascii():
        return "L" if c.isalpha() else ""
    name = unicodedata.name(c, "")
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(name.split(" ")[0], "")


class NgramScores:
    """Log scores of a character after its two predecessors.

    Counts of trigrams and bigrams of `texts`, interpolated with a uniform
    background. `switch` is the penalty for two letters of different confused
    scripts in one token.
    """

    def __init__(self, texts: Iterable[str], switch: float = 6.0) -> None:
        self.tri, self.bi, self.uni = Counter(), Counter(), Counter()
        self.switch = switch
        for t in texts:
            s = "\x02\x02" + fold(t) + "\x03"
            for i in range(2, len(s)):
                self.tri[s[i - 2 : i + 1]] += 1
                self.bi[s[i - 1 : i + 1]] += 1
                self.uni[s[i - 1]] += 1
        self.ctx = Counter()
        for k, n in self.tri.items():
            self.ctx[k[:2]] += n

    def score(self, a: str, b: str, c: str) -> float:
        p = 1e-5
        if n := self.uni[b]:
            p += 0.3 * self.bi[b + c] / n
        if n := self.ctx[a + b]:
            p += 0.6 * self.tri[a + b + c] / n
        return math.log(p)


def best_path(token: str, model: NgramScores) -> str:
    """The likeliest reading of a folded token among its look-alike spellings.

    States are (previous, current) letters; beam-free, so the search is exact.
    """
    states: dict[tuple[str, str, str], tuple[float, str]] = {("\x02", "\x02", ""): (0.0, "")}
    for c in token:
        nxt: dict[tuple[str, str, str], tuple[float, str]] = {}
        for d in ALIKE.get(c, (c,)):
            sd = script(d)
            for (a, b, s), (score, path) in states.items():
                v = score + model.score(a, b, d) - (model.switch if s and sd and s != sd else 0.0)
                if d != c:
                    v -= 0.01
                k = (b, d, sd or s)
                if k not in nxt or v > nxt[k][0]:
                    nxt[k] = (v, path + d)
        states = nxt
    return max((score + model.score(a, b, "\x03"), path) for (a, b, s), (score, path) in states.items())[1]


def consistent(text: str, model: NgramScores) -> str:
    """`text` in its consistent form; tokens without a confused letter keep their letters."""
    t = fold(text)
    if not any(c in LOOKS for c in t):
        return t
    return " ".join(best_path(w, model) if any(c in LOOKS for c in w) else w for w in t.split(" "))


#: Characters that are their own form; text of these only needs no search.
PLAIN = r"^[\x20-\x7E가-힣一-鿿]*$"
ENDS = " \t\r\n"


def reference_names(spark, sf_dir: str) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """(header names, item names) with ids; both tables are fixed in size."""
    heads = table(spark, sf_dir, "canonical_headers").select("header_id", F.explode(F.array("label", "label_en", "label_hanja")).alias("n")).filter("n is not null")
    items = table(spark, sf_dir, "item_names").select("item_id", "name").filter("name is not null")
    return [tuple(r) for r in heads.collect()], [tuple(r) for r in items.collect()]


class Matcher:
    """Finds the reference name that a text reads the same as."""

    def __init__(self, names: list[tuple[int, str]]) -> None:
        self.exact = {n for _, n in names}
        self.model = NgramScores(self.exact)
        self.forms: dict[str, int] = {}
        for i, n in sorted(names):
            self.forms.setdefault(consistent(n, self.model), i)
        self.known: dict[str, int | None] = {}

    def ref(self, value: str) -> int | None:
        """Id of the name that `value` reads the same as without being it, else None."""
        v = value.strip(ENDS)
        if v in self.known:
            return self.known[v]
        got = None if v in self.exact else self.forms.get(consistent(v, self.model))
        if len(self.known) < 1_000_000:
            self.known[v] = got
        return got


def same_reading(rows: DataFrame, keys: list[str], value: str, names: list[tuple[int, str]]) -> DataFrame:
    """`keys` + ref_id of the rows whose `value` reads as a name but is another string.

    Text of plain characters only cannot differ from a name unseen and is
    filtered before Python. Null and empty values give no row; of two names that
    read the same the smaller id stands. `names` is a fixed reference list.
    """
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", ref_id int"

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Matcher(names)
        for pdf in batches:
            ref = [m.ref(v) for v in pdf["_v"]]
            keep = [i for i, r in enumerate(ref) if r is not None]
            out = pdf.iloc[keep][keys].copy()
            out["ref_id"] = [ref[i] for i in keep]
            yield out

    picked = rows.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.col("_v").rlike(PLAIN))
    return picked.mapInPandas(match, schema)


def consistent_form(value: Column, names: list[tuple[int, str]]) -> Column:
    """`value` brought to its consistent form; null stays null."""

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        model = NgramScores([n for _, n in names])
        seen: dict[str, str] = {}
        return s.map(lambda x: None if x is None else seen.setdefault(x, consistent(x, model)) if x not in seen else seen[x])

    return F.when(value.rlike(r"^[\x00-\x7F]*$"), value).otherwise(form(value))


def unseen_differences(tables: DataFrame, cells: DataFrame, heads: list[tuple[int, str]], items: list[tuple[int, str]]) -> DataFrame:
    """(doc_id, section_ord, table_ord, row_ord, col_ord, ref_id) in estimate tables.

    Headers have row_ord -1. Cells are matched where they lie, without a
    shuffle; only the matches are joined with the tables' domain. Repeated rows
    count once.
    """
    key = ["doc_id", "section_ord", "table_ord"]
    est = tables.filter("domain = 'estimate'")
    at = est.select(*key, F.posexplode_outer("headers").alias("col_ord", "h")).withColumn("row_ord", F.lit(-1))
    h = same_reading(at, [*key, "row_ord", "col_ord"], "h", heads)
    c = same_reading(cells, [*key, "row_ord", "col_ord"], "value", items).distinct()
    c = c.join(est.select(*key).distinct(), key, "left_semi")
    return h.unionByName(c.select(h.columns)).distinct()


def p6_found(spark, sf_dir: str) -> DataFrame:
    heads, items = reference_names(spark, sf_dir)
    return unseen_differences(table(spark, sf_dir, "doc_tables"), table(spark, sf_dir, "doc_cells"), heads, items)


def p6_forms(spark, sf_dir: str) -> DataFrame:
    """(value, form, n): every distinct header and cell text that its consistent form changes."""
    heads, items = reference_names(spark, sf_dir)
    texts = table(spark, sf_dir, "doc_tables").select(F.explode("headers").alias("value")).unionAll(table(spark, sf_dir, "doc_cells").select("value"))
    n = texts.filter(F.col("value").isNotNull() & ~F.col("value").rlike(PLAIN)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    out = n.select("value", consistent_form(F.col("value"), heads + items).alias("form"), "n")
    return out.filter(~F.col("value").eqNullSafe(F.col("form")))
