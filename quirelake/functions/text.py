"""String functions as Column expressions; all stay in whole-stage codegen."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quirelake.functions import keywords as K

WS = r"(?U)\s+"


def strip(c: Column) -> Column:
    """Unicode white space off both ends; `trim` knows only the space character."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space, no-break spaces included, as one space; ends stripped."""
    return F.trim(F.regexp_replace(c, WS, " "))


clean_cell = collapse


def cell_text(html: Column) -> Column:
    """Visible text of one table cell: ^ and _ for raised and lowered text, entities read."""
    t = F.regexp_replace(html, r"(?i)<sup>(.*?)</sup>", "^$1")
    t = F.regexp_replace(t, r"(?i)<sub>(.*?)</sub>", "_$1")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return collapse(unescape(t))


def unescape(c: Column) -> Column:
    """The entities that table renderers write; & comes last so nothing is read twice."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def merge_spaced_hangul(text: Column, share: float = 0.7) -> Column:
    """Lines of letter-spaced Hangul ("공 사 명") joined.

    A line of at least two tokens is joined if `share` of them are single syllables.
    """

    def line(x: Column) -> Column:
        toks = F.filter(F.split(F.trim(x), r"\s+"), lambda t: t != "")
        single = F.size(F.filter(toks, lambda t: t.rlike("^[가-힣]$")))
        return F.when((F.size(toks) >= 2) & (single >= F.size(toks) * share), F.array_join(toks, "")).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def strip_markers(text: Column) -> Column:
    """Text without PAGE, SECTION and CONTEXT comments."""
    return F.regexp_replace(text, r"(?is)<!--\s*(?:PAGE|SECTION|CONTEXT).*?-->", "")


def clean_text(text: Column, drop_chapters: bool = False) -> Column:
    """Comments out, spaced Hangul joined, at most one blank line, ends stripped."""
    t = merge_spaced_hangul(F.regexp_replace(text, r"(?s)<!--.*?-->", ""))
    if drop_chapters:
        t = F.regexp_replace(t, r"(?m)^(제\d+장\s+.+)$", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def header_compare_key(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"(?U)[\s._|/\-]+", "")


def semantic_header_key(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"_\d+$", ""), r"(?U)[\s._|/\-']+", "")


def compact_header(c: Column) -> Column:
    """Header without suffix, case and separators, as contract rules compare it."""
    return F.regexp_replace(F.upper(F.regexp_replace(collapse(c), r"_\d+$", "")), r"(?U)[\s._|/\-'()\[\]]+", "")


def sanitize_html(c: Column) -> Column:
    """Rows as lines, cells parted by ' | ', tags and other entities gone."""
    t = F.regexp_replace(c, r"(?i)</tr\s*>", "\n")
    t = F.regexp_replace(t, r"(?i)</t[dh]>\s*<t[dh][^>]*>", " | ")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(F.replace(F.replace(t, F.lit("&amp;"), F.lit("&")), F.lit("&#x27;"), F.lit("'")), r"&[A-Za-z#0-9]+;", "")
    return F.regexp_replace(t, r"[ \t]+", " ")


def plain_text(md: Column) -> Column:
    """Visible text of Markdown: markers, images, tags and pipes out, blanks collapsed."""
    t = F.regexp_replace(strip_markers(md), r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"\|", " ")
    return collapse(t)


#: A mark that closes a sentence, or a word that does so without one.
ENDING = r"(?:[.:)\]]|다\"|것)$"


def ends_sentence(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)\s+$", "").rlike(ENDING)


def mask_secrets(text: Column, patterns: tuple[tuple[str, str], ...] = K.SECRETS) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p[0], p[1]), patterns, text)


def display_width(c: Column) -> Column:
    """Columns a text takes: two for each character beyond ASCII."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))


def correct_ocr(text: Column, pairs: tuple[tuple[str, str], ...] = K.OCR_CORRECTIONS) -> Column:
    """The replacements one after another; the order matters."""
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def chapter_number(c: Column) -> Column:
    """N of 제N장, 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"제\s*(\d+)\s*장", 1).try_cast("int"), F.lit(0))


def section_name(c: Column) -> Column:
    """A chapter's name one space behind `제N장`; spaced-out syllables (공 통) are joined, all else is trimmed."""
    name = strip(F.regexp_extract(c, r"^제\d+장(.*)$", 1))
    lone = ~F.exists(F.split(name, r"\s+"), lambda w: ~w.rlike("^[가-힣]$"))
    joined = F.when(lone, F.regexp_replace(name, r"\s+", "")).otherwise(name)
    return F.when(c.rlike(r"^제\d+장"), F.concat(F.regexp_extract(c, r"^제\d+장", 0), F.lit(" "), joined)).otherwise(strip(c))


def split_trailing_chapter(line: Column) -> Column:
    """[line, chapter] where a chapter title with its page follows a numbered sub-section on one line, else [line]."""
    at = F.regexp_instr(line, F.lit(r"\s제\d+장(?:\s+[가-힣]+)+\s+\d+\s*$"))
    parted = F.array(strip(F.substring(line, F.lit(1), at)), strip(F.substr(line, at)))
    return F.when(line.rlike(r"^\d+-") & (at > 0), F.filter(parted, lambda x: x != "")).otherwise(F.array(line))


def repair_section_id(section_id: Column, chapter: Column) -> Column:
    """The lost tens digit of an id put back in chapters from 10 on: 1-2 in chapter 11 is 11-2."""
    first = F.regexp_extract(section_id, r"^(\d+)", 1)
    lost = (chapter >= 10) & (F.length(first) == 1) & (first.try_cast("int") == F.pmod(chapter, F.lit(10)))
    return F.when(lost, F.concat(chapter.cast("string"), F.regexp_replace(section_id, r"^\d+", ""))).otherwise(section_id)


def file_name(c: Column, default: str = "input.pdf") -> Column:
    """The last part of a path with unsafe characters as `_`."""
    base = F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^0-9A-Za-z가-힣._ \-]", "_")
    return F.when(F.regexp_replace(base, r"^[ .]+|[ .]+$", "") == "", F.lit(default)).otherwise(F.regexp_replace(base, r"^[ .]+|[ .]+$", ""))


def sheet_token(c: Column) -> Column:
    t = F.regexp_replace(collapse(F.coalesce(c, F.lit(""))), r"[\[\]:*?/\\]", "_")
    return F.regexp_replace(t, r"^[ .']+|[ .']+$", "")


def strip_code_fence(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```$", ""))


def data_uri(content: Column, path: Column) -> Column:
    mime = F.when(F.lower(path).endswith(".pdf"), "application/pdf").when(F.lower(path).rlike(r"\.jpe?g$"), "image/jpeg").otherwise("image/png")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def encode_id(path: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.translate(F.regexp_replace(F.base64(F.encode(path, "UTF-8")), r"[=\r\n]", ""), "+/", "-_")


def decode_id(token: Column) -> Column:
    """Inverse of `encode_id`; null for what is none."""
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), "=")
    return F.decode(F.try_to_binary(padded, F.lit("base64")), "UTF-8")


def footer_metadata(text: Column) -> Column:
    """struct(chapter, section, page_num) read from a page's footer lines."""
    return F.struct(
        F.nullif(F.regexp_extract(text, r"(제\d+장\s*[^\n|]*)", 1), F.lit("")).alias("chapter"),
        F.nullif(F.regexp_extract(text, r"(?m)^(\d+-\d+(?:-\d+)?\s+\S.*)$", 1), F.lit("")).alias("section"),
        F.regexp_extract(text, r"(?m)^\s*-?\s*(\d{1,4})\s*-?\s*$", 1).try_cast("int").alias("page_num"),
    )


def canonical_detail_key(key: Column, columns: tuple[str, ...] = K.DETAIL_COLUMNS) -> Column:
    """The detail column that a header names: itself, or the longest one it begins with."""
    k = F.replace(F.regexp_replace(key, r"(?U)\s+", ""), F.lit("/"), F.lit("_"))
    out = F.when(k.isin(*columns), k)
    for c in sorted(columns, key=len, reverse=True):
        out = out.when(k.startswith(c + "_"), F.lit(c))
    return out.otherwise(k)


def wrapped_height(widths: Column) -> Column:
    """Row height from the lines that each cell wraps to: 15 a line, 18 to 84."""
    return F.least(F.greatest(widths * 15, F.lit(18)), F.lit(84))


def nfkc(c: Column) -> Column:
    """Compatibility normalisation; Arrow batches, as the engine has no built-in for it."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return run(c)


def normalize_header(c: Column) -> Column:
    """NFKC, line breaks and runs of blanks as one space, each `_` part by itself;
    a part of Han or Hangul without ASCII letters or digits loses its spaces."""

    def part(x: Column) -> Column:
        t = collapse(x)
        return F.when(t.rlike(r"[가-힣一-鿿]") & ~t.rlike(r"[A-Za-z0-9]"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)

    return F.array_join(F.filter(F.transform(F.split(nfkc(c), "_"), part), lambda x: x != ""), "_")


def page_spec(spec: str, total: int) -> list[int]:
    """0-based pages of `15`, `5-15`, `20-`, `-10` or a comma list; clamped to `total`.

    One number alone means the first n pages; in a list it means that page.
    """
    parts = [p.strip() for p in spec.split(",") if p.strip()]
    out: set[int] = set()
    for p in parts:
        a, dash, b = p.partition("-")
        if not dash:
            n = int(a)
            lo, hi = (1, n) if len(parts) == 1 else (n, n)
        else:
            lo, hi = int(a) if a.strip() else 1, int(b) if b.strip() else total
            if lo > hi:
                raise ValueError(f"reversed page range {p!r}")
        out |= set(range(max(1, lo), min(total, hi) + 1))
    return sorted(x - 1 for x in out)


def valid_page_spec(c: Column) -> Column:
    """Whether every token of a page spec is a page or a range that is not reversed."""
    toks = F.transform(F.split(c, ","), lambda t: F.trim(t))
    ok = lambda t: t.rlike(r"^\d+$|^\d+-$|^-\d+$") | (t.rlike(r"^\d+-\d+$") & (F.regexp_extract(t, r"^(\d+)", 1).try_cast("int") <= F.regexp_extract(t, r"(\d+)$", 1).try_cast("int")))
    return F.forall(toks, ok)
