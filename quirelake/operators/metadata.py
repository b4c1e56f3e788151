"""Notes, conditions, references and title block fields read from text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions.numbers import amount
from quirelake.functions.text import clean_text, strip
from quirelake.operators.positions import matches_with_offset

# Words of the domain's notes, rates and references.
NOTE_MARK = "[주]"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮"
LESS, MORE = ("감산", "감"), ("가산", "증", "할증")
PLAIN_RATES = ("할증", "가산", "감산", "증감")
CITING = ("참조", "준용", "적용", "따른다")
_BREAK = "\u0001"
# The labels of a drawing's title block, first match first.
TITLE_FIELDS = (
    ("dwg_no", r"DWG\s*NO\.?|DRAWING\s*NO\.?"),
    ("rev", r"REV(?:ISION)?\.?"),
    ("title", r"TITLE\.?"),
    ("date", r"DATE|ISSUED"),
    ("project", r"PROJECT|JOB\s*NO\.?"),
    ("client", r"CLIENT|OWNER|CONTRACTOR"),
    ("drawn_by", r"DRAWN\s*BY|DRAWN|DRW'?D"),
    ("checked_by", r"CHECKED\s*BY|CHECKED|CHK'?D"),
    ("approved_by", r"APPROVED\s*BY|APPROVED|APP'?D"),
    ("scale", r"SCALE"),
    ("sheet", r"SHEET"),
)
# The labels of a quotation's cover.
COVER_FIELDS = (
    ("client", r"제\s*출\s*처\s*[:：]\s*(.+?)(?:\s*貴中|\s*$)"),
    ("amount_text", r"견적금액\s*[:：]\s*(.+?)(?:\s*원정|\s*$)"),
    ("project", r"현\s*장\s*명\s*[:：]\s*(.+?)$"),
    ("description", r"공\s*사\s*명\s*[:：]\s*(.+?)$"),
    ("item", r"물\s*품\s*명\s*[:：]\s*(.+?)$"),
    ("serial_no", r"견적일련번호\s*[:：]\s*(\S+)"),
)


def _note_lines(text: Column) -> Column:
    """struct(noted, rest): the lines of note blocks, each block behind a break, and all other lines.

    A block opens at a line that is the note mark. It closes at a line that begins
    with a section number, and at a blank line unless a circled number follows.
    """
    start = F.struct(F.lit(False).alias("open"), F.lit(False).alias("gap"), F.lit("").alias("noted"), F.lit("").alias("rest"))

    def step(s: Column, line: Column) -> Column:
        t = strip(line)
        mark, blank = t == NOTE_MARK, t == ""
        ends = t.rlike(r"^\d+-\d") | (s["gap"] & ~blank & ~F.substring(t, 1, 1).isin(*CIRCLED))
        is_open = mark | (s["open"] & ~ends)
        inside = is_open & ~mark
        noted = F.when(mark, F.lit(_BREAK)).when(inside, F.concat(line, F.lit("\n"))).otherwise("")
        rest = F.when(is_open, F.lit("")).otherwise(F.concat(line, F.lit("\n")))
        return F.struct(is_open.alias("open"), (inside & blank).alias("gap"), F.concat(s["noted"], noted).alias("noted"), F.concat(s["rest"], rest).alias("rest"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda s: F.struct(s["noted"], s["rest"]))


def notes(text: Column) -> Column:
    """The items of the note blocks of a text, circled numbers off."""
    pieces = F.split(_note_lines(text)["noted"], f"[{_BREAK}{CIRCLED}]")
    return F.filter(F.transform(pieces, strip), lambda i: i != "")


def without_notes(text: Column) -> Column:
    return strip(_note_lines(text)["rest"])


def _line_rates(line: Column) -> Column:
    """array<struct(type, condition, rate)> of one line's surcharges.

    The line is parted where a condition meets what it changes; each part's first
    percentage with a direction behind it belongs to the condition before.
    """
    parts = F.split(line, r"(?<=경우|때|시)\s*(?:본\s*)?(?=품|시공량)")
    rate = r"(\d+)%[^%]*?(" + "|".join((*MORE, *LESS)) + ")"

    def one(tail: Column, i: Column) -> Column:
        word = F.regexp_extract(tail, rate, 2)
        lead = F.element_at(parts, i + 1)
        own = F.element_at(F.split(lead, rate), -1)
        return F.struct(F.when(word.isin(*LESS), LESS[0]).otherwise(MORE[0]).alias("type"), strip(own).alias("condition"), F.concat(F.regexp_extract(tail, rate, 1), F.lit("%")).alias("rate"))

    tails = F.slice(parts, F.lit(2), F.size(parts))
    return F.filter(F.transform(tails, one), lambda c: (c["rate"] != "%") & (c["condition"] != ""))


def conditions(text: Column, before: int = 30) -> Column:
    """array<struct(type, condition, rate)> of surcharges; then plain rates not yet named.

    The condition of a plain rate is what stands before it, up to `before` characters.
    """
    full = F.flatten(F.transform(F.split(text, "\n"), _line_rates))

    def plain(m: Column) -> Column:
        lead = F.substring(text, F.greatest(m["pos"] + 1 - before, F.lit(1)), F.least(m["pos"], F.lit(before)))
        number = F.substring_index(m["match"], "%", 1)
        return F.struct(strip(F.substring_index(m["match"], "%", -1)).alias("type"), strip(lead).alias("condition"), F.concat(number, F.lit("%")).alias("rate"))

    def unless_named(named: Column, c: Column) -> Column:
        return F.when(F.exists(named, lambda x: x["rate"] == c["rate"]), named).otherwise(F.concat(named, F.array(c)))

    return F.aggregate(F.transform(matches_with_offset(text, rf"\d+%\s*(?:{'|'.join(PLAIN_RATES)})"), plain), full, unless_named)


def references(text: Column, around: int = 20) -> Column:
    """array<struct(target, chapter, context)> of references to other sections.

    Section numbers are found first; one is a reference if a citing word follows.
    A chapter named right before it belongs to it.
    """
    cites = rf"^\s*항?\s*(?:{'|'.join(CITING)})"

    def one(m: Column) -> Column:
        after = m["pos"] + F.length(m["match"])
        tail = F.regexp_extract(F.substring(text, after + 1, F.lit(16)), cites, 0)
        lead = F.regexp_extract(F.substring(text, F.greatest(m["pos"] - 11, F.lit(1)), F.least(m["pos"], F.lit(12))), r"제\d+장\s+$", 0)
        begin = m["pos"] - F.length(lead)
        context = F.substring(text, F.greatest(begin - around + 1, F.lit(1)), after + F.length(tail) - begin + around + F.least(begin, F.lit(around)))
        return F.struct(m["match"].alias("target"), F.regexp_extract(lead, r"\d+", 0).alias("chapter"), strip(context).alias("context"), (tail != "").alias("cited"))

    found = F.filter(F.transform(matches_with_offset(text, r"\d+(?:-\d+){1,2}"), one), lambda r: r["cited"])
    return F.transform(found, lambda r: F.struct(r["target"], r["chapter"], r["context"]))


def revision_year(text: Column) -> Column:
    """The last year of a revision mark; two digits from 50 on are of the last century."""
    mark = F.regexp_extract(text, r"\(([^()]*)년\s*보완\)", 1)
    year = F.regexp_extract(mark, r"\d+$", 0)
    n = year.try_cast("int")
    return F.when(F.length(year) == 4, n).when(F.length(year) == 2, n + F.when(n < 50, 2000).otherwise(1900))


def unit_basis(text: Column) -> Column:
    """The first text in parentheses that ends in "per"."""
    return F.try_element_at(F.filter(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), 1), lambda x: x.endswith("당")), F.lit(1))


def section_text(text: Column) -> Column:
    """struct of all that a section's text holds besides prose."""
    return F.struct(clean_text(without_notes(text), True).alias("clean_text"), notes(text).alias("notes"), conditions(text).alias("conditions"), references(text).alias("references"), revision_year(text).alias("revision_year"), unit_basis(text).alias("unit_basis"))


def title_block(text: Column) -> Column:
    """struct of the eleven title block fields; null where there is none.

    A line, or a part between pipes, gives its value to the first field whose
    label it begins with; of several the first in the text counts.
    """
    parts = F.transform(F.split(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", " "), r"[\n|]"), strip)
    parts = F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^[-|:]{3,}\s*$"))
    rule = lambda label: rf"(?i)^(?:{label})\s*(?:[:.]\s*|\s+)(\S.*?)\s*$"

    def claimed(p: Column, before: int) -> Column:
        return reduce(lambda a, f: a | p.rlike(rule(f[1])), TITLE_FIELDS[:before], F.lit(False))

    cols = []
    for i, (name, label) in enumerate(TITLE_FIELDS):
        mine = _own(parts, rule(label), claimed, i)
        cols.append(F.regexp_extract(F.try_element_at(mine, F.lit(1)), rule(label), 1).alias(name))
    return F.struct(*cols)


def _own(parts: Column, pattern: str, claimed, i: int) -> Column:
    return F.filter(parts, lambda p: p.rlike(pattern) & ~claimed(p, i))


def cover(text: Column) -> Column:
    """struct of a quotation cover's fields with the amount as a number."""
    cols = [F.nullif(F.trim(F.regexp_extract(text, "(?m)" + p, 1)), F.lit("")).alias(n) for n, p in COVER_FIELDS]
    return F.struct(*cols, amount(F.regexp_extract(text, "(?m)" + COVER_FIELDS[1][1], 1)).alias("amount"))


def unpivoted_title_block(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field, value) of the fields found."""
    names = [n for n, _ in TITLE_FIELDS]
    return docs.select(key, title_block(F.col(text)).alias("b")).select(key, "b.*").unpivot([key], names, "field", "value").filter("value is not null")


def unique_notes(notes: DataFrame, table_notes: DataFrame, by: list[str], note: str = "note") -> DataFrame:
    """`notes` without those that repeat a note set into a table of their section.

    One repeats the other if, blanks aside, the shorter of the two stands in the
    longer one. The table notes of one section travel as one array; a note that is
    blank repeats nothing.
    """
    squeeze = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    held = table_notes.select(*by, squeeze(note).alias("_t")).filter("_t <> ''").groupBy(*by).agg(F.collect_set("_t").alias("_held"))
    own = squeeze(note)
    repeats = F.exists("_held", lambda t: t.contains(own) | own.contains(t)) & (own != "")
    return notes.join(held, by, "left").filter(~F.coalesce(repeats, F.lit(False))).drop("_held")
