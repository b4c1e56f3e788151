"""What kind of document a text is, and whether its extraction is good enough."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions import keywords as K
from quirelake.functions.bind import let
from quirelake.functions.tables import count_hits, hits
from quirelake.functions.text import plain_text


def material_quote(text: Column) -> Column:
    """At least five words of a quotation for material, or the columns of one."""
    return let(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \n]", ""), _material_quote)


def _material_quote(t: Column) -> Column:
    header = [F.forall(F.array(*[F.lit(w) for w in ws]), lambda w: t.contains(w)) for ws in K.MATERIAL_QUOTE_HEADER]
    return (count_hits(t, K.MATERIAL_QUOTE) >= K.MATERIAL_QUOTE_HITS) | header[0] | header[1]


def detection(text: Column, words: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct(label, confidence, estimate, pumsem, bom, material_quote).

    The best score wins, ties in the order estimate, pumsem, bom. A low confidence
    gives neither label nor material_quote. A quotation for material counts as
    six estimate words.
    """
    w = words or {"estimate": K.ESTIMATE, "pumsem": K.PUMSEM, "bom": K.BOM}

    def counts(v: Column) -> Column:
        t, up = v["t"], v["u"]
        return F.struct(count_hits(t, w["estimate"]).alias("e"), count_hits(t, w["pumsem"]).alias("p"), count_hits(up, w["bom"]).alias("b"), count_hits(up, K.BOM_STRUCTURE).alias("st"), material_quote(t).alias("q"))

    t = let(F.coalesce(text, F.lit("")), lambda x: F.struct(x.alias("t"), F.upper(x).alias("u")))
    return let(let(t, counts), _decide)


def _decide(s: Column) -> Column:
    e, p, b = F.when(s["q"], F.greatest(s["e"], F.lit(6))).otherwise(s["e"]), s["p"], s["b"]
    best = F.when((e >= p) & (e >= b), "estimate").when(p >= b, "pumsem").otherwise("bom")
    top = F.greatest(e, p, b)
    second = F.when(best == "estimate", F.greatest(p, b)).when(best == "pumsem", F.greatest(e, b)).otherwise(F.greatest(e, p))
    lead = top - second
    text_kind = F.when((top >= 6) & (lead >= 2), "high").when((top >= 4) & (lead >= 2), "medium").otherwise("low")
    bom_kind = F.when((top >= 5) & (s["st"] >= 2) & (lead >= 2), "high").when((top >= 3) & (lead >= 0), "medium").otherwise("low")
    conf = F.when(top <= 0, "low").when(best == "bom", bom_kind).otherwise(text_kind)
    sure = conf != "low"
    return F.struct(F.when(sure, best).alias("label"), conf.alias("confidence"), e.alias("estimate"), p.alias("pumsem"), b.alias("bom"), (sure & s["q"]).alias("material_quote"))


def reasons(text: Column) -> Column:
    """The words found, as kind:word."""
    up = F.upper(text)
    parts = [_named(hits(t, w), k) for k, t, w in (("estimate", text, K.ESTIMATE), ("pumsem", text, K.PUMSEM), ("bom", up, K.BOM))]
    return F.concat(*parts)


def _named(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.concat(F.lit(kind + ":"), x))


def route(d: Column, markdown: Column, interactive: bool = False) -> Column:
    """The preset a document goes to: sure kinds to their own, all else to generic."""
    sure = (d["confidence"] == "high") | (F.lit(interactive) & (d["confidence"] == "medium"))
    return F.when(d["label"].isNull() | ~sure | ((d["label"] == "bom") & markdown), "generic").otherwise(d["label"])


def suggestion(d: Column) -> Column:
    named = F.concat(F.lit("--preset "), d["label"])
    return F.when(d["label"].isNull(), "").when(d["material_quote"], "--preset estimate").when(d["confidence"] == "high", named).otherwise(F.concat(named, F.lit("?")))


def pipe_blocks(text: Column) -> Column:
    """How many pipe tables begin: a separator row under a row with pipes."""
    lines = F.split(text, "\n")
    sep = lambda x: x.rlike(r"^\s*\|?[\s:|-]*-[\s:|-]*\|[\s:|-]*$")
    return F.size(F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i > 1) & sep(F.element_at(lines, i)) & F.coalesce(F.try_element_at(lines, i - 1), F.lit("")).rlike(r"\|.*\|")))


def extraction_metrics(text: Column, expected_pages: Column | None = None) -> Column:
    """struct(visible_chars, pages, html_tables, pipe_tables, score, weak_reason)."""
    pages = expected_pages if expected_pages is not None else F.lit(None).cast("int")

    def read(t: Column) -> Column:
        n = F.greatest(F.coalesce(pages, F.nullif(F.regexp_count(t, F.lit(r"(?i)<!--\s*PAGE\b")), F.lit(0)), F.lit(1)), F.lit(1))
        return F.struct(plain_text(t).alias("plain"), n.alias("pages"), F.regexp_count(F.lower(t), F.lit("<table")).alias("html"), pipe_blocks(t).alias("pipes"))

    def judge(p: Column) -> Column:
        return F.struct(F.length(F.regexp_replace(p["plain"], r"(?U)\s+", "")).alias("visible"), detection(p["plain"])["label"].alias("label"), material_quote(p["plain"]).alias("quote"), p["pages"].alias("pages"), p["html"].alias("html"), p["pipes"].alias("pipes"))

    return let(let(let(F.coalesce(text, F.lit("")), read), judge), _metrics)


def _metrics(m: Column) -> Column:
    visible, bare = m["visible"], (m["html"] == 0) & (m["pipes"] == 0)
    weak = F.concat_ws(
        ", ",
        F.when(visible < K.MIN_VISIBLE_CHARS, F.lit(f"visible_chars<{K.MIN_VISIBLE_CHARS}")),
        F.when(visible / m["pages"] < K.MIN_VISIBLE_PER_PAGE, F.lit(f"visible_chars_per_page<{K.MIN_VISIBLE_PER_PAGE}")),
        F.when(m["quote"] & bare, F.lit("material_quote_without_table_signal")),
        F.when(m["label"].isin("estimate", "pumsem") & (visible < K.MIN_STRUCTURED_CHARS) & bare, F.concat(m["label"], F.lit("_document_without_structure"))),
    )
    score = visible + K.TABLE_SCORE * m["html"] + K.BLOCK_SCORE * m["pipes"]
    return F.struct(visible.alias("visible_chars"), m["pages"].alias("pages"), m["html"].alias("html_tables"), m["pipes"].alias("pipe_tables"), score.alias("score"), weak.alias("weak_reason"))
