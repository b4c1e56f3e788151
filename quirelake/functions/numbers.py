"""Numeric, hash and date functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelake.functions.text import strip


def strict_number(c: Column) -> Column:
    """Sink cast: digits with commas, no leading zero but `0.`; else null. As double."""
    t = strip(c)
    plain = F.replace(t, F.lit(","), F.lit(""))
    lead = plain.rlike(r"^-?0\d")
    return F.when(t.rlike(r"^-?[\d,]+\.?\d*$") & ~lead & plain.rlike(r"\d"), plain.try_cast("double"))


def strict_is_integer(c: Column) -> Column:
    """Whether the strict cast gives an integer."""
    return strict_number(c).isNotNull() & ~c.contains(".")


def lenient_number(c: Column) -> Column:
    """Aggregation cast: commas out, the number or its leading run of [0-9.-], else 0."""
    t = F.replace(strip(F.coalesce(c, F.lit(""))), F.lit(","), F.lit(""))
    whole = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    run = F.regexp_extract(t, r"^([0-9.\-]+)", 1)
    lead = F.when(run.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), run.try_cast("double"))
    return F.coalesce(whole, lead, F.lit(0.0))


def is_number(c: Column) -> Column:
    return strip(c).rlike(r"^-?[\d,]+$")


def amount(c: Column) -> Column:
    """Digits of an amount text as a number, null without any."""
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).try_cast("long")


def token_cost(input_tokens: Column, output_tokens: Column, price_in: float = 0.10, price_out: float = 0.40) -> Column:
    return F.coalesce(input_tokens, F.lit(0)) / 1e6 * price_in + F.coalesce(output_tokens, F.lit(0)) / 1e6 * price_out


def content_key(content: Column, engine: Column, page: Column | None = None) -> Column:
    """SHA-256 of content, engine and page: the key of a cached result."""
    parts = [content, F.encode(engine, "UTF-8")]
    if page is not None:
        parts.append(F.encode(page.cast("string"), "UTF-8"))
    return F.sha2(F.concat(*parts), 256)


def iso_local(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def output_base_name(path: Column, day: Column, first: Column, last: Column) -> Column:
    """yyyymmdd_stem, with _pA-B for a part of the pages."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    return F.concat(F.date_format(day, "yyyyMMdd"), F.lit("_"), stem, F.when(first.isNotNull(), F.concat(F.lit("_p"), first, F.lit("-"), last)).otherwise(F.lit("")))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area of two boxes struct(x0, y0, x1, y1)."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    return w * h / F.least(area(a), area(b))


def area(b: Column) -> Column:
    return F.greatest((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]), F.lit(1.0))


def area_ratio(a: Column, b: Column) -> Column:
    return F.least(area(a), area(b)) / F.greatest(area(a), area(b))
