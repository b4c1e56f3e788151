"""Registered queries of the operators for training text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelake.llm import canonical, leakage, lookalike, mixing, residue, scans

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "p2_found": canonical.p2_found,
    "p2_values": canonical.p2_values,
    "p4_found": scans.p4_found,
    "p4_paragraphs": scans.p4_paragraphs,
    "p6_found": lookalike.p6_found,
    "p6_forms": lookalike.p6_forms,
    "p7_found": leakage.p7_found,
    "p7_leaks": leakage.p7_leaks,
    "p7_items": leakage.p7_items,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": residue.p9_found,
    "p9_report": residue.p9_report,
    "p9_clean": residue.p9_clean,
}

ORACLE: dict[str, str] = {}
