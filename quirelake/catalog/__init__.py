"""Registered queries of the core and the SQL that checks them, module by module."""

from __future__ import annotations

from quirelake.catalog import blocks, documents, forms, layouts, ledgers, problems, tables, texts

MODULES = (problems, texts, tables, documents, ledgers, layouts, blocks, forms)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in MODULES for k, q in m.ORACLE.items()}
