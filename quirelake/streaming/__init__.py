"""Structured Streaming variants of the ledger and cache operators."""
