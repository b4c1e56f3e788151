"""Helpers that shape physical plans: lineage cuts, size checks, two-level prefix sums."""
