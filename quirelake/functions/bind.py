"""Evaluating an expression once where it is used many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, with `value` computed once a row.

    A Column used in several places, above all inside a higher-order function, is
    computed at each of them; as a lambda variable it is computed once.
    """
    return F.transform(F.array(value), body)[0]
