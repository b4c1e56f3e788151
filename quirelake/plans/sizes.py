"""Size checks that stand before every broadcast."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024


def _bytes(c: Column, kind: DataType) -> Column:
    """About the bytes that a value of the type takes in a row."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return F.lit(8)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows of `max_bytes` in all, else unchanged.

    The check reads at most max_rows + 1 rows, so a table that has grown costs no
    full scan; beyond the bounds the join is left to a shuffle and AQE.
    """
    size = reduce(lambda a, f: a + _bytes(F.col(f"`{f.name}`"), f.dataType), df.schema.fields, F.lit(0))
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= max_bytes else df
