"""Time functions that do not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts).cast("timestamp"))
