"""Ordered operations that never sort a hot key inside one task.

A window partitioned by a key that holds a third of all rows sorts a third of
the table in one task. Both helpers split the key into ordered buckets, work in
each bucket, and carry only one summary row a bucket across the bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_lag(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """`out` = `value` of the row before this one under `order` within `keys`.

    `bucket` must be monotone in `order`. Rows of one bucket are sorted together;
    over the buckets of a key only (key, bucket, last value) rows are sorted.
    The first row of a key gets null. `value` must not be null.
    """
    rows = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order)
    rows = rows.withColumn("_in", F.lag(value).over(inner))
    last = rows.groupBy(*keys, "_b").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_b")
    last = last.withColumn("_carry", F.lag("_last").over(across)).select(*keys, "_b", "_carry")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    joined = rows.alias("l").join(last.alias("r"), on, "left")
    return joined.select("l.*", "r._carry").withColumn(out, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_b")


def bucketed_prefix_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """`out` = sum of `value` over the rows strictly before this one within `keys`.

    Same two levels as `bucketed_lag`: a running sum inside each (key, bucket)
    and the running sum of bucket totals over one row a bucket.
    """
    rows = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    totals = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_t"))
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_t").over(across), F.lit(0))).select(*keys, "_b", "_base")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    joined = rows.alias("l").join(totals.alias("r"), on, "left")
    return joined.select("l.*", "r._base").withColumn(out, F.col("_in") + F.col("_base")).drop("_in", "_base", "_b")


def bucketed_last(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """`out` = the last non-null `value` up to and with this row under `order` within `keys`.

    The same two levels: rows are sorted inside a bucket, over the buckets only
    the last value of each is carried on.
    """
    rows = df.withColumn("_b", bucket)
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last(value, ignorenulls=True).over(inner))
    last = rows.groupBy(*keys, "_b").agg(F.max_by(F.struct(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_carry", F.last(f"_last.{value}", ignorenulls=True).over(across)).select(*keys, "_b", "_carry")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    joined = rows.alias("l").join(last.alias("r"), on, "left")
    return joined.select("l.*", "r._carry").withColumn(out, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_b")
