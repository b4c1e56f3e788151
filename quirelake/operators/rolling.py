"""Trailing totals over calendar days, answered from a sharded segment tree.

Events are first reduced to one leaf an entity and day (partial aggregation on
the map side, so a hot entity costs no more than its days). Every leaf adds to
its ancestors: node (level, idx) covers the days idx * 2^level up to
(idx + 1) * 2^level - 1, and a time shard is one node of the top level. A
trailing range is the disjoint union of O(log n) nodes, found by arithmetic, so
a query is one equi-join of (entity, level, idx) instead of a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.plans.lineage import cut, scratch
from quirelake.plans.sizes import broadcast_if_small

#: A shard spans 2^TOP_LEVEL days; shards are the unit that a late correction rewrites.
TOP_LEVEL = 7
COST = "decimal(28,10)"


def written_day(ts: Column) -> Column:
    """The calendar date as written in an ISO text, offset ignored; null if there is none."""
    t = F.regexp_replace(ts, r"^\s+", "")
    iso = F.regexp_replace(t, r"^(\d{4})-?(\d{2})-?(\d{2})(?!\d).*$", "$1-$2-$3")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(?!\d)|^\d{8}(?!\d)"), F.try_to_date(iso, "yyyy-MM-dd"))


def daily_leaves(events: DataFrame) -> DataFrame:
    """(entity, day, calls, tokens, cost) from usage events.

    Rows of one id count once (the greatest row, if they differ); rows without
    an id count each. Rows without an engine or a readable date are left out.
    Null tokens and costs count 0.
    """
    key = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    row = F.struct(
        F.datediff(written_day(F.col("timestamp")), F.lit("1970-01-01")).alias("day"),
        F.lower(F.regexp_replace("engine", r"(?U)^\s+|\s+$", "")).alias("entity"),
        F.coalesce("total_tokens", F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.col("estimated_cost_usd"), F.lit(0.0)).cast(COST).alias("cost"),
    )
    once = events.select("id", key.alias("_k"), row.alias("r")).groupBy("id", "_k").agg(F.max("r").alias("r")).select("r.*")
    once = once.filter("day is not null and entity is not null and entity <> ''")
    return once.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").cast(COST).alias("cost"))


def _sum_nodes(df: DataFrame) -> DataFrame:
    return df.groupBy("entity", "shard", "level", "idx").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").cast(COST).alias("cost"))


def build_tree(leaves: DataFrame) -> DataFrame:
    """All nodes of the trees: (entity, shard, level, idx, calls, tokens, cost)."""
    path = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("day", k).alias("idx")) for k in range(TOP_LEVEL + 1)])).alias("n")
    at = leaves.select("entity", F.shiftright("day", TOP_LEVEL).alias("shard"), path, "calls", "tokens", "cost")
    return _sum_nodes(at.select("entity", "shard", "n.level", "n.idx", "calls", "tokens", "cost"))


def correct_tree(nodes: DataFrame, deltas: DataFrame) -> DataFrame:
    """`nodes` after late corrections, given as leaf rows that hold differences.

    Only the ancestors of a corrected day, one a level, get another value; all
    other nodes pass through without a shuffle of their own.
    """
    cols = ["entity", "shard", "level", "idx", "calls", "tokens", "cost"]
    late = build_tree(deltas)
    hit = late.select("entity", "level", "idx")
    touched = nodes.join(broadcast_if_small(hit), ["entity", "level", "idx"], "left_semi")
    rest = nodes.join(broadcast_if_small(hit), ["entity", "level", "idx"], "left_anti")
    return rest.select(cols).unionByName(_sum_nodes(touched.select(cols).unionByName(late)))


def store_tree(nodes: DataFrame, path: str) -> None:
    """The nodes as a table with a folder a time shard."""
    nodes.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def correct_stored(spark: SparkSession, path: str, deltas: DataFrame) -> None:
    """Apply late corrections to a stored tree: only the shards that `deltas` name are read and rewritten."""
    late = cut(deltas)
    shards = late.select(F.shiftright("day", TOP_LEVEL).alias("shard")).distinct()  # one a 128 days
    old = spark.read.parquet(path).join(F.broadcast(shards), "shard", "left_semi")
    new = cut(correct_tree(old, late))
    new.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def trailing_cover(day: Column, days: int) -> Column:
    """The nodes whose disjoint union is the `days` days that end with `day`."""
    a, b = day - F.lit(days - 1), day
    parts = []
    for k in range(TOP_LEVEL + 1):
        lo = F.shiftright(a + F.lit((1 << k) - 1), k)
        hi = F.shiftright(b + F.lit(1), k) - 1
        inside = lo <= hi
        if k == TOP_LEVEL:
            idx = F.when(inside, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        else:
            pick = F.array(F.when(inside & (F.pmod(lo, F.lit(2)) == 1), lo), F.when(inside & (F.pmod(hi, F.lit(2)) == 0), hi))
            idx = F.filter(pick, lambda x: x.isNotNull())
        parts.append(_at_level(idx, k))
    return F.flatten(F.array(*parts))


def _at_level(idx: Column, level: int) -> Column:
    return F.transform(idx, lambda x: F.struct(F.lit(level).alias("level"), x.cast("int").alias("idx")))


def rolling_totals(nodes: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row an entity and calendar day from its first to its last day, active or not.

    Columns: entity, day (days since 1970-01-01), first_day, and for each window n
    calls_n, tokens_n, cost_n. A window that reaches before the first day sums
    the days there are. An empty tree gives no row.
    """
    span = nodes.filter("level = 0").groupBy("entity").agg(F.min("idx").alias("first_day"), F.max("idx").alias("last_day"))
    days = span.select("entity", "first_day", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    asked = days.select("entity", "first_day", "day", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), trailing_cover(F.col("day"), n).alias("cover")) for n in windows])).alias("w"))
    asked = asked.select("entity", "first_day", "day", "w.n", F.explode("w.cover").alias("c")).select("entity", "first_day", "day", "n", "c.level", "c.idx")
    got = asked.join(nodes.drop("shard"), ["entity", "level", "idx"], "left")
    sums = []
    for n in windows:
        for c, zero in (("calls", F.lit(0).cast("long")), ("tokens", F.lit(0).cast("long")), ("cost", F.lit(0).cast(COST))):
            sums.append(F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), zero).alias(f"{c}_{n}"))
    return got.groupBy("entity", "first_day", "day").agg(*sums)


def usage_rolling(events: DataFrame) -> DataFrame:
    """Trailing 7 and 30 day totals and averages per engine and day, as a report.

    avg_*_n is the average a calendar day (total / n); per_call_tokens_n the
    average a call, null without calls.
    """
    return usage_report(rolling_totals(build_tree(daily_leaves(events))))


def usage_report(r: DataFrame) -> DataFrame:
    cols = [F.col("entity").alias("engine"), F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd").alias("usage_day")]
    for n in (7, 30):
        cols += [
            F.col(f"calls_{n}"),
            F.col(f"tokens_{n}"),
            F.col(f"cost_{n}").cast("double").alias(f"cost_usd_{n}"),
            F.round(F.col(f"tokens_{n}") / F.lit(float(n)), 4).alias(f"avg_tokens_{n}"),
            F.round(F.col(f"cost_{n}").cast("double") / F.lit(float(n)), 9).alias(f"avg_cost_usd_{n}"),
            F.round(F.when(F.col(f"calls_{n}") > 0, F.col(f"tokens_{n}") / F.col(f"calls_{n}").cast("double")), 4).alias(f"per_call_tokens_{n}"),
        ]
    return r.select(*cols)


def usage_corrected(events: DataFrame, void: Column) -> DataFrame:
    """The report of usage_rolling after the calls that `void` names were withdrawn.

    The tree of all events is stored, and the withdrawals come late, as negative
    leaves that rewrite their shards only. A day all of whose calls are withdrawn
    stays in the calendar.
    """
    spark = events.sparkSession
    path = scratch(spark, "tree")
    store_tree(build_tree(daily_leaves(events)), path)
    withdrawn = daily_leaves(events.filter(void)).select("entity", "day", *[(-F.col(c)).cast(k).alias(c) for c, k in (("calls", "long"), ("tokens", "long"), ("cost", COST))])
    correct_stored(spark, path, withdrawn)
    return usage_report(rolling_totals(spark.read.parquet(path)))


def usage_bursts(events: DataFrame) -> DataFrame:
    """(engine, usage_day) whose 7 day tokens exceed half of the 30 day tokens.

    Days from the 29th after the engine's first day up to its last day, the
    30 day total above 0.
    """
    r = rolling_totals(build_tree(daily_leaves(events)))
    hit = r.filter((F.col("day") >= F.col("first_day") + 29) & (F.col("tokens_30") > 0) & (F.col("tokens_7") * 2 > F.col("tokens_30")))
    return hit.select(F.col("entity").alias("engine"), F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "yyyy-MM-dd").alias("usage_day"))
