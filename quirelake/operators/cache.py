"""The result cache as a keyed table with a time to live, and key rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.plans.order import bucketed_last

TTL_SECONDS = 30 * 24 * 3600


def latest(puts: DataFrame) -> DataFrame:
    """(key, value, created): the last write of each key; a write resets its hits.

    One aggregate with map-side combine, no sort. Equal times: the greater value.
    """
    return puts.groupBy("key").agg(F.max(F.struct("created", "value")).alias("p")).select("key", "p.value", "p.created")


def read(keys: DataFrame, cache: DataFrame, now: float, ttl: int = TTL_SECONDS) -> DataFrame:
    """`keys` with value, null for a miss or an entry older than `ttl`."""
    live = cache.filter(F.lit(now) - F.col("created") <= ttl).select("key", "value")
    return keys.join(live, "key", "left")


def expired(cache: DataFrame, now: float, ttl: int = TTL_SECONDS) -> DataFrame:
    return cache.filter(F.col("created") < now - ttl)


def replay(log: DataFrame, ttl: float) -> DataFrame:
    """(key, at, op, hit) of a log of put and get operations in time order per key.

    A get is a hit if the last put of its key before it is at most `ttl` old. A hot
    key is sorted a day at a time.
    """
    puts = log.withColumn("_put", F.when(F.col("op") == "put", F.col("at")))
    return bucketed_last(puts, ["key"], F.floor(F.col("at") / 86_400), ["at", "seq"], "_put", "put_at").drop("_put").withColumn("hit", (F.col("op") == "get") & F.coalesce(F.col("at") - F.col("put_at") <= ttl, F.lit(False)))


def stats(replayed: DataFrame) -> DataFrame:
    """(hits, misses, hit_rate_pct, size)."""
    gets = F.count_if(F.col("op") == "get")
    hits = F.count_if("hit")
    return replayed.agg(hits.alias("hits"), (gets - hits).alias("misses"), F.when(gets > 0, F.round(hits * 100.0 / gets, 1)).otherwise(0.0).alias("hit_rate_pct"), F.count_distinct(F.when(F.col("op") == "put", F.col("key"))).alias("size"))


def rotate(calls: DataFrame, n: str, keys: int, quota: int) -> DataFrame:
    """`slot` and `cycle` of the n-th call (from 1): each key serves `quota` calls in turn."""
    turn = F.floor((F.col(n) - 1) / F.lit(quota))
    return calls.withColumns({"slot": F.pmod(turn, F.lit(keys)).cast("int"), "cycle": F.floor(turn / F.lit(keys)).cast("int")})
