"""Streaming forms of the ledger and of the result cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirelake.operators.ledger import MONEY

EVENT = "id bigint, timestamp string, job_id string, engine string, provider string, model string, input_tokens bigint, output_tokens bigint, total_tokens bigint, estimated_cost_usd double, status string, token_status string"


def read_events(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """Ledger files as they arrive."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_usage(events: DataFrame, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(engine, window, calls, tokens, cost) over event time; an id counts once within `late`.

    State is dropped when the watermark passes, so it is bounded by the time that
    events may be late and not by the length of the stream.
    """
    e = events.withColumn("ts", F.try_to_timestamp(F.trim("timestamp"))).filter("ts is not null").withWatermark("ts", late)
    e = e.withColumn("engine", F.lower(F.trim("engine"))).dropDuplicatesWithinWatermark(["id"])
    cost = F.sum(F.coalesce("estimated_cost_usd", F.lit(0.0)).cast(MONEY)).alias("cost")
    return e.groupBy(F.window("ts", window).alias("window"), "engine").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"), cost)


def ttl_cache(log: DataFrame, ttl_ms: int) -> DataFrame:
    """(key, at_ms, op, hit) of put and get operations (key, at_ms, op), state per key with expiry.

    Operations of one key are taken in time order within a batch. A get is a hit
    if the last put is at most `ttl_ms` old; a key's state goes when it expires.
    """

    def step(key: tuple[str], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        put = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["at_ms", "op"], ascending=[True, False])
        hits = []
        for at, op in zip(rows["at_ms"], rows["op"]):
            hits.append(op == "get" and put is not None and at - put <= ttl_ms)
            put = at if op == "put" else put
        if put is not None:
            state.update((int(put),))
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"key": key[0], "at_ms": rows["at_ms"], "op": rows["op"], "hit": hits})

    return log.groupBy("key").applyInPandasWithState(step, "key string, at_ms bigint, op string, hit boolean", "put_ms bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
