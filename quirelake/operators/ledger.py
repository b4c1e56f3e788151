"""The usage ledger: summaries, daily and job roll-ups, running totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.plans.order import bucketed_prefix_sum

MONEY = "decimal(28,10)"


def events_once(events: DataFrame) -> DataFrame:
    """Ledger rows with repeated rows once."""
    return events.distinct()


def in_range(ts: Column, range_name: str, today: str) -> Column:
    """Predicate for today, month or all, on the date as written."""
    if range_name == "today":
        return F.substring(F.trim(ts), 1, 10) == today
    if range_name == "month":
        return F.substring(F.trim(ts), 1, 7) == today[:7]
    return F.lit(True)


def measures() -> list[Column]:
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    cost = F.coalesce(F.sum(F.col("estimated_cost_usd").cast(MONEY)), F.lit(0)).cast("double")
    return [F.count(F.lit(1)).alias("calls"), z("input_tokens"), z("output_tokens"), z("total_tokens"), F.round(cost, 7).alias("cost_usd"), F.count_if(F.col("token_status") == "unknown").alias("unknown_calls")]


def summary(events: DataFrame) -> DataFrame:
    """(engine, provider, measures) with the grand total in one pass; all is true on it."""
    g = events.groupingSets([[F.col("engine"), F.col("provider")], []], F.col("engine"), F.col("provider"))
    return g.agg(F.grouping("engine").cast("boolean").alias("all"), *measures())


def daily(events: DataFrame, month: str | None = None) -> DataFrame:
    """(day, measures): days as written in the timestamp, null ones left out."""
    e = events.withColumn("day", F.substring(F.trim("timestamp"), 1, 10))
    e = e.filter(F.col("day").startswith(month)) if month else e.filter("day is not null")
    return e.groupBy("day").agg(*measures())


def by_job(events: DataFrame) -> DataFrame:
    return events.filter("job_id is not null").groupBy("job_id").agg(*measures())


def job_events(events: DataFrame, job_id: str) -> DataFrame:
    """The events of one job in time order; a filter, then a sort of what is left."""
    return events.filter(F.col("job_id") == job_id).orderBy("timestamp", "id")


def running_totals(events: DataFrame, buckets: int = 64) -> DataFrame:
    """(id, job_id, total_tokens, tokens_so_far) in id order within a job.

    Ids are cut into ranges so that one job with a large share of all events is
    summed in pieces.
    """
    e = events.filter("job_id is not null").select("id", "job_id", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens")).distinct()
    bucket = F.floor(F.col("id") / F.lit(10_000)).cast("long")
    out = bucketed_prefix_sum(e, ["job_id"], bucket, ["id"], "total_tokens", "before")
    return out.select("id", "job_id", "total_tokens", (F.col("before") + F.col("total_tokens")).alias("tokens_so_far"))


def token_status(input_tokens: Column, output_tokens: Column) -> Column:
    """unknown if both counts are 0 or missing, else known."""
    return F.when((F.coalesce(input_tokens, F.lit(0)) == 0) & (F.coalesce(output_tokens, F.lit(0)) == 0), "unknown").otherwise("known")
