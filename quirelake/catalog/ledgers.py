"""Ledger, cache, reports and manifests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions.times import epoch_micros
from quirelake.operators import cache, ledger
from quirelake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_E = "(SELECT DISTINCT * FROM usage_events)"
_M = "count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, round(CAST(coalesce(sum(CAST(estimated_cost_usd AS DECIMAL(28,10))), 0) AS DOUBLE), 7) AS cost_usd, count_if(token_status = 'unknown') AS unknown_calls"
_TABLES = "(SELECT * FROM doc_tables QUALIFY row_number() OVER (PARTITION BY doc_id, section_ord, table_ord) = 1)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _events(s, d) -> DataFrame:
    return ledger.events_once(table(s, d, "usage_events"))


@query("usage_summary", f"""SELECT engine, provider, grouping(engine) = 1 AS "all", {_M} FROM {_E} GROUP BY GROUPING SETS ((engine, provider), ())""")
def usage_summary(s, d):
    return ledger.summary(_events(s, d))


@query("usage_month", f"SELECT engine, provider, {_M} FROM {_E} WHERE substr(trim(timestamp), 1, 7) = '2025-06' GROUP BY engine, provider")
def usage_month(s, d):
    e = _events(s, d).filter(ledger.in_range(F.col("timestamp"), "month", "2025-06-30"))
    return e.groupBy("engine", "provider").agg(*ledger.measures())


@query("usage_daily", f"SELECT substr(trim(timestamp), 1, 10) AS day, {_M} FROM {_E} WHERE timestamp IS NOT NULL GROUP BY 1")
def usage_daily(s, d):
    return ledger.daily(_events(s, d))


@query("usage_by_job", f"SELECT job_id, {_M} FROM {_E} WHERE job_id IS NOT NULL GROUP BY job_id")
def usage_by_job(s, d):
    return ledger.by_job(_events(s, d))


@query("job_events", f"SELECT id, timestamp, engine, total_tokens FROM {_E} WHERE job_id = 'job-nightly'")
def job_events(s, d):
    return ledger.job_events(_events(s, d), "job-nightly").select("id", "timestamp", "engine", "total_tokens")


@query("running_usage", f"SELECT id, job_id, coalesce(total_tokens, 0) AS total_tokens, CAST(sum(coalesce(total_tokens, 0)) OVER (PARTITION BY job_id ORDER BY id) AS BIGINT) AS tokens_so_far FROM {_E} WHERE job_id IS NOT NULL")
def running_usage(s, d):
    return ledger.running_totals(table(s, d, "usage_events"))


@query("top_jobs", f"SELECT job_id, CAST(sum(coalesce(total_tokens, 0)) AS BIGINT) AS tokens FROM {_E} WHERE job_id IS NOT NULL GROUP BY job_id ORDER BY tokens DESC, job_id LIMIT 50")
def top_jobs(s, d):
    """The 50 jobs with the most tokens: a top-k report."""
    t = _events(s, d).filter("job_id is not null").groupBy("job_id").agg(F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"))
    return t.orderBy(F.desc("tokens"), "job_id").limit(50)


@query("log_tail", f"SELECT id, job_id, status FROM {_E} ORDER BY id DESC LIMIT 100")
def log_tail(s, d):
    """The last 100 ledger rows: a top-k report."""
    return _events(s, d).select("id", "job_id", "status").orderBy(F.desc("id")).limit(100)


_LOG = "SELECT 'k' || (value_key) AS key, CAST(epoch_us(ts) / 1000000.0 AS DOUBLE) AS secs, event_id AS seq, CASE WHEN event_type = 'purchase' OR event_type = 'signup' THEN 'put' ELSE 'get' END AS op FROM (SELECT *, user_id % 1000 AS value_key FROM events)"


def _log(s, d) -> DataFrame:
    return table(s, d, "events").select(F.concat(F.lit("k"), F.pmod("user_id", F.lit(1000)).cast("string")).alias("key"), (epoch_micros(F.col("ts")) / 1e6).alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("purchase", "signup"), "put").otherwise("get").alias("op"))


@query("ttl_cache", f"""WITH l AS ({_LOG}), p AS (SELECT *, last_value(CASE WHEN op = 'put' THEN secs END IGNORE NULLS) OVER (PARTITION BY key ORDER BY secs, seq) AS put_at FROM l)
  SELECT seq, key, op, op = 'get' AND coalesce(secs - put_at <= 86400, false) AS hit FROM p""")
def ttl_cache(s, d):
    return cache.replay(_log(s, d), 86_400.0).select("seq", "key", "op", "hit")


@query("cache_stats", f"""WITH l AS ({_LOG}), p AS (SELECT *, last_value(CASE WHEN op = 'put' THEN secs END IGNORE NULLS) OVER (PARTITION BY key ORDER BY secs, seq) AS put_at FROM l), h AS (SELECT *, op = 'get' AND coalesce(secs - put_at <= 86400, false) AS hit FROM p)
  SELECT count_if(hit) AS hits, count_if(op = 'get') - count_if(hit) AS misses, round(count_if(hit) * 100.0 / count_if(op = 'get'), 1) AS hit_rate_pct, count(DISTINCT CASE WHEN op = 'put' THEN key END) AS size FROM h""")
def cache_stats(s, d):
    return cache.stats(cache.replay(_log(s, d), 86_400.0))


@query("cache_latest", f"WITH l AS ({_LOG}) SELECT key, max(secs) AS created, arg_max(CAST(seq AS VARCHAR), (secs, CAST(seq AS VARCHAR))) AS value FROM l WHERE op = 'put' GROUP BY key")
def cache_latest(s, d):
    puts = _log(s, d).filter("op = 'put'").select("key", F.col("seq").cast("string").alias("value"), F.col("at").alias("created"))
    return cache.latest(puts)


@query("key_rotation", "SELECT event_id, CAST(((event_id) // 20) % 3 AS INTEGER) AS slot, CAST((event_id // 20) // 3 AS INTEGER) AS cycle FROM events")
def key_rotation(s, d):
    e = table(s, d, "events").select("event_id", (F.col("event_id") + 1).alias("n"))
    return cache.rotate(e, "n", 3, 20).select("event_id", "slot", "cycle")


@query("manifest_counts", f"""SELECT coalesce(domain, 'none') AS domain, count(DISTINCT doc_id) AS inputs, count_if(role LIKE 'primary%' OR role LIKE 'estimate%' OR role LIKE 'summary%') AS representative, count_if(NOT (role LIKE 'primary%' OR role LIKE 'estimate%' OR role LIKE 'summary%')) AS diagnostic FROM {_TABLES} GROUP BY 1""")
def manifest_counts(s, d):
    t = table(s, d, "doc_tables").dropDuplicates(["doc_id", "section_ord", "table_ord"])
    main = F.col("role").like("primary%") | F.col("role").like("estimate%") | F.col("role").like("summary%")
    return t.groupBy(F.coalesce("domain", F.lit("none")).alias("domain")).agg(F.count_distinct("doc_id").alias("inputs"), F.count_if(main).alias("representative"), F.count_if(~main).alias("diagnostic"))


@query("representative_boms", f"SELECT doc_id, section_ord, table_ord FROM {_TABLES} WHERE domain = 'bom' AND role = 'primary_material_table' AND quality.status IN ('ok', 'warning')")
def representative_boms(s, d):
    t = table(s, d, "doc_tables").dropDuplicates(["doc_id", "section_ord", "table_ord"])
    return t.filter("domain = 'bom' and role = 'primary_material_table' and quality.status in ('ok', 'warning')").select("doc_id", "section_ord", "table_ord")


@query("value_loss", """WITH c AS (SELECT doc_id, count(DISTINCT (section_ord, table_ord, row_ord, col_ord)) FILTER (WHERE trim(value) <> '') AS cells FROM doc_cells GROUP BY doc_id), t AS (SELECT doc_id, sum(parsed_row_count) AS rows, sum(raw_row_count - parsed_row_count) AS lost FROM (SELECT DISTINCT doc_id, section_ord, table_ord, parsed_row_count, raw_row_count FROM doc_tables) GROUP BY doc_id)
  SELECT t.doc_id, coalesce(cells, 0) AS cells, CAST(rows AS BIGINT) AS "rows", CAST(lost AS BIGINT) AS lost, coalesce(cells, 0) >= 10 AND rows < greatest(3, coalesce(cells, 0) // 10) AS suspicious FROM t LEFT JOIN c ON c.doc_id = t.doc_id""")
def value_loss(s, d):
    """Filled cells against parsed rows of each document; suspicious where rows are few for the cells."""
    c = table(s, d, "doc_cells").filter(F.trim("value") != "").select("doc_id", "section_ord", "table_ord", "row_ord", "col_ord").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("cells"))
    t = table(s, d, "doc_tables").select("doc_id", "section_ord", "table_ord", "parsed_row_count", "raw_row_count").distinct().groupBy("doc_id").agg(F.sum("parsed_row_count").alias("rows"), F.sum(F.col("raw_row_count") - F.col("parsed_row_count")).alias("lost"))
    n = F.coalesce("cells", F.lit(0))
    return t.join(c, "doc_id", "left").select("doc_id", n.alias("cells"), "rows", "lost", ((n >= 10) & (F.col("rows") < F.greatest(F.lit(3), F.floor(n / 10)))).alias("suspicious"))


@query("meta_sections", "SELECT DISTINCT doc_id, section_ord, revision_year, unit_basis FROM doc_sections WHERE revision_year <> '' OR unit_basis <> ''")
def meta_sections(s, d):
    return table(s, d, "doc_sections").filter("revision_year <> '' or unit_basis <> ''").select("doc_id", "section_ord", "revision_year", "unit_basis").distinct()


@query("unpivot_meta", """SELECT DISTINCT doc_id, section_ord, label, value FROM (UNPIVOT (SELECT doc_id, section_ord, title, department, chapter, source_file, revision_year, unit_basis FROM doc_sections) ON title, department, chapter, source_file, revision_year, unit_basis INTO NAME label VALUE value) WHERE value <> ''""")
def unpivot_meta(s, d):
    cols = ["title", "department", "chapter", "source_file", "revision_year", "unit_basis"]
    t = table(s, d, "doc_sections").select("doc_id", "section_ord", *cols).unpivot(["doc_id", "section_ord"], cols, "label", "value")
    return t.filter("value <> ''").distinct()


@query("benchmark_stats", "SELECT o_orderpriority AS run, round(min(o_totalprice), 2) AS low, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice), 2) AS high, count(*) AS n FROM orders GROUP BY 1")
def benchmark_stats(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.max("o_totalprice"), 2).alias("high"), F.count(F.lit(1)).alias("n"))


@query("unique_names", """SELECT doc_id, section_ord, CASE WHEN n > 1 THEN b || '_' || n ELSE b END AS sheet FROM (SELECT doc_id, section_ord, b, row_number() OVER (PARTITION BY doc_id, b ORDER BY section_ord) AS n FROM (SELECT DISTINCT doc_id, section_ord, regexp_replace(coalesce(title, 'sheet'), '[\\[\\]:*?/\\\\]', '_', 'g') AS b FROM doc_sections))""")
def unique_names(s, d):
    t = table(s, d, "doc_sections").select("doc_id", "section_ord", F.regexp_replace(F.coalesce("title", F.lit("sheet")), r"[\[\]:*?/\\]", "_").alias("b")).distinct()
    n = F.row_number().over(Window.partitionBy("doc_id", "b").orderBy("section_ord"))
    return t.withColumn("n", n).select("doc_id", "section_ord", F.when(F.col("n") > 1, F.concat("b", F.lit("_"), F.col("n").cast("string"))).otherwise(F.col("b")).alias("sheet"))
