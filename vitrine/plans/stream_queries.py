"""Streaming queries over the events table, run until all that is there is read; their SQL is that of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.plans.catalogue_queries import Query, table
from vitrine.streaming import live, rates, state

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = live.live_counters(live.stream_table(spark, sf_dir, "events"), "user_id", "event_type")
    return live.latest_rows(spark, live.drained(counts, "counters", "update"), ["user_id", "event_type"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = live.first_sightings(live.stream_table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id", "event_type"])
    return spark.read.parquet(live.drained(once, "sightings"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = live.windowed(live.stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", "1 hour", "event_type")
    rows = live.latest_rows(spark, live.drained(counts.select(F.col("window.start").alias("day"), "event_type", "n"), "windows", "update"), ["day", "event_type"])
    return rows.select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


def _outcomes(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("site"), (F.col("user_id") % 8).cast("string")).alias("site"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", rates.REFUSED).otherwise(200).alias("status"), F.when(F.col("event_id") % 3 == 0, 2.0).alias("retry_after"))


@query()
def stream_rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(live.drained(rates.limited(_outcomes(live.stream_table(spark, sf_dir, "events"))), "rates"))


@query()
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.limited(_outcomes(table(spark, sf_dir, "events")))


@query("""
WITH w AS (SELECT 'site' || (user_id % 8) AS site, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS refused FROM events GROUP BY 1, 2), r AS (SELECT *, (requests - refused) / 3600::DOUBLE AS rate FROM w)
SELECT *, rate - lag(rate) OVER (PARTITION BY site ORDER BY start) AS change FROM r
""")
def limiter_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rates.statistics(_outcomes(table(spark, sf_dir, "events")))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id AS url, n AS attempt, least(5000, 1000 * (1 << (n - 1)))::INT AS wait_ms FROM (SELECT event_id, unnest(range(1, event_id % 5 + 1)) AS n FROM events) WHERE n <= 3")
def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tries = table(spark, sf_dir, "events").where("event_id % 5 > 0").select(F.col("event_id").alias("url"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("event_id") % 5)).alias("attempt"))
    return rates.retry_waits(tries)


@query("""
WITH d AS (SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'approved' ELSE 'rejected' END AS verdict FROM events WHERE event_type IN ('purchase', 'error') AND event_id % 11 = 0 GROUP BY user_id)
SELECT e.event_id, d.verdict FROM events e LEFT JOIN d USING (user_id)
""")
def learned_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    decisions = e.where("event_type IN ('purchase', 'error') AND event_id % 11 = 0").select("user_id", F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected").alias("verdict"))
    known, unknown = live.learned(decisions, e, "user_id")
    return known.select("event_id", "verdict").union(unknown.select("event_id", F.lit(None).cast("string")))


@query("""
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r <= 2 AND n >= 2
""")
def discovery_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.discovery_pages(table(spark, sf_dir, "events"), "user_id", "event_id").select("user_id", "event_id")


# What a stream learns


@query("""
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS slug, event_id AS attempt, event_id AS seq, event_type = 'purchase' AS ok FROM events),
b AS (SELECT *, coalesce(bool_or(ok) OVER (PARTITION BY slug ORDER BY seq, attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM a)
SELECT slug, attempt, CASE WHEN done THEN 'skipped' WHEN ok THEN 'extracted' ELSE 'failed' END AS outcome FROM b
""")
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product is done with its first success; the stream's state knows."""
    events = live.stream_table(spark, sf_dir, "events")
    attempts = events.select(F.col("user_id").alias("slug"), F.col("event_id").alias("attempt"), F.col("event_id").alias("at"), (F.col("event_type") == "purchase").alias("success"))
    return spark.read.parquet(live.drained(state.seen_once(attempts), "attempts")).drop("at")


@query("""
WITH e AS (SELECT 'l' || (user_id % 500) AS lineage, event_id AS item, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' END AS verdict FROM events),
w AS (SELECT *, coalesce(bool_or(verdict = 'approved') OVER b, false) AS yes, coalesce(bool_or(verdict = 'rejected') OVER b, false) AS no FROM e WINDOW b AS (PARTITION BY lineage ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT lineage, item, CASE WHEN yes THEN 'approved' WHEN no THEN 'rejected' END AS verdict FROM w WHERE verdict IS NULL
""")
def stream_lineages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items get the verdict that is known of their lineage when they come; decisions accumulate."""
    verdict = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected")
    rows = live.stream_table(spark, sf_dir, "events").select(F.concat(F.lit("l"), (F.col("user_id") % 500).cast("string")).alias("lineage"), F.col("event_id").alias("item"), F.col("event_id").alias("at"), verdict.alias("verdict"))
    return spark.read.parquet(live.drained(state.decided(rows), "lineages")).drop("at")


@query("""
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS item, event_type = 'purchase' AS discovery, value FROM events),
f AS (SELECT key, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS taught_by, sum(coalesce(value, 0)) AS config FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY item) AS r FROM e WHERE discovery) WHERE r <= 2 GROUP BY key HAVING count(*) = 2)
SELECT e.key, item, taught_by, config FROM e JOIN f USING (key)
""")
def stream_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows wait until two discovery rows of their key have come."""
    rows = live.stream_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("item"), (F.col("event_type") == "purchase").alias("discovery"), "value")
    return spark.read.parquet(live.drained(state.behind_barrier(rows), "discovery"))
