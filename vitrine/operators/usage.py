"""Usage, progress and rates: roll-ups of calls, costs, jobs, downloads and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import token_cost
from vitrine.operators.ranking import positioned


def usage_rollup(calls: DataFrame) -> DataFrame:
    """calls (stage, operation, tokens_in, tokens_out) at the grain of stage and operation, of stage, and in total: level 0, 1, 3."""
    by = calls.rollup("stage", "operation").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    return by.withColumn("cost", F.round(token_cost(F.col("tokens_in"), F.col("tokens_out")), 6))


def run_totals(stages: DataFrame, *keys: str) -> DataFrame:
    """Per run of stages (duration, cost, calls, products): sums, the products of its largest stage, and the cost of a product."""
    by = stages.groupBy(*keys).agg(F.round(F.sum("duration"), 6).alias("duration"), F.round(F.sum("cost"), 6).alias("cost"), F.sum("calls").alias("calls"), F.max("products").alias("products"))
    return by.withColumn("cost_per_product", F.round(F.try_divide("cost", "products"), 6))


def status_counts(jobs: DataFrame, statuses: list[str], by: list[str] | None = None) -> DataFrame:
    """A column of counts per status, and the total."""
    return jobs.groupBy(*(by or [])).agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses], F.count("*").alias("total"))


def favourite_stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("looks"), F.count_distinct("season").alias("seasons"), F.count_distinct("collection").alias("collections"), F.count_distinct("designer").alias("designers"))


def storage_stats(files: DataFrame, owner: str) -> DataFrame:
    return files.groupBy(owner).agg(F.count("*").alias("files"), F.round(F.sum("bytes") / 1048576, 2).alias("mb"))


def frequencies(rows: DataFrame, value: str, pos: str) -> DataFrame:
    """Counts by value, ranked by falling count, of equals by first appearance."""
    by = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return positioned(by, F.desc("n"), F.col("first"), name="rank").withColumn("rank", F.col("rank").cast("int")).drop("first")


def last_outcomes(events: DataFrame, key: str, order: list[str], size: int = 100) -> DataFrame:
    """For each event, how many of the last `size` of its key (itself included) there are and how many of these failed."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
    return events.withColumns({"seen": F.count("*").over(w), "failed": F.sum(F.col("failed_flag").cast("int")).over(w)})


def usage_deltas(snapshots: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """What a cumulative counter gained since the snapshot before; the first has all of it."""
    return snapshots.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(order)), F.lit(0)))


def progress(done: Column, total: Column, seconds: Column) -> dict[str, Column]:
    """percent, rate a second and seconds to go."""
    rate = F.try_divide(done, seconds)
    return {"percent": F.round(100 * F.try_divide(done, total), 2), "rate": F.round(rate, 6), "eta": F.round(F.try_divide(total - done, rate), 2)}


def direction(recent: Column, before: Column, band: float = 0.05) -> Column:
    """up, down or steady, within a band of 5 %."""
    return F.when(recent > before * (1 + band), "up").when(recent < before * (1 - band), "down").otherwise("steady")


def download_counters(attempts: DataFrame) -> DataFrame:
    """Per category and in all (a null category): queued, downloaded, failed, and the failed URLs in order."""
    last = attempts.groupBy("category", "url").agg(F.max("ok").alias("ok"))
    return last.rollup("category").agg(F.count("*").alias("queued"), F.count_if(F.col("ok")).alias("downloaded"), F.count_if(~F.col("ok")).alias("failed"), F.grouping("category").cast("int").alias("overall"))


def first_working_pattern(tries: DataFrame) -> DataFrame:
    """Per category, the first pattern that gave a row."""
    return tries.where("found > 0").groupBy("category").agg(F.min_by("pattern", "ord").alias("pattern"))


def least_wait(tries: DataFrame, fallback: int = 5000) -> DataFrame:
    """Per site, the least wait that gave a name and a price, else the longest."""
    return tries.groupBy("site").agg(F.coalesce(F.min(F.when(F.col("has_name") & F.col("has_price"), F.col("wait_ms"))), F.lit(fallback)).alias("wait_ms"))


def pages_until_empty(pages: DataFrame, streak: int = 3) -> DataFrame:
    """Pages (listing, page_no, found) up to the end of the first `streak` empty ones in a row."""
    w = Window.partitionBy("listing").orderBy("page_no")
    empties = F.sum((F.col("found") == 0).cast("int")).over(w.rowsBetween(1 - streak, 0))
    ended = pages.withColumn("ends", (empties == streak).cast("int"))
    return ended.withColumn("before", F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before = 0").drop("ends", "before")


def pool_statistics(uses: DataFrame, size: int, width_seconds: int = 3600) -> DataFrame:
    """Per pool of uses (pool, start, end; an end is no longer busy): served, peak (most at once), available_at_peak of `size`, and
    busy_seconds. A sweep line: starts and ends are +1 and -1 at their moments, moments are summed in buckets of time, and a bucket starts
    with the sum of those before, one row each; so no use meets another, and no pool is one task. Uses without a start or end, or that end
    before they start, don't count."""
    kept = uses.where("start IS NOT NULL AND end IS NOT NULL AND end >= start").select("pool", F.unix_micros("start").alias("s"), F.unix_micros("end").alias("e"))
    moments = kept.where("e > s").select("pool", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("m"))
    moments = moments.groupBy("pool", F.col("m.at").alias("at")).agg(F.sum("m.d").alias("d")).withColumn("bucket", F.expr(f"at DIV {width_seconds * 1_000_000}"))
    before = Window.partitionBy("pool").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = moments.groupBy("pool", "bucket").agg(F.sum("d").alias("d")).select("pool", "bucket", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("carried"))
    within = moments.withColumn("busy", F.sum("d").over(Window.partitionBy("pool", "bucket").orderBy("at")))
    peaks = within.join(carried, ["pool", "bucket"]).groupBy("pool").agg(F.max(F.col("carried") + F.col("busy")).alias("peak"))
    totals = kept.groupBy("pool").agg(F.count("*").alias("served"), (F.sum(F.col("e") - F.col("s")) / 1e6).alias("busy_seconds"))
    out = totals.join(peaks, "pool", "left").withColumn("peak", F.coalesce("peak", F.lit(0)))
    return out.select("pool", "served", "peak", (F.lit(size) - F.col("peak")).alias("available_at_peak"), "busy_seconds")
