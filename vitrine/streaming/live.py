"""Live updates of a catalogue by Structured Streaming: sources, de-duplication, counters, fan-out and learned state.

Every stream is started with a checkpoint, so a stopped one goes on where it was, and its sinks are idempotent by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.shared import shared_path
from vitrine.sources.catalogue import table
from vitrine.streaming.state import STATE_STORE


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """A driver table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}*.parquet").parquet(sf_dir)


def drained(stream: DataFrame, name: str, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> str:
    """Runs a stream over all that is there now and returns the folder of its results. With the path of an earlier run, it goes on there.
    A stream with timers never has all there is, and must be started without an end."""
    spark = stream.sparkSession
    path = path or shared_path(spark, name)
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if batch is None and mode == "append":
        query = writer.format("parquet").option("path", f"{path}/data").start()
    else:
        query = writer.foreachBatch(batch or upsert_by_batch(f"{path}/data")).start()
    _finish(query)
    return f"{path}/data"


def _finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def upsert_by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of updated rows: each batch is a folder of its own that a retry overwrites; readers take the latest row of a key."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_rows(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The latest row of each key of an updated sink."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows.groupBy(*key).agg(*[F.max_by(c, "batch_id").alias(c) for c in rows.columns if c not in (*key, "batch_id")])


def first_sightings(stream: DataFrame, key: list[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """Each key once: for the whole run, with state that grows with the keys, or within a watermark, which bounds it."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def live_counters(stream: DataFrame, *keys: str) -> DataFrame:
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))


def windowed(stream: DataFrame, event_time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Counts by window of event time; late rows count until the watermark passes the window's end."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), *keys).agg(F.count("*").alias("n"))


def fan_out(*listeners: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A sink that gives each batch to every listener; one that comes late reads the table instead."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        try:
            for f in listeners:
                f(rows, batch_id)
        finally:
            rows.unpersist()

    return write


def event_frames(rows: DataFrame, event: str = "event_type") -> DataFrame:
    """Rows as frames of server-sent events: an event line where it has a name, and a data line of JSON."""
    data = F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n"))
    return rows.select(F.when(F.col(event).isNotNull(), F.concat(F.lit("event: "), F.col(event), F.lit("\n"), data)).otherwise(data).alias("frame"))


def learned(decisions: DataFrame, items: DataFrame, key: str, approved_first: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items with the verdict known for their key, items that still need one). A key both approved and rejected goes by the order given."""
    rank = F.when(F.col("verdict") == ("approved" if approved_first else "rejected"), 0).otherwise(1)
    known = decisions.groupBy(key).agg(F.min_by("verdict", rank).alias("verdict"))
    return items.join(known, key), items.join(known, key, "left_anti")


def discovery_pages(pages: DataFrame, key: str, pos: str, needed: int = 2) -> DataFrame:
    """The first `needed` pages of each key, which teach its configuration; keys with fewer have none."""
    from pyspark.sql import Window

    ranked = pages.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(pos))).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    return ranked.where((F.col("_rank") <= needed) & (F.col("_n") >= needed)).drop("_rank", "_n")
