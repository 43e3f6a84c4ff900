"""What a stream learns as it goes on: products seen, decisions on lineages, and configurations that hold back what waits for them.

State is kept for each product, lineage or site, never for a whole brand, in the store of the stream's checkpoint, so it survives a restart.
The rows of one key in one batch are put in order before they are taken; how much that can be is bounded by what a trigger reads.
What isn't touched for `keep_ms` is forgotten (None: never).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Where Spark keeps the state of such operators.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Seen(StatefulProcessor):
    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "at long", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        done = self.done.exists()
        before = done
        for r in sorted(rows, key=lambda r: (r["at"], r["attempt"])):
            if done:
                outcome = "skipped"
            else:
                outcome, done = ("extracted", True) if r["success"] else ("failed", False)
            yield Row(slug=key[0], attempt=r["attempt"], at=r["at"], outcome=outcome)
        if done and not before:
            self.done.update((0,))

    def close(self) -> None:
        pass


_OUTCOME = "slug string, attempt long, at long, outcome string"


def seen_once(attempts: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """attempts (slug, attempt, at, success) with outcome: a product is skipped once an attempt at it has succeeded, under whatever category;
    one that failed may be tried again. In order of (at, attempt); a table is taken as a stream that came in this order."""
    rows = attempts.select(F.col("slug").cast("string").alias("slug"), F.col("attempt").cast("long").alias("attempt"), F.col("at").cast("long").alias("at"), F.coalesce("success", F.lit(False)).alias("success"))
    if attempts.isStreaming:
        return rows.groupBy("slug").transformWithState(_Seen(keep_ms), _OUTCOME, "append", "processingTime" if keep_ms else "none")
    before = F.coalesce(F.max("success").over(Window.partitionBy("slug").orderBy("at", "attempt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.select("slug", "attempt", "at", F.when(before, "skipped").when(F.col("success"), "extracted").otherwise("failed").alias("outcome"))


class _Lineages(StatefulProcessor):
    def __init__(self, approved_first: bool, keep_ms: int | None) -> None:
        self.order = ("approved", "rejected") if approved_first else ("rejected", "approved")
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sets = handle.getMapState("sets", "verdict string", "at long", self.keep_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = {v for v in self.order if self.sets.containsKey((v,))}
        for r in sorted(rows, key=lambda r: (r["at"], r["verdict"] is not None, r["item"] or 0)):
            if r["verdict"] is not None:
                if r["verdict"] in self.order and r["verdict"] not in known:
                    known.add(r["verdict"])
                    self.sets.updateValue((r["verdict"],), (r["at"],))
            else:
                yield Row(lineage=key[0], item=r["item"], at=r["at"], verdict=next((v for v in self.order if v in known), None))

    def close(self) -> None:
        pass


def decided(rows: DataFrame, approved_first: bool = True, keep_ms: int | None = None) -> DataFrame:
    """The items of rows (lineage, item, at, verdict) with the verdict on their lineage by the decisions of earlier rows; null if there is
    none yet, so the item must be judged. Rows with a verdict ('approved' or 'rejected') are decisions; of one moment, items come first. A
    lineage may have been both approved and rejected: `approved_first` says which set is tried first. A table is taken in order of `at`."""
    rows = rows.select(F.col("lineage").cast("string").alias("lineage"), F.col("item").cast("long").alias("item"), F.col("at").cast("long").alias("at"), F.col("verdict").cast("string").alias("verdict"))
    if rows.isStreaming:
        return rows.groupBy("lineage").transformWithState(_Lineages(approved_first, keep_ms), "lineage string, item long, at long, verdict string", "append", "processingTime" if keep_ms else "none")
    before = Window.partitionBy("lineage").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    has = lambda v: F.coalesce(F.max(F.col("verdict") == v).over(before), F.lit(False))
    first, second = ("approved", "rejected") if approved_first else ("rejected", "approved")
    return rows.withColumn("known", F.when(has(first), first).when(has(second), second)).where("verdict IS NULL").select("lineage", "item", "at", F.col("known").alias("verdict"))


class _Barrier(StatefulProcessor):
    def __init__(self, needed: int, wait_ms: int | None) -> None:
        self.needed, self.wait_ms = needed, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.found = handle.getMapState("found", "item long", "value double")
        self.config = handle.getValueState("config", "items string, value double")
        self.waiting = handle.getListState("waiting", "item long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        config, held, released = self.config.get(), [], False
        for r in sorted(rows, key=lambda r: r["item"]):
            if config is None and r["discovery"]:
                self.found.updateValue((r["item"],), (r["value"],))
                taught = sorted((k[0], v[0]) for k, v in self.found.iterator())
                if len(taught) >= self.needed:
                    taught = taught[: self.needed]
                    config = (",".join(str(i) for i, _ in taught), float(sum(v or 0.0 for _, v in taught)))
                    self.config.update(config)
                    self.found.clear()
            if config is None:
                held.append((r["item"],))
                continue
            #: Once for all rows: each look at the state is a call to the store.
            if not released:
                yield from self._released(key, config)
                released = True
            yield Row(key=key[0], item=r["item"], taught_by=config[0], config=config[1])
        if held and config is None:
            self.waiting.appendList(held)
            if self.wait_ms and not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        elif held:
            for (item,) in held:
                yield Row(key=key[0], item=item, taught_by=config[0], config=config[1])

    def _released(self, key: Any, config: Any) -> Iterator[Row]:
        if self.waiting.exists():
            for (item,) in self.waiting.get():
                yield Row(key=key[0], item=item, taught_by=config[0], config=config[1])
            self.waiting.clear()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        """A key whose discovery never came is given up with what waits for it."""
        if not self.config.exists():
            self.waiting.clear()
            self.found.clear()
        return iter(())

    def close(self) -> None:
        pass


def behind_barrier(rows: DataFrame, needed: int = 2, wait_ms: int | None = None) -> DataFrame:
    """rows (key, item, discovery, value) of keys of which `needed` discovery rows have come, with taught_by (their items) and config, which
    they teach (the sum of their values stands for it). What comes before is held back and released then; a key with fewer gives
    nothing, and one that waits for longer than wait_ms is given up. A table has no order of arrival: the first by item teach."""
    rows = rows.select(F.col("key").cast("string").alias("key"), F.col("item").cast("long").alias("item"), F.coalesce("discovery", F.lit(False)).alias("discovery"), F.col("value").cast("double").alias("value"))
    if rows.isStreaming:
        return rows.groupBy("key").transformWithState(_Barrier(needed, wait_ms), "key string, item long, taught_by string, config double", "append", "processingTime" if wait_ms else "none")
    place = F.when(F.col("discovery"), F.row_number().over(Window.partitionBy("key", "discovery").orderBy("item")))
    first = rows.where("discovery").withColumn("place", place).where(F.col("place") <= needed)
    taught = first.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x.cast("string")), ",").alias("taught_by"), F.sum(F.coalesce("value", F.lit(0.0))).alias("config"))
    return rows.join(taught.where(F.col("n") == needed).drop("n"), "key").select("key", "item", "taught_by", "config")
