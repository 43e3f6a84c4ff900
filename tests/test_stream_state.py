"""State of streams: equal to the whole table for any split into batches, across restarts, and for any order of arrival."""

from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import DataFrame, SparkSession

from vitrine.shared import shared_path
from vitrine.streaming import live, state

ATTEMPTS = "slug string, attempt long, at long, success boolean"
ROWS = "lineage string, item long, at long, verdict string"
ITEMS = "key string, item long, discovery boolean, value double"


def streamed(spark: SparkSession, rows: list[tuple], schema: str, splits: list[int], make) -> DataFrame:  # noqa: ANN001
    """What a stream gives that is stopped and started again after each part of the rows."""
    source, path = shared_path(spark, "parts"), shared_path(spark, "stream")
    for a, b in itertools.pairwise([0, *splits, len(rows)]):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
        live.drained(make(spark.readStream.schema(schema).parquet(source)), "stream", path=path)
    return spark.read.parquet(f"{path}/data")


def told(df: DataFrame) -> list[tuple]:
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.mark.parametrize("splits", [[], [40], [1, 50, 90]])
def test_attempts(spark, splits: list[int]) -> None:
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(12)}", i, i // 2, rng.choice([True, False, False, None])) for i in range(120)]
    got = told(streamed(spark, rows, ATTEMPTS, splits, state.seen_once))
    done, want = set(), []
    for slug, i, at, ok in rows:
        want.append((slug, str(i), str(at), "skipped" if slug in done else "extracted" if ok else "failed"))
        done |= {slug} if ok else set()
    assert got == sorted(want) == told(state.seen_once(spark.createDataFrame(rows, ATTEMPTS)))


@pytest.mark.parametrize(("splits", "approved_first"), [([], True), ([30, 31], True), ([10, 50, 80], False)])
def test_lineages(spark, splits: list[int], approved_first: bool) -> None:
    rng = random.Random(3)
    rows = [(f"l{rng.randrange(6)}", i, i, rng.choice([None, None, None, "approved", "rejected"])) for i in range(100)]
    make = lambda df: state.decided(df, approved_first)
    got = told(streamed(spark, rows, ROWS, splits, make))
    sets, want = {}, []
    for lineage, i, at, verdict in rows:
        known = sets.setdefault(lineage, set())
        if verdict:
            known.add(verdict)
        else:
            order = ("approved", "rejected") if approved_first else ("rejected", "approved")
            want.append((lineage, str(i), str(at), str(next((v for v in order if v in known), None))))
    assert got == sorted(want) == told(make(spark.createDataFrame(rows, ROWS)))


def test_barrier_for_any_arrival(spark) -> None:
    """Keys of two discovery rows release all of their rows whatever comes first; a key of one gives none."""
    rows = [(f"k{k}", 100 * k + i, i in ((2, 5) if k else (2,)), float(i)) for k in range(3) for i in range(8)]
    want = told(state.behind_barrier(spark.createDataFrame(rows, ITEMS)))
    assert len(want) == 16
    for seed, splits in ((0, []), (1, [5, 12]), (2, [20])):
        shuffled = random.Random(seed).sample(rows, len(rows))
        assert told(streamed(spark, shuffled, ITEMS, splits, state.behind_barrier)) == want


def test_barrier_gives_up(spark) -> None:
    """With a time to wait, a key that never has its discovery is dropped when its timer ends, and later rows start anew."""
    source, path = shared_path(spark, "parts"), shared_path(spark, "stream")
    put = lambda rows: spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(source)
    put([("a", 1, True, 1.0), ("a", 2, False, 0.0)])
    for k, v in state.STATE_STORE.items():
        spark.conf.set(k, v)
    rows = state.behind_barrier(spark.readStream.schema(ITEMS).parquet(source), wait_ms=500)
    query = rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").format("parquet").option("path", f"{path}/data").start()
    try:
        batches = lambda: sum(1 for p in query.recentProgress if p["numInputRows"] > 0)
        for wanted, later in ((1, [("a", 3, True, 2.0), ("a", 4, True, 3.0)]), (2, [])):
            end = time.time() + 60
            while batches() < wanted and time.time() < end:
                time.sleep(0.2)
            time.sleep(6)
            if later:
                put(later)
    finally:
        query.stop()
    assert told(spark.read.parquet(f"{path}/data")) == [("a", "3", "3,4", "5.0"), ("a", "4", "3,4", "5.0")]
