"""The rate limiter as event-time state: token bucket, slow-down on refusal, ramp-up. One state per site, of fixed size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Rates a second at the start and their bounds, and how they change.
START_RATE, LEAST_RATE, MOST_RATE = 15.0, 2.0, 50.0
SLOWER, HALF, FASTER = 0.9, 0.5, 1.3
RAMP_EVERY, CALM, RAMP_SUCCESSES = 5.0, 10.0, 10
MOST_TOKENS_AFTER_REFUSAL = 3.0
FORCED_AFTER = 60.0
REFUSED = 429
#: Rows that go out at once, and the numbers that a row is held as until then.
BLOCK = 10_000
_NUMBERS = {"ts": "datetime64[us]", "retry_after": "float64"}
OUT = "site string, event_id long, ts timestamp, status int, rate double, tokens double, wait double"
STATE = "tokens double, rate double, last double, window double, refused double, ramped double, successes long, paused double"


@dataclass
class Limiter:
    """A site's limiter; times are seconds."""

    tokens: float = START_RATE
    rate: float = START_RATE
    last: float = -1.0
    window: float = -1.0
    refused: float = -1e9
    ramped: float = -1e9
    successes: int = 0
    paused: float = -1.0

    def step(self, now: float, status: int, retry_after: float | None = None) -> float:
        """Takes a token at `now` and learns from the outcome; the seconds that the request had to wait."""
        if self.last < 0:
            self.last = self.window = now
        start = max(now, self.last, self.paused)
        self.tokens = min(max(self.rate, 1.0), self.tokens + (start - self.last) * self.rate)
        wait = 0.0 if self.tokens >= 1 else min((1 - self.tokens) / self.rate, FORCED_AFTER)
        self.tokens = max(0.0, self.tokens + wait * self.rate - 1)
        self.last = start + wait
        if status == REFUSED:
            elapsed = self.last - self.window
            achieved = SLOWER * self.successes / elapsed if self.successes and elapsed > 0 else HALF * self.rate
            self.rate = min(MOST_RATE, max(LEAST_RATE, min(achieved, self.rate)))
            self.paused = self.last + (retry_after if retry_after is not None else 1.0)
            self.window, self.refused, self.successes = self.last, self.last, 0
            self.tokens = min(self.tokens, MOST_TOKENS_AFTER_REFUSAL)
        else:
            self.successes += 1
            if self.last - self.ramped >= RAMP_EVERY and self.last - self.refused >= CALM and self.successes >= RAMP_SUCCESSES:
                self.rate, self.ramped = min(MOST_RATE, self.rate * FASTER), self.last
        return start + wait - now


def limited(outcomes: DataFrame) -> DataFrame:
    """outcomes (site, event_id, ts, status, retry_after) with the rate, tokens and wait after each, in order of event time within a site.

    A stream's state goes on from batch to batch. A table is dealt by site and sorted, and each site's limiter steps along its rows as they
    come by, so no site is held whole; it is a chain of its requests, which one task follows.
    """
    if outcomes.isStreaming:
        return outcomes.groupBy("site").applyInPandasWithState(_stateful, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        site, limiter = None, Limiter()
        for batch in batches:
            out = []
            times = batch.column("ts").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_pylist()
            for of, now, status, retry in zip(batch.column("site").to_pylist(), times, batch.column("status").to_pylist(), batch.column("retry_after").to_pylist(), strict=True):
                if of != site:
                    site, limiter = of, Limiter()
                wait = limiter.step(now / 1e6, status, retry)
                out.append((limiter.rate, limiter.tokens, wait))
            columns = zip(*out, strict=True) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("site", "event_id", "ts", "status")), *(pa.array(c, pa.float64()) for c in columns)], ["site", "event_id", "ts", "status", "rate", "tokens", "wait"])

    rows = outcomes.select("site", "event_id", "ts", F.col("status").cast("int").alias("status"), F.col("retry_after").cast("double").alias("retry_after"))
    return rows.repartition("site").sortWithinPartitions("site", "ts", "event_id").mapInArrow(run, OUT)


def _stateful(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    limiter = Limiter(**dict(zip((f.name for f in fields(Limiter)), state.get, strict=True))) if state.exists else Limiter()
    for out in _advance(limiter, key[0], batches):
        yield out
    state.update(tuple(asdict(limiter).values()))


def _advance(limiter: Limiter, site: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A site's rows of one batch come in any order, so they are held while they are put in order, as plain numbers alone; what is said of them
    goes out in blocks."""
    parts: dict[str, list[np.ndarray]] = {c: [] for c in ("ts", "event_id", "status", "retry_after")}
    for rows in batches:
        for c, held in parts.items():
            held.append(rows[c].to_numpy(dtype=_NUMBERS.get(c)))
    ts, ids, status, retry = (np.concatenate(parts.pop(c)) for c in list(parts))
    order = np.lexsort((ids, ts))
    for at in range(0, len(order), BLOCK):
        take = order[at : at + BLOCK]
        out = np.empty((len(take), 3))
        for i, (now, said, after) in enumerate(zip(ts[take].astype("int64").tolist(), status[take].tolist(), retry[take].tolist(), strict=True)):
            wait = limiter.step(now / 1e6, int(said), None if after != after else after)
            out[i] = limiter.rate, limiter.tokens, wait
        yield pd.DataFrame({"site": site, "event_id": ids[take], "ts": ts[take], "status": status[take], "rate": out[:, 0], "tokens": out[:, 1], "wait": out[:, 2]})


def statistics(outcomes: DataFrame, width: str = "1 hour") -> DataFrame:
    """Per site and window of event time of outcomes (site, ts, status): requests, refused, the rate of successes a second, and its change against
    the site's window before (null for the first). Windows are few beside requests, so only they are put in order."""
    by = outcomes.groupBy("site", F.window("ts", width).alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") == REFUSED).alias("refused"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    by = by.withColumn("rate", (F.col("requests") - F.col("refused")) / seconds)
    return by.select("site", F.col("w.start").alias("start"), "requests", "refused", "rate", (F.col("rate") - F.lag("rate").over(Window.partitionBy("site").orderBy("w.start"))).alias("change"))


def retry_waits(attempts: DataFrame, base_ms: int = 1000, most_ms: int = 5000, tries: int = 3) -> DataFrame:
    """attempts (url, attempt) with the wait before each: base x 1, 2, 4, capped; attempts beyond `tries` are left out; outcome counts once, by the last."""
    kept = attempts.where(F.col("attempt") <= tries)
    return kept.withColumn("wait_ms", F.least(F.lit(most_ms), (base_ms * F.pow(F.lit(2), F.col("attempt") - 1)).cast("int")))
