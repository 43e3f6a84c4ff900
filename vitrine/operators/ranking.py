"""Positions in an order over a whole table, without one task that holds all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.shared import shared_path

_ROW = (1 << 33) - 1


def positioned(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """rows with their position, from 1, in the given order, which should leave no ties.

    Rows are dealt by range and sorted within their partitions; a row's place in its partition is added to the rows of the partitions before,
    one number each. The sorted rows are written in between, as a second run of the same plan could deal them differently.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    path = shared_path(spark, "ranked")
    dealt.write.parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit(_ROW)) + 1
    return stored.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_id", "_start")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def least_errors(text: Column, pattern: str, most: int) -> Column:
    """The fewest edits with which the pattern (of 62 characters at most) occurs anywhere in the text, whatever its case; null if it takes
    more than `most`. A bit for each character of the pattern, a word of bits for each number of edits, one step for each character of the
    text: time is the text's length times the edits, and nothing is compared pairwise."""
    pattern = pattern.lower()
    n = len(pattern)
    if not 0 < n <= 62:
        raise ValueError("a pattern has 1 to 62 characters")
    most = min(most, n)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    masks = F.create_map(*[F.lit(x) for c, m in places.items() for x in (c, m)]).cast("map<string,bigint>")
    end, full = F.lit(1 << (n - 1)).cast("long"), F.lit((1 << n) - 1).cast("long")

    one = F.lit(1).cast("long")

    def step(state: Column, c: Column) -> Column:
        return _bound(F.coalesce(F.try_element_at(masks, c), F.lit(0).cast("long")), lambda here: rows_from(state, here, []))

    def rows_from(state: Column, here: Column, rows: list[Column]) -> Column:
        """The words of bits after a character, each bound to a name, as the next one and the outcome use it."""
        d = len(rows)
        if d > most:
            best = state["best"]
            for k in reversed(range(most + 1)):
                best = F.when(rows[k].bitwiseAND(end) != 0, F.least(best, F.lit(k))).otherwise(best)
            return F.struct(*(r.alias(f"r{k}") for k, r in enumerate(rows)), best.alias("best"))
        row = F.shiftleft(state[f"r{d}"], 1).bitwiseOR(one).bitwiseAND(here)
        if d:
            #: One more character in the text; or another one there, or one less, either of which moves on in the pattern.
            row = row.bitwiseOR(state[f"r{d - 1}"]).bitwiseOR(F.shiftleft(state[f"r{d - 1}"].bitwiseOR(rows[-1]), 1)).bitwiseOR(one)
        return _bound(row.bitwiseAND(full), lambda r: rows_from(state, here, [*rows, r]))

    #: Without any character, d edits leave out the first d.
    start = F.struct(*(F.lit((1 << d) - 1).cast("long").alias(f"r{d}") for d in range(most + 1)), F.lit(n if most >= n else most + 1).alias("best"))
    letters = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), ""), lambda c: c != "")
    best = F.aggregate(letters, start, step, lambda state: state["best"])
    return F.when(best <= most, best)


def fuzzy_ranked(rows: DataFrame, pattern: str, weights: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """rows in which a weighted column has the pattern with errors of at most `threshold` of its length, with score: the weighted mean of
    1 - errors / length over all columns, those without a match counting 0. Rows that match nowhere are left out, not ranked last."""
    most = int(threshold * len(pattern))
    named = {c: f"_errors{i}" for i, c in enumerate(weights)}
    #: An array of one or no struct, as a filter on the errors would be worked out before the rows are dealt, and once more after it.
    errors = F.struct(*(least_errors(F.col(c), pattern, most).alias(v) for c, v in named.items()))
    some = lambda e: F.coalesce(*(e[v] for v in named.values())).isNotNull()
    found = rows.select("*", F.inline(F.filter(F.array(errors), some)))
    score = sum((w * F.coalesce(1 - F.col(named[c]) / len(pattern), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)) / sum(weights.values())
    return found.withColumn("score", score).drop(*named.values())
