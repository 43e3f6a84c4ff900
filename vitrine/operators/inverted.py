"""Search by stored inverted indexes, of words and of letter runs.

An index is a folder: `postings/segment/bucket` has, for each token, the ids that hold it, in lists of one range of ids each (so a token
of a third of all rows is many short lists); `rows/segment/block` has the rows by range of ids; `changed/segment` the ids that a batch
replaced or removed; and `segments` one row for each batch that is complete. A batch adds a segment and touches no other file. A row
counts where it stands in the newest segment that has its id.

A search opens the buckets of its tokens alone, goes from the rarest token on, keeps what every token has by intersecting lists of one
range, and then reads only the ranges of rows in which something was found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.shared import read_if_there, staged

#: Ids of one range, and folders of tokens.
RANGE, BUCKETS = 4096, 64
#: Ranges of rows that share a folder.
BLOCK_RANGES = 16
_SPLIT = r"[^\p{L}\p{N}]+"
_SEGMENTS = "segment int, rows long"


def words(text: Column) -> Column:
    """The distinct words of a text, in lower case: runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), lambda w: w != ""))


def runs(text: Column) -> Column:
    """The distinct runs of one, two and three letters of a text, in lower case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    of = lambda t: F.flatten(F.transform(F.array(*(F.lit(n) for n in (1, 2, 3))), lambda n: F.when(F.length(t) >= n, F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(of(low))


def segments(spark: SparkSession, path: str) -> list[int]:
    """The complete segments, oldest first: one small row for each batch."""
    rows = read_if_there(spark, f"{path}/segments", _SEGMENTS)
    return [] if rows is None else sorted(r[0] for r in rows.select("segment").collect())


def add(path: str, rows: DataFrame, split: Callable[[Column], Column], *columns: str, key: str = "product_id", removed: DataFrame | None = None) -> int:
    """Puts a batch into the index at path, which may be new, and returns its segment: rows (key and any other columns), searchable by the
    tokens of `columns`, in place of earlier rows of their keys; and without the rows of the keys in `removed`.

    Of several rows of one key in a batch all are found. Rows without a key can't be found and are left out. A null column has no tokens.
    """
    spark = rows.sparkSession
    segment = max(segments(spark, path), default=-1) + 1
    rows = staged(rows.where(F.col(key).isNotNull()), "batch")
    range_ = F.floor(F.col(key) / RANGE)
    whole = F.concat_ws("\n", *(F.col(c) for c in columns))
    tokens = rows.select(F.col(key).cast("long").alias("id"), F.explode(split(whole)).alias("token"))
    lists = tokens.groupBy("token", F.floor(F.col("id") / RANGE).alias("range")).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    lists = lists.withColumn("bucket", F.pmod(F.crc32(F.col("token").cast("binary")), F.lit(BUCKETS)).cast("int"))
    #: A bucket is dealt by ranges of ids too, so that a common token isn't one task; within a file, a token's lists lie together.
    lists.repartition("bucket", F.pmod("range", F.lit(16))).sortWithinPartitions("bucket", "token", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    rows.withColumn("block", F.floor(range_ / BLOCK_RANGES)).write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows/segment={segment}")
    changed = rows.select(F.col(key).cast("long").alias("id"))
    if removed is not None:
        changed = changed.unionByName(removed.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")))
    changed.distinct().write.mode("overwrite").parquet(f"{path}/changed/segment={segment}")
    spark.createDataFrame([(segment, rows.count())], _SEGMENTS).coalesce(1).write.mode("append").parquet(f"{path}/segments")
    return segment


def holding(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """segment, range and ids of what holds every one of the tokens (at least one), from the rarest token on."""
    tokens = sorted(set(tokens))
    buckets = {t: zlib.crc32(t.encode()) % BUCKETS for t in tokens}
    live = segments(spark, path)
    schema = "token string, range long, ids array<long>, segment int, bucket int"
    if not live:
        return spark.createDataFrame([], "segment int, range long, ids array<long>")
    postings = spark.read.schema(schema).option("basePath", f"{path}/postings").parquet(f"{path}/postings").where(F.col("segment").isin(live) & F.col("bucket").isin(sorted(set(buckets.values()))) & F.col("token").isin(tokens))
    frequency = {r["token"]: r["n"] for r in postings.groupBy("token").agg(F.sum(F.size("ids")).alias("n")).collect()}
    order = sorted(tokens, key=lambda t: (frequency.get(t, 0), t))
    of = lambda t: postings.where((F.col("bucket") == buckets[t]) & (F.col("token") == t)).select("segment", "range", "ids")
    found = of(order[0])
    for t in order[1:]:
        both = found.join(of(t).withColumnRenamed("ids", "others"), ["segment", "range"])
        found = both.select("segment", "range", F.array_intersect("ids", "others").alias("ids")).where(F.size("ids") > 0)
    return found


def rows_of(spark: SparkSession, path: str, found: DataFrame, key: str = "product_id") -> DataFrame:
    """The rows of found ids that no later segment replaced or removed."""
    live = segments(spark, path)
    if not live:
        raise ValueError(f"there is no index at {path}")
    ids = found.select("segment", F.floor(F.col("range") / BLOCK_RANGES).cast("long").alias("block"), F.explode("ids").alias("id"))
    if len(live) > 1:
        changed = spark.read.schema("id long, segment int").parquet(f"{path}/changed").where(F.col("segment").isin(live)).select("id", F.col("segment").alias("later"))
        ids = ids.join(changed, (ids["id"] == changed["id"]) & (changed["later"] > ids["segment"]), "left_anti")
    stored = spark.read.option("basePath", f"{path}/rows").parquet(*(f"{path}/rows/segment={s}" for s in live))
    #: The folders' numbers join first, so Spark prunes folders by what was found.
    hit = ids.select(F.col("segment").alias("_s"), F.col("block").alias("_b"), F.col("id").alias("_id"))
    return stored.join(hit, (stored["segment"] == hit["_s"]) & (stored["block"] == hit["_b"]) & (stored[key] == hit["_id"]), "left_semi").drop("segment", "block")


def with_words(spark: SparkSession, path: str, text: str, key: str = "product_id") -> DataFrame:
    """Rows that have every word of the text, as whole words; a text without words finds nothing."""
    wanted = [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]
    found = holding(spark, path, wanted) if wanted else spark.createDataFrame([], "segment int, range long, ids array<long>")
    return rows_of(spark, path, found, key)


def with_part(spark: SparkSession, path: str, text: str, *columns: str, key: str = "product_id") -> DataFrame:
    """Rows with the text as part of one of the columns, whatever its case: runs of three letters (or of all, if there are fewer) find
    candidates, which are then checked. Blanks around the text don't count, and an empty one finds nothing."""
    text = text.strip().lower()
    n = min(3, len(text))
    found = holding(spark, path, [text[i : i + n] for i in range(len(text) - n + 1)]) if text else spark.createDataFrame([], "segment int, range long, ids array<long>")
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text)), F.lit(False))
    return rows_of(spark, path, found, key).where(hit)
