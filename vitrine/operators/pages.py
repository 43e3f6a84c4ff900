"""Pages of a stored order: any page costs the reading of the one or two ranges that it lies in.

The rows are dealt into ranges of the order, sorted and numbered; each range is a folder, and one small row per range has its size, its
start and its first key. A page is found by its numbers from those rows, or by the last row of the page before.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.operators.ranking import positioned

#: Rows of a range, about.
RANGE_ROWS = 100_000
_RANGES = "range long, rows long, columns string"


def store_order(rows: DataFrame, path: str, *order: Column, range_rows: int = RANGE_ROWS) -> None:
    """Writes rows in the order, which should leave no ties, with `position` from 1, in ranges (folders) of range_rows positions."""
    ranked = positioned(rows, *order).withColumn("range", F.expr(f"(position - 1) DIV {range_rows}"))
    ranked.repartition("range").sortWithinPartitions("range", "position").write.partitionBy("range").parquet(f"{path}/rows")
    spark = rows.sparkSession
    sizes = spark.read.schema(ranked.schema).parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("rows"))
    #: A row without a range has the columns, so that an empty order can be read too.
    sizes.withColumn("columns", F.lit(None).cast("string")).unionByName(spark.createDataFrame([(None, 0, ranked.schema.json())], _RANGES)).coalesce(1).write.parquet(f"{path}/ranges")


def _stored(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    found = spark.read.schema(_RANGES).parquet(f"{path}/ranges").agg(F.max("columns").alias("columns"), F.sum("rows").alias("rows")).first()
    return spark.read.schema(StructType.fromJson(json.loads(found["columns"]))).parquet(f"{path}/rows"), found["rows"]


def stored_page(spark: SparkSession, path: str, offset: int = 0, limit: int = 50, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows after the first `offset`, `limit` at most, with position, total and has_more; only the folders of their ranges are opened."""
    stored, n = _stored(spark, path)
    first, last = offset // range_rows, (offset + limit - 1) // range_rows
    rows = stored.where(F.col("range").between(first, last) & F.col("position").between(offset + 1, offset + limit))
    return rows.drop("range").withColumns({"total": F.lit(n).cast("long"), "has_more": F.lit(offset + limit < n)})


def numbered_page(spark: SparkSession, path: str, number: int, size: int = 50, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Page `number`, from 1, with page, pages (rounded up), total, has_next and has_prev; a page beyond the last has no rows."""
    rows = stored_page(spark, path, (number - 1) * size, size, range_rows)
    pages = F.ceil(F.col("total") / size).cast("int")
    return rows.drop("has_more").withColumns({"page": F.lit(number), "pages": pages, "has_next": F.lit(number) < pages, "has_prev": F.lit(number > 1)})


def page_after(spark: SparkSession, path: str, position: int, limit: int = 50, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The page that follows a row, by its position: how a reader goes on without counting from the start."""
    return stored_page(spark, path, position, limit, range_rows)
