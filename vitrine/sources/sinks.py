"""Sinks of a catalogue: upserts by key, small stores, exports and clean-up. A sink is a table; a write is a merge into it and a new version of it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.text import slug
from vitrine.operators.ranking import positioned


def product_path(category: Column, source_url: Column, name: Column) -> Column:
    """products/<category>/<slug>.json: the slug is the URL's last segment, else one of the name."""
    last = F.element_at(F.split(F.regexp_replace(F.split_part(source_url, F.lit("?"), F.lit(1)), "/+$", ""), "/"), -1)
    return F.concat(F.lit("products/"), category, F.lit("/"), F.coalesce(F.nullif(last, F.lit("")), slug(name)), F.lit(".json"))


def upserted(old: DataFrame | None, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Old and new rows, of each key the latest by `order`; one aggregation over both."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    whole = F.struct(*[c for c in rows.columns if c not in key])
    return rows.groupBy(*key).agg(F.max_by(whole, order).alias("r")).select(*key, "r.*")


def replace_table(spark: SparkSession, rows: DataFrame, path: str, partition: list[str] | None = None) -> str:
    """Writes a new version beside the old ones and returns its folder, so readers of the old one aren't disturbed and a retry leaves no half table."""
    version = f"{path}/version={uuid.uuid4().hex}"
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(version)
    return version


def with_stage(metrics: DataFrame, stage: str, values: DataFrame) -> DataFrame:
    """Metrics (brand, stage, ...) with one stage's rows replaced, others kept."""
    return metrics.where(F.col("stage") != stage).unionByName(values.withColumn("stage", F.lit(stage)), allowMissingColumns=True)


def insert_unique(rows: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the new ones whose key is free, new with inserted). Of new rows of one key, one is inserted. One aggregation over the keys of
    both says so; nulls in keys are equal."""
    rest = [c for c in new.columns if c not in key]
    given = new.select(*key, F.lit(True).alias("_new"), *([F.struct(*rest).alias("_row")] if rest else []))
    both = rows.select(*key, F.lit(False).alias("_new")).unionByName(given, allowMissingColumns=True)
    one = [F.first("_row", ignorenulls=True).alias("_row")] if rest else []
    came = both.groupBy(*key).agg(F.bool_or("_new").alias("_new"), F.bool_and("_new").alias("inserted"), *one).where("_new")
    return rows.unionByName(came.where("inserted").select(*key, *(["_row.*"] if rest else []))), came.select(*key, "inserted")


def delete(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns that a change supplies; null in a change means unchanged."""
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return rows.join(new, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns])


def next_folder(users: DataFrame, column: str = "user_folder") -> DataFrame:
    """The folder of the next user: one more than the largest number, three digits."""
    n = F.max(F.regexp_extract(column, r"(\d+)$", 1).try_cast("int"))
    return users.agg(F.concat(F.lit("user_"), F.lpad((F.coalesce(n, F.lit(0)) + 1).cast("string"), 3, "0")).alias("next_folder"))


def without_user(tables: dict[str, DataFrame], user_id: int) -> dict[str, DataFrame]:
    """All tables without a user's rows: a delete that cascades."""
    return {k: t.where(F.col("user_id") != user_id) for k, t in tables.items()}


def deactivated(users: DataFrame, sessions: DataFrame, user_id: int) -> tuple[DataFrame, DataFrame]:
    return users.withColumn("is_active", F.col("is_active") & (F.col("user_id") != user_id)), sessions.where(F.col("user_id") != user_id)


def write_csv(rows: DataFrame, path: str) -> None:
    """An export with a header; arrays become text joined by ";"."""
    flat = rows.select(*[F.array_join(c, ";").alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", True).csv(path)


def write_lines(rows: DataFrame, column: str, path: str) -> None:
    rows.select(column).write.mode("overwrite").text(path)


def write_json_with_sets(rows: DataFrame, path: str) -> None:
    """JSON lines; a set is written as a sorted list, so files of equal results are equal."""
    rows.select(*[F.array_sort(c).alias(c) if t.startswith("array<string") else F.col(c) for c, t in rows.dtypes]).write.mode("overwrite").json(path)


#: What each stage of a pipeline leaves behind; a brand's own record always stays.
ARTIFACTS = {1: ["nav.json", "nav_readable.txt"], 2: ["urls.json", "urls_readable.txt", "raw_urls.txt"], 3: ["products", "config.json"]}


def kept_artifacts(files: DataFrame, stages: list[int]) -> DataFrame:
    """The files (name) that stay when stages run again."""
    gone = [a for s in stages for a in ARTIFACTS[s]]
    return files.where(~F.split_part("name", F.lit("/"), F.lit(1)).isin(gone))


def combined_log(logs: DataFrame) -> DataFrame:
    """Categories of all logs by falling count: rank, category, products."""
    by = logs.groupBy("category").agg(F.sum("products").alias("products"))
    return positioned(by, F.desc("products"), F.col("category"), name="rank").withColumn("rank", F.col("rank").cast("int"))


def normalized_results(products: DataFrame, nodes: DataFrame, usage: DataFrame, run: DataFrame) -> dict[str, DataFrame]:
    """The tables of a finished run, ready for replace_table: brands, navigation, products, patterns, runs."""
    brands = products.groupBy("brand_id").agg(F.count("*").alias("total_products"), F.max("updated_at").alias("last_scrape_at"))
    return {"brands": brands, "navigation": nodes, "products": products, "patterns": usage, "runs": run}
