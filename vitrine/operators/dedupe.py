"""De-duplication: by canonical URL, by path, across lists, by run; each keeps a row that is fixed by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.urls import canonical, host, path, query, scheme


def first_per(rows: DataFrame, key: list[str | Column], *order: Column) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest_per_url(files: DataFrame) -> DataFrame:
    """Of the files (url, modified_at, file_path) of one canonical URL, the newest; of equals the first path. A file without URL stays."""
    key = F.coalesce(F.nullif(canonical(F.col("url")), F.lit("")), F.col("file_path"))
    return first_per(files, [key], F.col("modified_at").desc(), F.col("file_path").asc())


def best_per_path(urls: DataFrame) -> DataFrame:
    """Of the URLs (pos, url) of one scheme, host and path, one without query before others, the shorter, the first; with new positions."""
    u = F.col("url")
    kept = first_per(urls, [F.concat_ws("|", scheme(u), host(u), path(u))], (query(u) != "").asc(), F.length(u).asc(), F.col("pos").asc())
    return kept


def url_summary(urls: DataFrame) -> DataFrame:
    """raw, unique, removed, and whether more than 70 % went."""
    u = F.col("url")
    counts = urls.agg(F.count("*").alias("raw"), F.count_distinct(F.concat_ws("|", scheme(u), host(u), path(u))).alias("deduped"))
    return counts.withColumn("removed", F.col("raw") - F.col("deduped")).withColumn("warning", F.col("removed") > 0.7 * F.col("raw"))


def across_lists(products: DataFrame) -> DataFrame:
    """Products (list_no, pos, url, brand, name) after a merge of lists: a URL once; a (brand, name) again only from the list that had it first."""
    by_url = first_per(products, ["url"], F.col("list_no").asc(), F.col("pos").asc())
    return by_url.withColumn("first_list", F.min("list_no").over(Window.partitionBy("brand", "name"))).where("list_no = first_list").drop("first_list")


def merged_over_categories(rows: DataFrame) -> DataFrame:
    """One row per product URL of (pos, url, name, category_url): the first row's name and the distinct categories in order."""
    first = rows.groupBy("url", "category_url").agg(F.min("pos").alias("pos"), F.min_by("name", "pos").alias("name"))
    return first.groupBy("url").agg(F.min_by("name", "pos").alias("name"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "category_url"))), lambda x: x["category_url"]), ";").alias("categories"))


def latest_job(jobs: DataFrame, key: str, start: str) -> DataFrame:
    return first_per(jobs, [key], F.col(start).desc(), F.col("job_id").desc())


def runs(rows: DataFrame, partition: list[str], order: list[str], *value: str) -> DataFrame:
    """Adds run_no: a new run begins wherever the value changes in order, so a value may have several."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = F.lit(False)
    for v in value:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w)) | (F.row_number().over(w) == 1)
    return rows.withColumn("_new", changed.cast("int")).withColumn("run_no", F.sum("_new").over(w).cast("long")).drop("_new")
