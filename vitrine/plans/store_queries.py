"""Queries of stored indexes, of tables that change by partition, and of stored orders, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import catalogue, inverted, pages
from vitrine.plans.catalogue_queries import Query, category_nodes, products, table
from vitrine.shared import shared_path
from vitrine.sources import versions
from vitrine.sources.catalogue import NODES_SQL, PRODUCTS_SQL

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = r"regexp_extract_all(lower(concat_ws(chr(10), {})), '[\pL\pN]+')"


# Indexes


@query(f"SELECT product_id, brand_id, name FROM {PRODUCTS_SQL} WHERE list_has_all({_WORDS.format('name, kind')}, ['promo', 'red'])")
def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both words as whole words, in any column and any brand, by the stored index."""
    path = shared_path(spark, "words")
    inverted.add(path, products(spark, sf_dir), inverted.words, "name", "kind")
    return inverted.with_words(spark, path, "Promo red").select("product_id", "brand_id", "name")


@query(f"SELECT doc_id, lang FROM documents WHERE list_has_all({_WORDS.format('text')}, ['the', 'of', 'and']) OR list_has_all({_WORDS.format('text')}, ['der', 'und'])")
def document_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of whole texts; two searches of it, together."""
    path = shared_path(spark, "document-words")
    inverted.add(path, table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), inverted.words, "text", key="doc_id")
    found = [inverted.with_words(spark, path, text, key="doc_id").select("doc_id", "lang") for text in ("and of the", "und der")]
    return found[0].unionByName(found[1]).distinct()


@query(f"""
WITH p AS (SELECT * FROM {PRODUCTS_SQL}), now AS (
  SELECT product_id, name FROM p WHERE product_id % 7 > 1 UNION ALL SELECT product_id, name || ' fresh' FROM p WHERE product_id % 7 = 1
) SELECT product_id, name, 'red' AS said FROM now WHERE list_has_all({_WORDS.format('name')}, ['red']) UNION ALL SELECT product_id, name, 'fresh' FROM now WHERE list_has_all({_WORDS.format('name')}, ['fresh', 'ring'])
""")
def word_search_after_a_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch renames a seventh of the products and removes another: the index gets a segment, and finds rows as they are now."""
    path, rows = shared_path(spark, "words"), products(spark, sf_dir)
    inverted.add(path, rows, inverted.words, "name")
    renamed = rows.where("product_id % 7 = 1").withColumn("name", F.concat("name", F.lit(" fresh")))
    inverted.add(path, renamed, inverted.words, "name", removed=rows.where("product_id % 7 = 0").select("product_id"))
    said = lambda text, word: inverted.with_words(spark, path, text).select("product_id", "name", F.lit(word).alias("said"))
    return said("red", "red").unionByName(said("ring fresh", "fresh"))


def _parts(words: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT product_id, name, '{w}' AS said FROM {PRODUCTS_SQL} WHERE lower(name) LIKE '%{w}%'" for w in words)


@query(_parts(("widg", "ed w", "bo", "z")))
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of names: by runs of three letters from three on, of two or one for shorter texts; candidates are read by id and checked."""
    path = shared_path(spark, "runs")
    inverted.add(path, products(spark, sf_dir), inverted.runs, "name")
    found = None
    for part in ("widg", "ed w", "bo", "z"):
        rows = inverted.with_part(spark, path, part, "name").select("product_id", "name", F.lit(part).alias("said"))
        found = rows if found is None else found.unionByName(rows)
    return found


# Tables that change by partition

_CHANGED = "('brand_3', 'brand_7')"


@query(f"""
SELECT brand_id, count(*) AS products, round(sum(CASE WHEN brand_id IN {_CHANGED} AND product_id % 2 = 0 THEN price / 2 ELSE price END), 2) AS price, brand_id IN {_CHANGED} AS rewritten
FROM {PRODUCTS_SQL} GROUP BY brand_id
""")
def upserted_brand_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sale of two brands: every second price is halved. Only these brands' folders are written again."""
    path = shared_path(spark, "products-by-brand")
    rows = products(spark, sf_dir).select("brand_id", "product_id", "name", "price", F.lit(0).alias("at"))
    versions.upsert(spark, path, rows, "brand_id", ["product_id"], "at")
    sale = rows.where("brand_id IN ('brand_3', 'brand_7') AND product_id % 2 = 0").select("brand_id", "product_id", "name", (F.col("price") / 2).alias("price"), F.lit(1).alias("at"))
    versions.upsert(spark, path, sale, "brand_id", ["product_id"], "at")
    now, before = (versions.manifest(spark, path, v).where("value IS NOT NULL").select("value", F.col("folder").alias(f"v{v}")) for v in (2, 1))
    moved = now.join(before, "value", "left").select(F.col("value").alias("brand_id"), (~F.col("v1").eqNullSafe(F.col("v2"))).alias("rewritten"))
    return versions.snapshot(spark, path).groupBy("brand_id").agg(F.count("*").alias("products"), F.round(F.sum("price"), 2).alias("price")).join(moved, "brand_id")


@query(f"SELECT substr(node_id, 1, 1) AS kind, count(*) AS nodes, count(*) FILTER (name LIKE 'New %') AS fresh FROM (SELECT node_id, CASE WHEN node_id LIKE 'n%' THEN 'New ' || name ELSE name END AS name FROM {NODES_SQL}) GROUP BY 1")
def replaced_tree_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A level of the tree is saved anew, the others stay; the first version can still be read."""
    path = shared_path(spark, "trees")
    rows = category_nodes(spark, sf_dir).withColumn("kind", F.left("node_id", F.lit(1)))
    versions.replace(spark, path, rows, "kind")
    versions.replace(spark, path, versions.snapshot(spark, path, version=1, values=["n"]).withColumn("name", F.concat(F.lit("New "), "name")), "kind")
    return versions.snapshot(spark, path).groupBy("kind").agg(F.count("*").alias("nodes"), F.count_if(F.col("name").startswith("New ")).alias("fresh"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS look FROM orders)
SELECT user_id, count(*) AS favourites FROM o WHERE NOT (look = '5-LOW' AND user_id % 3 = 0) GROUP BY user_id
""")
def favourite_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites by bucket of users: inserted twice with most of them known, then some removed."""
    path = shared_path(spark, "favourites")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("look"), F.pmod(F.hash("o_custkey"), F.lit(8)).alias("bucket"), "o_orderkey")
    for part in (rows.where("o_orderkey % 2 = 0"), rows):
        versions.insert(spark, path, part.drop("o_orderkey"), "bucket", ["user_id", "look"])
    versions.remove(spark, path, rows.where("look = '5-LOW' AND user_id % 3 = 0").select("bucket", "user_id", "look"), "bucket", ["user_id", "look"])
    return versions.snapshot(spark, path).groupBy("user_id").agg(F.count("*").alias("favourites"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 AND c_custkey % 2 = 0 THEN 'noted' ELSE c_name END AS note, c_acctbal AS balance, c_nationkey AS nation FROM customer")
def preference_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of one nation's users change; the balance isn't supplied, so it stays."""
    path = shared_path(spark, "preferences")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("note"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    versions.insert(spark, path, rows, "nation", ["id"])
    changes = rows.where("nation = 3 AND id % 2 = 0").select("id", F.lit("noted").alias("note"), F.lit(None).cast("double").alias("balance"), "nation")
    versions.change(spark, path, changes, "nation", "id")
    return versions.snapshot(spark, path)


# Stored orders


@query("""
SELECT event_id, position, total, CAST(page AS INTEGER) AS page, CAST(ceil(total / 40.0) AS INTEGER) AS pages FROM (
  SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS position, count(*) OVER () AS total, 1 AS page FROM events
) WHERE position <= 40
UNION ALL
SELECT event_id, position, total, CAST(ceil(total / 40.0) AS INTEGER), CAST(ceil(total / 40.0) AS INTEGER) FROM (
  SELECT event_id, row_number() OVER (ORDER BY value DESC NULLS LAST, event_id) AS position, count(*) OVER () AS total FROM events
) WHERE position > (CAST(ceil(total / 40.0) AS INTEGER) - 1) * 40
""")
def first_and_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of all events costs what the first one does: a range or two of the stored order."""
    path = shared_path(spark, "ordered-events")
    pages.store_order(table(spark, sf_dir, "events"), path, F.col("value").desc_nulls_last(), F.col("event_id"), range_rows=1000)
    first = pages.numbered_page(spark, path, 1, 40, range_rows=1000)
    last = pages.numbered_page(spark, path, first.first()["pages"], 40, range_rows=1000)
    return first.unionByName(last).select("event_id", "position", "total", "page", "pages")


@query(f"SELECT product_id, price, position, total, position <= 60 AS first FROM (SELECT product_id, price, row_number() OVER (ORDER BY price DESC NULLS LAST, product_id) AS position, count(*) OVER () AS total FROM {PRODUCTS_SQL}) WHERE position <= 60 OR position BETWEEN 1001 AND 1030")
def pages_by_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader goes on from the last row that it has; another enters far down."""
    path = shared_path(spark, "ordered-products")
    pages.store_order(products(spark, sf_dir), path, *catalogue.sort_key("price_desc"), range_rows=500)
    one = pages.stored_page(spark, path, 0, 30, range_rows=500)
    two = pages.page_after(spark, path, one.agg(F.max("position")).first()[0], 30, range_rows=500)
    deep = pages.page_after(spark, path, 1000, 30, range_rows=500)
    return one.unionByName(two).unionByName(deep).select("product_id", "price", "position", "total", (F.col("position") <= 60).alias("first"))
