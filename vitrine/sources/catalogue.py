"""The driver's star schema seen as a catalogue, and readers of catalogue files.

part plays the products, lineitem their variants, region, nation and customer a category tree, orders favourites and runs, events requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.shared import spread

#: A product file as it is stored; what a file lacks is null.
PRODUCT_SCHEMA = "name string, price double, currency string, images array<string>, description string, url string, source_url string, brand string, sku string, category string, variants array<struct<size:string,color:string,sku:string,price:double,available:boolean>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Expressions that Spark and DuckDB read alike.
PRODUCT_COLUMNS = {
    "product_id": "p_partkey",
    "brand_id": "lower(replace(p_brand, '#', '_'))",
    "name": "p_name",
    "price": "p_retailprice",
    "kind": "p_type",
    "size_no": "p_size",
    "url": "'https://www.' || lower(replace(p_brand, '#', '-')) || '.example.com/collections/' || lower(p_type) || '/products/' || replace(p_name, ' ', '-') || '-' || cast(p_partkey % 500 AS string)"
    " || CASE WHEN p_partkey % 3 = 0 THEN '?variant=' || cast(p_size AS string) WHEN p_partkey % 5 = 0 THEN '/' ELSE '' END",
}


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in PRODUCT_COLUMNS.items()])


def dealt_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """products for work that is heavy row by row, dealt to all tasks while its rows are narrow: a part file of a million rows is read by one or two."""
    return spread(products(spark, sf_dir), "product_id")


PRODUCTS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in PRODUCT_COLUMNS.items()) + " FROM part)"

#: Colours by the digit of a line; a variant without stock is one that was returned.
VARIANT_COLUMNS = {
    "product_id": "l_partkey",
    "size": "CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'XS' WHEN 1 THEN 'S' WHEN 2 THEN 'M' WHEN 3 THEN 'L' ELSE NULL END",
    "color": "CASE l_linenumber % 4 WHEN 0 THEN 'black' WHEN 1 THEN 'white' WHEN 2 THEN 'red' ELSE NULL END",
    "sku": "cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string)",
    "price": "l_extendedprice",
    "available": "CASE l_returnflag WHEN 'N' THEN true WHEN 'R' THEN false ELSE NULL END",
}


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{v} AS {k}" for k, v in VARIANT_COLUMNS.items()])


VARIANTS_SQL = "(SELECT " + ", ".join(f"{v} AS {k}" for k, v in VARIANT_COLUMNS.items()) + " FROM lineitem)"

_NODES = """
SELECT 'r' || cast(r_regionkey AS string) AS node_id, cast(NULL AS string) AS parent_id, cast(r_regionkey AS bigint) AS ordinal, r_name AS name, cast(NULL AS string) AS url FROM region
UNION ALL SELECT 'n' || cast(n_nationkey AS string), 'r' || cast(n_regionkey AS string), cast(n_nationkey AS bigint), CASE WHEN n_nationkey % 5 = 0 THEN 'View All' ELSE n_name END, 'https://shop.example.com/collections/' || lower(n_name) FROM nation
UNION ALL SELECT 's' || cast(s_suppkey AS string), 'n' || cast(s_nationkey AS string), s_suppkey, s_name, CASE WHEN s_suppkey % 7 = 0 THEN 'https://shop.example.com/collections/nation_' || cast(s_nationkey AS string) ELSE 'https://shop.example.com/collections/s/' || cast(s_suppkey AS string) END FROM supplier
"""
NODES_SQL = f"({_NODES})"


def category_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge table: node_id, parent_id, ordinal, name, url. Regions are roots without URL, suppliers leaves."""
    return spark.sql(_NODES.replace("FROM region", "FROM {region}").replace("FROM nation", "FROM {nation}").replace("FROM supplier", "FROM {supplier}"), **{t: table(spark, sf_dir, t) for t in ("region", "nation", "supplier")})


#: The products that a category lists: those of its lines, in order of line; a bridge.
BRIDGE_SQL = "(SELECT 's' || cast(l_suppkey AS string) AS node_id, l_partkey AS product_id, min(l_orderkey) AS pos FROM lineitem GROUP BY l_suppkey, l_partkey)"


def category_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node_id"), F.col("l_partkey").alias("product_id")).agg(F.min("l_orderkey").alias("pos"))


def read_product_files(spark: SparkSession, path: str, schema: str | StructType = PRODUCT_SCHEMA, strict: bool = True) -> DataFrame:
    """JSON files of products in nested folders: their fields, file_path, modified_at, brand_id and the classification their folders name.

    strict: a malformed file fails the read; else it gives a row of nulls. Files lie in <path>/<brand_id>/products/<classification>/<name>.json.
    """
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    rows = rows.withColumn("file_path", F.col("_metadata.file_path")).withColumn("modified_at", F.col("_metadata.file_modification_time"))
    place = r"/([^/]+)/products/(?:(.*)/)?[^/]+\.json$"
    return rows.withColumn("brand_id", F.nullif(F.regexp_extract("file_path", place, 1), F.lit(""))).withColumn("classification", F.nullif(F.regexp_extract("file_path", place, 2), F.lit("")))


def read_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Whole JSON files as VARIANT: file_path, body; a malformed file has a null body. For trees, whose depth no schema fits."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.try_parse_json("value").alias("body"))


def list_brands(spark: SparkSession, path: str) -> DataFrame:
    """Brands: the folders that hold nav.json or brand.json."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{nav,brand}.json").load(path)
    return files.select(F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("brand_id")).distinct()


def product_json_url(url: Column) -> Column:
    """The address of a shop product's JSON: no query, no trailing slash, `.json` added."""
    return F.concat(F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "/+$", ""), F.lit(".json"))
