"""Queries of served records over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators import catalogue, extract, records, trees
from vitrine.operators.ranking import positioned
from vitrine.plans.catalogue_queries import Query, category_nodes, category_products, products, table, variants
from vitrine.sources.catalogue import NODES_SQL, PRODUCTS_SQL, VARIANTS_SQL

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT 'supplier_' || s_suppkey || '_com' AS brand_id, 'https://supplier.' || s_suppkey || '.com' AS homepage_url, CASE WHEN coalesce(n, 0) > 0 THEN 'completed' ELSE 'pending' END AS status, coalesce(s3, s2, 1) AS last_scrape_at
FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n, max(CASE WHEN l_quantity = 50 THEN l_orderkey END) AS s3, max(CASE WHEN l_quantity > 45 THEN l_orderkey END) AS s2 FROM (SELECT * REPLACE (CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END AS l_suppkey) FROM lineitem) GROUP BY 1) ON l_suppkey = s_suppkey
""")
def brand_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier's lines name no supplier, so it has no run."""
    runs = table(spark, sf_dir, "lineitem").groupBy(F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("s_suppkey")).agg(F.count_distinct("l_partkey").alias("unique_products"), F.max(F.when(F.col("l_quantity") == 50, F.col("l_orderkey"))).alias("stage_3"), F.max(F.when(F.col("l_quantity") > 45, F.col("l_orderkey"))).alias("stage_2"))
    brands = table(spark, sf_dir, "supplier").join(runs, "s_suppkey", "left").withColumn("brand_id", F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string"), F.lit("_com"))).withColumn("stage_1", F.lit(1).cast("long"))
    return records.brand_record(brands).select("brand_id", "homepage_url", "status", "last_scrape_at")


@query(f"SELECT color AS value, count(DISTINCT product_id) AS products, row_number() OVER (ORDER BY count(DISTINCT product_id) DESC, color)::INT AS rank FROM {VARIANTS_SQL} WHERE color IS NOT NULL GROUP BY color")
def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.attribute_values(variants(spark, sf_dir), "color")


@query("""
WITH r AS (SELECT event_type, count(*)::BIGINT AS calls, sum(event_id % 9)::BIGINT AS tokens, 0 AS last FROM events GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*), sum(event_id % 9), 1 FROM events)
SELECT row_number() OVER (ORDER BY last, event_type)::INT AS pos, rpad(event_type, 24, ' ') || lpad(calls::VARCHAR, 14, ' ') || lpad(tokens::VARCHAR, 14, ' ') AS line FROM r
""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 9).alias("tokens"))
    return records.report_lines(by, "event_type", ["calls", "tokens"])


@query("""
SELECT o_orderkey AS run_id, row_number() OVER w::INT AS run_no, date_diff('day', (lead(o_orderdate) OVER w)::DATE, o_orderdate::DATE)::INT AS days_since FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)
""")
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("run_id"), "o_orderdate")
    return records.run_history(runs, "o_custkey", "o_orderdate").select("run_id", "run_no", "days_since")


@query("SELECT o_orderkey AS job_id, count(*) OVER (PARTITION BY o_orderstatus) AS of_status, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS position FROM orders WHERE o_orderstatus = 'P'")
def jobs_with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("started"), F.col("o_orderstatus").alias("status"))
    return records.jobs_with_status(jobs, "P").select("job_id", "of_status", "position")


@query("SELECT conv_id, string_agg('[' || pos || ']' || chr(10) || CASE WHEN length(text) > 3000 THEN left(text, 3000) || chr(10) || '... [truncated]' ELSE text END, chr(10) || chr(10) ORDER BY pos) AS payload FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations) GROUP BY conv_id")
def model_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("parts"))
    return by.select("conv_id", records.shaped_payload(F.col("parts"), "response").alias("payload"))


@query(f"SELECT product_id FROM {PRODUCTS_SQL} WHERE kind = 'LARGE' AND size_no = 7")
def attribute_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = F.create_map(F.lit("kind"), F.col("kind"), F.lit("size"), F.col("size_no").cast("string"))
    return records.products_by_attribute(records.products_by_attribute(products(spark, sf_dir), attributes, "size", "7"), attributes, "kind", "LARGE").select("product_id")


@query(f"SELECT product_id FROM {PRODUCTS_SQL} WHERE kind = 'PROMO'")
def classification_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(F.struct(F.lit("category").alias("type"), F.col("kind").alias("name")), F.struct(F.lit("brand").alias("type"), F.col("brand_id").alias("name")))
    return records.in_classification(products(spark, sf_dir), tags, "PROMO", "category").select("product_id")


@query(r"""
SELECT page_id, count(DISTINCT h || '|' || t) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS t FROM pages) GROUP BY page_id
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.site_links_summary(extract.links(table(spark, sf_dir, "pages")), "page_id").select("page_id", "links")


@query(f"""
WITH RECURSIVE nodes AS {NODES_SQL}, up AS (SELECT node_id, node_id AS a, parent_id AS nxt FROM nodes UNION ALL SELECT up.node_id, p.node_id, p.parent_id FROM up JOIN nodes p ON p.node_id = up.nxt),
listed AS (SELECT DISTINCT CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_suppkey END AS node_id FROM lineitem), kept AS (SELECT DISTINCT a FROM up WHERE node_id IN (SELECT node_id FROM listed))
SELECT node_id, name FROM nodes WHERE node_id IN (SELECT a FROM kept)
""")
def category_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruned to categories with products, a single root's level taken away."""
    listed = category_products(spark, sf_dir).withColumn("node_id", F.expr("CASE WHEN cast(substring(node_id, 2) AS int) % 2 = 0 THEN node_id END"))
    return trees.collapsed(trees.pruned(category_nodes(spark, sf_dir), listed)).select("node_id", "name")


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+[|–—-]\s+[^|–—-]*$', '')) AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(extract.meta_fields(F.col("html"))["name"], F.lit("")).alias("title"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE props IS NOT NULL")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_id", F.try_parse_json("props").alias("p"))
    return rows.select("event_id", F.try_variant_get("p", "$.k", "int").alias("k"))


@query(f"SELECT product_id, price, row_number() OVER (ORDER BY p DESC, product_id) AS position FROM (SELECT *, coalesce(TRY_CAST(regexp_replace(CASE WHEN product_id % 7 = 0 THEN 'sold out' ELSE '$' || price END, '[^0-9.]', '', 'g') AS DOUBLE), 0) AS p FROM {PRODUCTS_SQL})")
def shown_price_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("product_id") % 7 == 0, "sold out").otherwise(F.concat(F.lit("$"), F.col("price").cast("string")))
    rows = products(spark, sf_dir).select("product_id", "price", catalogue.price_of_text(shown).alias("shown"))
    return positioned(rows, F.col("shown").desc(), F.col("product_id").asc()).drop("shown")
