"""Queries of merges, usage, joins and look files over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import text
from vitrine.operators import catalogue, joins, looks, merge, usage
from vitrine.plans.catalogue_queries import Query, products, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Merging extractions: each line of an order is a strategy's result for its part

_STRATEGY = "['shopify', 'ld_json', 'html_meta', 'api_intercept', 'embedded_json', 'llm_schema', 'other']"
_RESULTS = f"""(SELECT l_partkey AS url, ({_STRATEGY})[l_linenumber] AS strategy, max(l_orderkey % 101) AS score,
  CASE WHEN max(l_orderkey) % 3 = 0 THEN '' ELSE 'name ' || max(l_orderkey) END AS name, CASE WHEN max(l_orderkey) % 4 <> 0 THEN max(l_quantity) END AS price, CASE WHEN max(l_orderkey) % 5 = 0 THEN 'EUR' END AS currency, NULL::VARCHAR AS description
  FROM lineitem WHERE l_linenumber <= 7 GROUP BY 1, 2)"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("shopify", "ld_json", "html_meta", "api_intercept", "embedded_json", "llm_schema", "other")])
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 7").select(F.col("l_partkey").alias("url"), F.get(names, F.col("l_linenumber") - 1).alias("strategy"), "l_orderkey", "l_quantity")
    last = F.max("l_orderkey")
    return rows.groupBy("url", "strategy").agg(
        F.max(F.col("l_orderkey") % 101).alias("score"),
        F.when(last % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("name "), last.cast("string"))).alias("name"),
        F.when(last % 4 != 0, F.max("l_quantity")).alias("price"),
        F.when(last % 5 == 0, F.lit("EUR")).alias("currency"),
        F.lit(None).cast("string").alias("description"),
    )


@query(f"""
SELECT url, arg_max(name, k) FILTER (name <> '') AS name, arg_max(price, kd) FILTER (price IS NOT NULL) AS price, arg_max(currency, k) FILTER (currency IS NOT NULL) AS currency, arg_max(strategy, k) AS strategy
FROM (SELECT *, lpad(score::VARCHAR, 4, '0') || strategy AS k, CASE WHEN strategy = 'shopify' THEN '1' ELSE '0' END || lpad(score::VARCHAR, 4, '0') || strategy AS kd FROM {_RESULTS}) GROUP BY url
""")
def merged_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_by_score(_results(spark, sf_dir), {"name": "string", "price": "number", "currency": "string"}, {"price": "shopify"})


@query(f"""
SELECT url, strategy, coalesce(name, '') AS name, coalesce(price, 0.0) AS price, coalesce(nullif(currency, ''), 'USD') AS currency, coalesce(name, '') = '' AS missing_name, price IS NULL AS missing_price, coalesce(currency, '') = '' AS missing_currency FROM {_RESULTS}
""")
def defaulted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.with_defaults(_results(spark, sf_dir)).select("url", "strategy", "name", "price", "currency", "missing_name", "missing_price", "missing_currency")


@query(f"""
WITH c AS (SELECT unnest(['name', 'price']) AS field, strategy, score FROM {_RESULTS}), p AS (SELECT DISTINCT field, strategy FROM c WHERE score > 98)
SELECT field, arg_min(strategy, coalesce(list_position({_STRATEGY}, strategy), 99)) AS strategy FROM p GROUP BY field
""")
def cheapest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = _results(spark, sf_dir).select(F.explode(F.array(F.lit("name"), F.lit("price"))).alias("field"), "strategy", (F.col("score") > 98).alias("passes"))
    return merge.cheapest_sources(checks)


@query("""
SELECT l_shipmode AS selector, min(pos) AS first, sum(n)::BIGINT AS products, count(*) AS uses, count(DISTINCT lineage) AS lineages, min(pos) = min(min(pos)) OVER () AS is_primary
FROM (SELECT l_orderkey * 8 + l_linenumber AS pos, l_returnflag || l_linestatus AS l_shipmode, l_quantity::BIGINT AS n, l_suppkey % 17 AS lineage FROM lineitem) GROUP BY 1
""")
def pattern_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("selector"), F.col("l_quantity").cast("long").alias("products"), (F.col("l_suppkey") % 17).alias("lineage"))
    return merge.pattern_usage(rows)


@query("""
WITH s AS (SELECT arg_max(l_returnflag = 'N', l_orderkey * 8 + l_linenumber) AS available, CASE WHEN l_partkey % 2 = 0 THEN l_partkey END AS id FROM lineitem GROUP BY 2)
SELECT p_partkey AS id, p_size AS size, available FROM part LEFT JOIN s ON id = p_partkey
""")
def availability_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line names no product, so products lack stock."""
    stock = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).alias("id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), (F.col("l_returnflag") == "N").alias("available"))
    return merge.availability_by_size(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), stock)


# Usage and progress: events are calls, orders jobs


@query("""
SELECT stage, operation, grouping(stage, operation)::INT AS level, count(*) AS calls, sum(ti)::BIGINT AS tokens_in, sum(tt)::BIGINT AS tokens_out, round(sum(ti) / 1e6 * 3 + sum(tt) / 1e6 * 15, 6) AS cost
FROM (SELECT event_type AS stage, 'op' || (user_id % 4) AS operation, event_id % 1000 AS ti, event_id % 77 AS tt FROM events) GROUP BY ROLLUP (stage, operation)
""")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.concat(F.lit("op"), (F.col("user_id") % 4).cast("string")).alias("operation"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"))
    return usage.usage_rollup(calls)


@query("""
SELECT user_id, round(sum(value), 6) AS duration, round(sum(value) * 0.5, 6) AS cost, count(*) AS calls, max(event_id % 50) AS products, CASE WHEN max(event_id % 50) <> 0 THEN round(round(sum(value) * 0.5, 6) / max(event_id % 50), 6) END AS cost_per_product
FROM events GROUP BY user_id
""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = table(spark, sf_dir, "events").select("user_id", F.col("value").alias("duration"), (F.col("value") * 0.5).alias("cost"), F.lit(1).cast("long").alias("calls"), (F.col("event_id") % 50).alias("products"))
    return usage.run_totals(stages, "user_id")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p, count(*) AS total FROM orders GROUP BY o_orderpriority")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.status_counts(table(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus")), ["O", "F", "P"], ["o_orderpriority"])


@query("SELECT count(*) AS looks, count(DISTINCT year(o_orderdate)) AS seasons, count(DISTINCT o_orderpriority) AS collections, count(DISTINCT o_custkey) AS designers FROM orders")
def favourite_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return usage.favourite_stats(o.select(F.year("o_orderdate").alias("season"), F.col("o_orderpriority").alias("collection"), F.col("o_custkey").alias("designer")))


@query("SELECT source, count(*) AS files, round(sum(n_chars) / 1048576, 2) AS mb FROM documents GROUP BY source")
def storage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.storage_stats(table(spark, sf_dir, "documents").withColumn("bytes", F.col("n_chars")), "source")


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(event_id))::INT AS rank FROM events GROUP BY event_type")
def lineage_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.frequencies(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("""
SELECT event_id, count(*) OVER w AS seen, (sum((event_type = 'error')::INT) OVER w)::BIGINT AS failed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)
""")
def last_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("failed_flag", F.col("event_type") == "error")
    return usage.last_outcomes(rows, "user_id", ["ts", "event_id"]).select("event_id", "seen", "failed")


@query("SELECT event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM events")
def usage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.usage_deltas(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", "event_id").select("event_id", "delta")


@query("""
WITH l AS (SELECT l_returnflag AS category, l_partkey AS url, max(l_linestatus = 'O') AS ok FROM lineitem GROUP BY 1, 2)
SELECT category, count(*) AS queued, count(*) FILTER (ok) AS downloaded, count(*) FILTER (NOT ok) AS failed, grouping(category)::INT AS overall FROM l GROUP BY ROLLUP (category)
""")
def download_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.download_counters(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_partkey").alias("url"), (F.col("l_linestatus") == "O").alias("ok")))


@query("SELECT l_suppkey AS category, arg_min(l_partkey, l_orderkey * 8 + l_linenumber) AS pattern FROM lineitem WHERE l_quantity > 40 GROUP BY l_suppkey")
def first_working_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("category"), F.col("l_partkey").alias("pattern"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), (F.col("l_quantity") > 40).cast("int").alias("found"))
    return usage.first_working_pattern(rows)


@query("SELECT user_id AS site, coalesce(min(CASE WHEN event_type = 'view' AND value > 60 THEN event_id % 7 * 300 END), 5000) AS wait_ms FROM events GROUP BY user_id")
def adaptive_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("site"), (F.col("event_id") % 7 * 300).alias("wait_ms"), (F.col("event_type") == "view").alias("has_name"), (F.col("value") > 60).alias("has_price"))
    return usage.least_wait(rows)


@query("""
SELECT listing, page_no, found FROM (SELECT *, coalesce(sum(ends) OVER (PARTITION BY listing ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT *, (sum((found = 0)::INT) OVER (PARTITION BY listing ORDER BY page_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3)::INT AS ends FROM (SELECT user_id AS listing, event_id AS page_no, CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END AS found FROM events))
) WHERE before = 0
""")
def pages_until_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("listing"), F.col("event_id").alias("page_no"), F.when(F.col("event_type").isin("view", "click"), 1).otherwise(0).alias("found"))
    return usage.pages_until_empty(rows)


@query("""
SELECT k.brand, round(100 * d / n::DOUBLE, 2) AS percent, round(d / (n * 2.0::DOUBLE), 6) AS rate FROM (SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (p_size > 20) AS d FROM part GROUP BY p_brand) k
""")
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 20).alias("d"))
    p = usage.progress(F.col("d"), F.col("n"), F.col("n") * 2.0)
    return by.select("brand", p["percent"].alias("percent"), p["rate"].alias("rate"))


# Joins: customers are users, orders their sessions or follows


@query("""
SELECT o_orderkey AS session_id, c_custkey AS user_id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate + INTERVAL 7 DAY >= TIMESTAMP '2000-06-01' AND c_acctbal > 0
""")
def session_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("is_active"))
    return joins.user_of_session(sessions, users, "2000-06-01 00:00:00").select("session_id", "user_id", "name")


@query("SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphaned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path")), table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("path")))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 3) AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 30)")
def site_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    first = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    one = joins.in_both(first, line.where("l_suppkey = 3").select(F.col("l_partkey").alias("id")), "id")
    return joins.in_both(one, line.where("l_quantity > 30").select(F.col("l_partkey").alias("id")), "id")


@query("""
SELECT o_orderkey AS follow_id, 'brand_' || (o_orderkey % 30) AS brand_id, b.kinds, coalesce(b.products, 0) AS products FROM orders
LEFT JOIN (SELECT lower(replace(p_brand, '#', '_')) AS brand_id, count(DISTINCT p_type) AS kinds, count(*) AS products FROM part GROUP BY 1) b ON b.brand_id = 'brand_' || (o_orderkey % 30)
""")
def followed_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    follows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("follow_id"), F.concat(F.lit("brand_"), (F.col("o_orderkey") % 30).cast("string")).alias("brand_id"))
    p = products(spark, sf_dir)
    return joins.with_followed(follows, p.groupBy("brand_id").agg(F.count_distinct("kind").alias("kinds")), catalogue.counts_of(p, "brand_id"))


_LINES = "(SELECT user_id AS doc_id, event_id AS line_no, CAST(floor(value) AS INT) AS indent, CASE event_type WHEN 'view' THEN 'link' WHEN 'error' THEN 'heading' WHEN 'click' THEN 'button' ELSE 'text' END AS kind, event_type || event_id AS text FROM events)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    kinds = F.when(kind == "view", "link").when(kind == "error", "heading").when(kind == "click", "button").otherwise("text")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("line_no"), F.floor("value").cast("int").alias("indent"), kinds.alias("kind"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))


@query(f"SELECT a.doc_id, a.line_no, max(b.line_no) AS parent_line FROM {_LINES} a LEFT JOIN {_LINES} b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.indent < a.indent GROUP BY a.doc_id, a.line_no")
def nearest_parent_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_above(_lines(spark, sf_dir)).select("doc_id", "line_no", "parent_line")


@query(f"SELECT a.doc_id, a.line_no, max(b.line_no) AS link_line FROM {_LINES} a LEFT JOIN {_LINES} b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.indent <= a.indent AND b.kind = 'link' WHERE a.kind = 'button' GROUP BY a.doc_id, a.line_no")
def nearby_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearby_links(_lines(spark, sf_dir)).where("kind = 'button'").select("doc_id", "line_no", "link_line")


@query(f"""
SELECT a.doc_id, a.line_no, CASE WHEN h.line_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_LINES} c WHERE c.doc_id = a.doc_id AND c.line_no > h.line_no AND c.line_no <= a.line_no AND c.indent <= h.indent) THEN h.text END AS heading
FROM (SELECT *, last_value(CASE WHEN kind IN ('heading', 'button') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS under FROM {_LINES}) a LEFT JOIN {_LINES} h ON h.doc_id = a.doc_id AND h.line_no = a.under WHERE a.kind = 'link'
""")
def links_under_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.carried_headings(_lines(spark, sf_dir)).select("doc_id", "line_no", "heading")


@query(f"SELECT a.doc_id, a.line_no AS at, b.line_no AS other_at FROM {_LINES} a JOIN {_LINES} b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 100 AND a.line_no + 200 WHERE a.kind = 'heading' AND b.kind = 'button'")
def proximity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    side = lambda kind: rows.where(F.col("kind") == kind).select("doc_id", F.col("line_no").alias("at"))
    return joins.near_offsets(side("heading"), side("button"))


@query("""
WITH l AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS a FROM documents),
b AS (SELECT doc_id, list_distinct(list_filter(list_transform(string_split(replace(text, '.' || chr(10), '!' || chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS b FROM documents),
n AS (SELECT doc_id, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added FROM l JOIN b USING (doc_id))
SELECT doc_id, removed::INT AS removed, added::INT AS added, removed >= 3 AND added >= 3 AS replaced FROM n
""")
def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.line_changes(docs, docs.withColumn("text", F.replace("text", F.lit(".\n"), F.lit("!\n"))))


@query("""
SELECT event_id, row_number() OVER (ORDER BY again, event_id)::INT AS position FROM (SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1)::INT AS again FROM events) ORDER BY again, event_id LIMIT 50
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("lineage"))
    return joins.stratified(rows).select(F.col("pos").alias("event_id"), "position")


# Look files: parts are files in a folder per brand


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    designer = F.element_at(F.array(F.lit("acme-atelier"), F.lit("nord-house"), F.lit("vale-studio")), (F.col("p_size") % 3 + 1).cast("int"))
    season = F.element_at(F.array(F.lit("spring"), F.lit("fall"), F.lit("resort")), (k % 3 + 1).cast("int"))
    name = F.concat(designer, F.lit("-"), season, F.lit("-"), (2018 + k % 4).cast("string"), F.lit("-"), k.cast("string"), F.lit(".jpg"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), k.alias("pos"), name.alias("filename"))


_FILES = """(SELECT p_brand AS folder, p_partkey AS pos, (['acme atelier', 'nord house', 'vale studio'])[p_size % 3 + 1] AS designer, (['spring-summer', 'fall-winter', 'resort'])[p_partkey % 3 + 1] AS season, (2018 + p_partkey % 4)::INT AS year,
  (['acme-atelier', 'nord-house', 'vale-studio'])[p_size % 3 + 1] || '-' || (['spring', 'fall', 'resort'])[p_partkey % 3 + 1] || '-' || (2018 + p_partkey % 4) || '-' || p_partkey || '.jpg' AS filename FROM part)"""


@query(f"SELECT pos, designer, season, year, pos::INT AS look_number FROM {_FILES}")
def look_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.described(_files(spark, sf_dir)).select("pos", "designer", "season", "year", "look_number")


@query(f"""
WITH f AS {_FILES}, d AS (SELECT folder, designer AS v, count(*) AS n, min(pos) AS p FROM f GROUP BY 1, 2), s AS (SELECT folder, season AS v, count(*) AS n, min(pos) AS p FROM f GROUP BY 1, 2), y AS (SELECT folder, year AS v, count(*) AS n, min(pos) AS p FROM f GROUP BY 1, 2),
t AS (SELECT folder, count(*) AS files FROM f GROUP BY folder HAVING count(*) >= 5)
SELECT t.folder, files, (SELECT v FROM d WHERE d.folder = t.folder ORDER BY n DESC, p LIMIT 1) AS designer, (SELECT v FROM s WHERE s.folder = t.folder ORDER BY n DESC, p LIMIT 1) AS season, (SELECT v FROM y WHERE y.folder = t.folder ORDER BY n DESC, p LIMIT 1) AS year,
  round(0.6 * (SELECT max(n) FROM d WHERE d.folder = t.folder) / files + 0.3 * (SELECT max(n) FROM s WHERE s.folder = t.folder) / files + 0.1 * (SELECT max(n) FROM y WHERE y.folder = t.folder) / files, 6) AS confidence FROM t
""")
def collection_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.consistency(looks.described(_files(spark, sf_dir)))


@query(f"""
WITH f AS (SELECT *, regexp_extract(filename, '^(.*)-\\d+\\.[a-zA-Z]+$', 1) AS stem FROM {_FILES}), b AS (SELECT folder, stem, row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, min(pos)) AS r FROM f GROUP BY folder, stem)
SELECT folder, filename, row_number() OVER (PARTITION BY folder ORDER BY pos, filename)::INT AS position FROM f JOIN b USING (folder, stem) WHERE r = 1
""")
def largest_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.largest_pattern(_files(spark, sf_dir)).select("folder", "filename", "position")


@query(f"SELECT folder, count(*) AS files, count(*) FILTER (contains(filename, 'acme-atelier')) AS matches, count(*) FILTER (contains(filename, 'acme-atelier')) >= 5 AND count(*) FILTER (contains(filename, 'acme-atelier')) / count(*) >= 0.6 AS keep FROM {_FILES} GROUP BY folder")
def target_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.matching_collection(_files(spark, sf_dir), "acme-atelier")


@query()
def similarity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.similarity_groups(looks.described(_files(spark, sf_dir))).select("folder", "pos", "group_no")


# Sets


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') EXCEPT SELECT user_id FROM events WHERE event_type = 'error'")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id")
    return of("purchase").subtract(of("error"))


@query("SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = lambda kind: e.where(F.col("event_type") == kind).select("user_id")
    return of("purchase").intersect(of("signup"))


@query("SELECT l_partkey AS id, count(*) AS n FROM (SELECT l_partkey FROM lineitem UNION ALL SELECT p_partkey FROM part) GROUP BY 1")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).unionAll(table(spark, sf_dir, "part").select("p_partkey"))
    return both.groupBy("id").agg(F.count("*").alias("n"))


@query("""
SELECT p_partkey AS product_id, greatest(CASE WHEN contains(lower(p_name), 'ring') THEN 1.0::DOUBLE ELSE 1 - levenshtein('ring', lower(p_name))::DOUBLE / greatest(4, length(p_name), 1) END, CASE WHEN contains(lower(p_type), 'ring') THEN 1.0::DOUBLE ELSE 1 - levenshtein('ring', lower(p_type))::DOUBLE / greatest(4, length(p_type), 1) END) AS score FROM part
""")
def fuzzy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("product_id", text.fuzzy_score(F.lit("Ring"), F.col("name"), F.col("kind")).alias("score"))


