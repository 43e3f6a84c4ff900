"""Queries that write with a sink and read what it wrote, and queries of stores and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import predicates, text, urls
from vitrine.operators import catalogue, joins, merge, records, trees
from vitrine.plans.catalogue_queries import Query, category_nodes, products, table
from vitrine.shared import shared_path, spread
from vitrine.sources import brand_folders, sinks
from vitrine.sources import catalogue as sources
from vitrine.sources.catalogue import NODES_SQL, PRODUCTS_SQL
from vitrine.streaming import live

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# Files

_FILES = "(SELECT s_suppkey, s_name AS name, s_acctbal AS price, 'kind=' || (s_nationkey % 3) AS classification, CASE WHEN s_suppkey % 2 = 0 THEN 'acme' ELSE 'nord' END AS brand_id FROM supplier)"


def _file() -> Column:
    """A file's name for each row, whatever its key."""
    return F.concat(F.lit("p-"), F.monotonically_increasing_id().cast("string"), F.lit(".json"))


def _product_files(spark: SparkSession, sf_dir: str) -> str:
    """A JSON file of each supplier, in a folder of its brand and classification."""
    path, s = shared_path(spark, "product-files"), F.col("s_suppkey")
    kind = F.coalesce(F.concat(F.lit("/kind="), (F.col("s_nationkey") % 3).cast("string")), F.lit(""))
    folder = F.concat(F.when(s % 2 == 0, "acme").otherwise("nord"), F.lit("/products"), kind)
    body = F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("price"), F.array(F.lit("a.jpg")).alias("images")))
    brand_folders.save_files(table(spark, sf_dir, "supplier").select(folder.alias("brand_id"), _file().alias("file"), body.alias("body")), path)
    return path


@query(f"SELECT name, price, 1 AS images, brand_id, classification FROM {_FILES}")
def product_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sources.read_product_files(spark, _product_files(spark, sf_dir))
    return rows.select("name", "price", F.size("images").alias("images"), "brand_id", "classification")


@query("SELECT 'good' AS said, count(*) AS files FROM supplier UNION ALL SELECT NULL, count(*) FROM nation")
def tolerant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken files give nulls where the read is tolerant."""
    path = shared_path(spark, "broken-files")
    good = table(spark, sf_dir, "supplier").select(F.lit("good").alias("brand_id"), _file().alias("file"), F.lit('{"name": "good"}').alias("body"))
    broken = table(spark, sf_dir, "nation").select(F.lit("broken").alias("brand_id"), _file().alias("file"), F.lit('{"name": "bad').alias("body"))
    brand_folders.save_files(good.unionByName(broken), path)
    rows = sources.read_documents(spark, path)
    return rows.groupBy(F.try_variant_get("body", "$.name", "string").alias("said")).agg(F.count("*").alias("files"))


@query("SELECT r_name AS name, count(n_nationkey) AS children, min(n_name) AS first FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def navigation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of each region is written as one JSON document and read as VARIANT."""
    path = shared_path(spark, "navigation")
    nations = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"))))
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(nations.alias("children"))
    rows.select(F.to_json(F.struct(F.col("r_name").alias("name"), "children")).alias("value")).repartition(5).write.option("maxRecordsPerFile", 1).text(path)
    body, children = F.col("body"), F.try_variant_get("body", "$.children", "array<struct<name:string>>")
    docs = sources.read_documents(spark, path, "part-*").select(F.try_variant_get(body, "$.name", "string").alias("name"), children.alias("c"))
    return docs.select("name", F.size("c").cast("long").alias("children"), F.col("c")[0]["name"].alias("first"))


@query(f"SELECT product_id, regexp_replace(split_part(url, '?', 1), '/+$', '') || '.json' AS source FROM {PRODUCTS_SQL}")
def product_json_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("product_id", sources.product_json_url(F.col("url")).alias("source"))


# Sinks


@query("SELECT l_partkey AS id, 'products/k' || (l_partkey % 3) || '/p-' || l_partkey || '.json' AS path, arg_max(l_extendedprice, l_orderkey * 8 + l_linenumber) AS price FROM lineitem GROUP BY l_partkey")
def upserted_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the lines is the table, the second a merge into it; a version is written and read."""
    k = F.col("l_partkey")
    u = F.concat(F.lit("https://x.com/p-"), k.cast("string"), F.lit("/?a=1"))
    rows = table(spark, sf_dir, "lineitem").select(k.alias("id"), sinks.product_path(F.concat(F.lit("k"), (k % 3).cast("string")), u, F.lit("x")).alias("path"), F.col("l_extendedprice").alias("price"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"))
    old, new = rows.where("at % 2 = 0"), rows.where("at % 2 = 1")
    merged = sinks.upserted(sinks.upserted(None, old, ["id", "path"], "at"), new, ["id", "path"], "at")
    version = sinks.replace_table(spark, merged, shared_path(spark, "products"))
    return spark.read.parquet(version).select("id", "path", "price")


@query(f"SELECT node_id, parent_id, name, substr(node_id, 1, 1) AS kind FROM {NODES_SQL}")
def navigation_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = category_nodes(spark, sf_dir).withColumn("kind", F.left("node_id", F.lit(1)))
    path = shared_path(spark, "nav")
    sinks.replace_table(spark, rows.limit(1), path)
    version = sinks.replace_table(spark, rows, path, ["kind"])
    return spark.read.parquet(version).select("node_id", "parent_id", "name", "kind")


@query("SELECT url, count(*) AS n FROM pages GROUP BY url")
def url_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "urls")
    sinks.write_lines(table(spark, sf_dir, "pages"), "url", path)
    return spark.read.text(path).groupBy(F.col("value").alias("url")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS brand, event_type AS stage, sum(CASE WHEN event_type = 'click' THEN 1000 ELSE 1 END)::BIGINT AS calls FROM events GROUP BY 1, 2")
def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("brand"), F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"))
    again = rows.where("stage = 'click'").select("brand", (F.col("calls") * 1000).alias("calls"))
    return sinks.with_stage(rows, "click", again)


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS season, o_orderpriority AS look FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT DISTINCT o_custkey AS season, o_orderpriority AS look FROM orders WHERE o_orderkey % 2 = 1)
SELECT season, look, (season, look) NOT IN (SELECT (season, look) FROM o) AS inserted, season % 3 = 0 AS deleted FROM n
""")
def favourite_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the insertion is written, and deleted from as it is read."""
    rows = spread(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("season"), F.col("o_orderpriority").alias("look"), (F.col("o_orderkey") % 2).alias("new")), "season", "look")
    old, new = rows.where("new = 0").select("season", "look").distinct(), rows.where("new = 1").select("season", "look")
    after, outcome = sinks.insert_unique(old, new, ["season", "look"])
    after = spread(spark.read.parquet(sinks.replace_table(spark, after, shared_path(spark, "favourites"))), "season", "look")
    left = sinks.delete(after, after.where("season % 3 = 0"), ["season", "look"])
    #: What came and isn't left any more was deleted.
    both = outcome.withColumn("kept", F.lit(False)).unionByName(left.withColumn("kept", F.lit(True)), allowMissingColumns=True)
    came = both.groupBy("season", "look").agg(F.max("inserted").alias("inserted"), (~F.bool_or("kept")).alias("deleted"))
    return came.where("inserted IS NOT NULL").select("season", "look", "inserted", "deleted")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'noted' ELSE c_name END AS note, c_acctbal AS balance FROM customer")
def preference_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("note"), F.col("c_acctbal").alias("balance"))
    changes = rows.where("id % 2 = 0").select("id", F.lit("noted").alias("note"), F.lit(None).cast("double").alias("balance"))
    return sinks.updated(rows, changes, "id")


@query("SELECT 'user_' || lpad((max(c_custkey % 900) + 1)::VARCHAR, 3, '0') AS next_folder FROM customer")
def next_user_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three digits hold the folders of 999 users, as many as the numbering is made for."""
    users = table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), F.lpad((F.col("c_custkey") % 900).cast("string"), 3, "0")).alias("user_folder"))
    return sinks.next_folder(users)


@query("""
SELECT 'users' AS store, count(*) AS rows, count(*) FILTER (c_acctbal > 0 AND c_custkey <> 5) AS active FROM customer WHERE c_custkey <> 7
UNION ALL SELECT 'sessions', count(*), count(*) FILTER (o_custkey <> 5) FROM orders WHERE o_custkey <> 7
""")
def user_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is deleted with all sessions, another is deactivated and loses them."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active"))
    sessions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    left = sinks.without_user({"users": users, "sessions": sessions}, 7)
    after, live_sessions = sinks.deactivated(left["users"], left["sessions"], 5)
    counts = left["sessions"].agg(F.lit("sessions").alias("store"), F.count("*").alias("rows")).crossJoin(live_sessions.agg(F.count("*").alias("active")))
    return after.agg(F.lit("users").alias("store"), F.count("*").alias("rows"), F.count_if("is_active").alias("active")).unionByName(counts)


@query(f"SELECT product_id::VARCHAR AS product_id, name, name || ';' || kind AS tags FROM {PRODUCTS_SQL}")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    sinks.write_csv(products(spark, sf_dir).select("product_id", "name", F.array("name", "kind").alias("tags")), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def json_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "sets")
    sinks.write_json_with_sets(table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds")), path)
    return spark.read.schema("user_id long, kinds array<string>").json(path).select("user_id", F.array_join("kinds", ";").alias("kinds"))


@query("""
WITH f AS (SELECT unnest(['nav.json', 'nav_readable.txt', 'urls.json', 'urls_readable.txt', 'raw_urls.txt', 'products/a.json', 'config.json', 'brand_meta.json']) AS name),
s AS (SELECT s_suppkey, s_suppkey % 4 AS stage FROM supplier)
SELECT name, count(*) AS n FROM s, f WHERE NOT (stage = 1 AND name IN ('nav.json', 'nav_readable.txt') OR stage = 2 AND name IN ('urls.json', 'urls_readable.txt', 'raw_urls.txt') OR stage = 3 AND (name = 'config.json' OR name LIKE 'products/%')) GROUP BY name
""")
def kept_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["nav.json", "nav_readable.txt", "urls.json", "urls_readable.txt", "raw_urls.txt", "products/a.json", "config.json", "brand_meta.json"]
    files = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("stage"), F.explode(F.array(*[F.lit(x) for x in names])).alias("name"))
    kept = files.where("stage = 0")
    for stage in (1, 2, 3):
        kept = kept.unionByName(sinks.kept_artifacts(files.where(F.col("stage") == stage), [stage]))
    return kept.groupBy("name").agg(F.count("*").alias("n"))


@query(f"SELECT kind AS category, count(*) AS products, row_number() OVER (ORDER BY count(*) DESC, kind)::INT AS rank FROM {PRODUCTS_SQL} GROUP BY kind")
def combined_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = products(spark, sf_dir).groupBy(F.col("kind").alias("category"), "brand_id").agg(F.count("*").alias("products"))
    return sinks.combined_log(logs).select("category", "products", "rank")


@query(f"""
SELECT 'brands' AS name, count(DISTINCT brand_id) AS rows FROM {PRODUCTS_SQL} UNION ALL SELECT 'navigation', count(*) FROM {NODES_SQL} UNION ALL SELECT 'products', count(*) FROM {PRODUCTS_SQL}
UNION ALL SELECT 'patterns', count(DISTINCT event_type) FROM events UNION ALL SELECT 'runs', 1
""")
def normalized_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables of a run are written and counted."""
    usage = table(spark, sf_dir, "events").select("event_type").distinct()
    run = table(spark, sf_dir, "events").agg(F.count("*").alias("calls"))
    out = sinks.normalized_results(products(spark, sf_dir).withColumn("updated_at", F.lit(1)), category_nodes(spark, sf_dir), usage, run)
    counts = [spark.read.parquet(sinks.replace_table(spark, rows, shared_path(spark, name))).agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name, rows in out.items()]
    first, *rest = counts
    for c in rest:
        first = first.unionByName(c)
    return first


@query("""SELECT event_id, CASE WHEN event_type <> 'view' THEN 'event: ' || event_type || chr(10) ELSE '' END || 'data: {"event_id":' || event_id || CASE WHEN event_type <> 'view' THEN ',"event_type":"' || event_type || '"' ELSE '' END || '}' || chr(10) || chr(10) AS frame FROM events""")
def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))
    frames = live.event_frames(rows)
    return frames.select(F.regexp_extract("frame", r'"event_id":(\d+)', 1).cast("long").alias("event_id"), "frame")


@query("SELECT 'all' AS listener, count(*) AS events FROM events UNION ALL SELECT 'errors', count(*) FROM events WHERE event_type = 'error'")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream, two listeners, each with a sink of its own."""
    top = shared_path(spark, "listeners")
    errors = live.upsert_by_batch(f"{top}/errors")
    both = live.fan_out(live.upsert_by_batch(f"{top}/all"), lambda rows, batch: errors(rows.where("event_type = 'error'"), batch))
    live.drained(live.stream_table(spark, sf_dir, "events").select("event_id", "event_type"), "fan-out", batch=both)
    read = lambda name: spark.read.option("recursiveFileLookup", True).parquet(f"{top}/{name}").agg(F.lit(name).alias("listener"), F.count("*").alias("events"))
    return read("all").unionByName(read("errors"))


# Served records


@query("SELECT o_orderkey AS id, o_custkey AS season, o_orderpriority AS designer, o_orderkey AS look, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)::INT AS by_season, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INT AS by_collection FROM orders")
def favourite_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites as nested records, and their places in a season and in a collection."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("season_id"), F.col("o_orderpriority").alias("collection_designer"), F.col("o_orderkey").alias("look_number"))
    nested = records.nested_favourites(o)
    placed = records.favourite_places(nested)
    return placed.select("id", F.col("season.id").alias("season"), F.col("collection.designer").alias("designer"), F.col("look.number").alias("look"), "by_season", "by_collection")


@query("SELECT c_custkey AS id, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS known FROM customer")
def existing_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return records.with_existence(asked, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")), ["id"]).select("id", F.col("exists").alias("known"))


@query(f"SELECT product_id, image FROM (SELECT product_id, unnest(['a' || product_id || '.jpg', 'b.jpg']) AS image, url FROM {PRODUCTS_SQL}) WHERE url = 'https://www.brand-2.example.com/collections/economy/products/small-ring-0?variant=11'")
def product_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir).withColumn("images", F.array(F.concat(F.lit("a"), _text("product_id"), F.lit(".jpg")), F.lit("b.jpg")))
    return records.images_of(rows, "https://www.brand-2.example.com/collections/economy/products/small-ring-0?variant=11").select("product_id", "image")


@query("SELECT 'nation-' || n_nationkey || '.com' AS domain, n_nationkey % 2 = 0 AS known, CASE WHEN n_nationkey % 2 = 1 THEN 'Nation ' || n_nationkey END AS name FROM nation")
def new_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = F.concat(F.lit("nation-"), _text("n_nationkey"), F.lit(".com"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", domain.alias("domain"))
    known = n.where("n_nationkey % 2 = 0").select(F.replace("domain", F.lit("."), F.lit("_")).alias("brand_id"))
    return records.new_brands(known, n.select("domain")).select("domain", F.col("exists").alias("known"), "name")


@query(f"SELECT node_id, coalesce(listed, 0) AS listed FROM {NODES_SQL} LEFT JOIN (SELECT 'https://shop.example.com/collections/s/' || l_suppkey AS url, count(*) AS listed FROM lineitem GROUP BY 1) USING (url)")
def category_url_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("https://shop.example.com/collections/s/"), _text("l_suppkey")).alias("url"), F.col("l_partkey").alias("product_url"))
    return trees.with_url_counts(category_nodes(spark, sf_dir), listed).select("node_id", "listed")


@query("SELECT n_name AS category, n_regionkey AS url, products FROM nation JOIN (SELECT r_regionkey, length(r_name)::BIGINT AS products FROM region) ON r_regionkey = n_regionkey")
def shared_url_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    categories = table(spark, sf_dir, "nation").select(F.col("n_name").alias("category"), F.col("n_regionkey").alias("url"))
    work = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("url"), F.length("r_name").cast("long").alias("products"))
    return joins.fanned_out(categories, work).select("category", "url", "products")


@query("""
WITH l AS (SELECT CASE WHEN s_suppkey % 3 > 0 THEN s_nationkey END AS n, s_name AS name, 'https://x.com/s/' || s_suppkey AS url FROM supplier UNION ALL SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END, lower(n_name), 'https://x.com/n/' || n_nationkey FROM nation),
c AS (SELECT n_nationkey AS n, n_regionkey AS r, n_name, (SELECT count(*) FROM l WHERE l.n = n_nationkey) AS of_nation FROM nation), g AS (SELECT *, sum(of_nation) OVER (PARTITION BY r) AS of_region FROM c)
SELECT CASE WHEN of_nation > 1 THEN 'n' || g.n WHEN of_region > 1 THEN 'r' || r END AS parent_id, name, url, true AS is_link FROM l JOIN g USING (n)
UNION ALL SELECT 'r' || r, n_name, CASE WHEN n % 3 = 0 THEN 'https://x.com/n/' || n END, false FROM g WHERE of_nation > 1
UNION ALL SELECT DISTINCT NULL, r_name, NULL, false FROM g JOIN region ON r_regionkey = r WHERE of_region > 1
UNION ALL SELECT NULL, name, url, true FROM l WHERE n IS NULL
""")
def standard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda kind, key: F.concat(F.lit(kind), _text(key))
    regions = table(spark, sf_dir, "region").select(named("r", "r_regionkey").alias("node_id"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(named("n", "n_nationkey").alias("node_id"), named("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    root = spark.range(1).select(F.lit("root").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("root").alias("name"))
    #: Links of every third supplier, and of two nations in three, are under no node, so they stand at the top.
    of_suppliers = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 3 > 0, named("n", "s_nationkey")).alias("node_id"), F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"), named("https://x.com/s/", "s_suppkey").alias("url"))
    own = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 3 == 0, named("n", "n_nationkey")).alias("node_id"), F.lit(0).cast("long").alias("pos"), F.lower("n_name").alias("name"), named("https://x.com/n/", "n_nationkey").alias("url"))
    return trees.standard_tree(root.unionByName(regions).unionByName(nations), of_suppliers.unionByName(own))


@query(f"SELECT node_id FROM {NODES_SQL} n WHERE NOT (node_id IN ('n3', 'n4') OR coalesce(parent_id, '') IN ('n3', 'n4'))")
def without_homepages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two nations lead to the homepage, so they go with their suppliers."""
    nodes = category_nodes(spark, sf_dir).withColumn("url", F.when(F.col("node_id").isin("n3", "n4"), "https://shop.example.com/").otherwise(F.col("url")))
    return trees.without_homepages(nodes, "https://shop.example.com/").select("node_id")


@query(f"SELECT name, url FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank DESC) AS r FROM (SELECT name, url, CASE WHEN node_id LIKE 'n%' THEN ordinal ELSE 0 END AS rank, node_id FROM {NODES_SQL} WHERE url IS NOT NULL AND name <> 'View All')) WHERE r = 1")
def named_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.url_map(category_nodes(spark, sf_dir)).where("name != 'View All'").select("name", "url")


@query("SELECT o_orderkey AS session_id, o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderstatus <> 'F' AS valid, o_orderdate IS NULL OR o_orderdate > TIMESTAMP '1998-01-01' AS stale FROM orders")
def session_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, expires = F.lit("1998-01-01").cast("timestamp"), F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), predicates.is_valid_session(now, expires, F.col("o_orderstatus") != "F").alias("valid"), catalogue.is_stale(now, expires).alias("stale"))


@query(f"SELECT product_id, CASE WHEN product_id % 3 = 0 THEN 'ld_json' ELSE 'shopify' END AS active, CASE WHEN product_id % 2 = 0 THEN 'new' ELSE 'old' END AS price_pattern, 'old' AS name_pattern FROM {PRODUCTS_SQL}")
def learned_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("product_id")
    as_map = lambda c: F.create_map(F.lit("price"), F.lit(c))
    sources_, none = as_map("ld_json"), F.create_map().cast("map<string,string>")
    contributions = F.array(F.struct(F.lit("shopify").alias("strategy"), F.array(F.lit("name")).alias("fields")), F.struct(F.lit("html_meta").alias("strategy"), F.array().cast("array<string>").alias("fields")))
    old, new = F.create_map(F.lit("price"), F.lit("old"), F.lit("name"), F.lit("old")), F.when(k % 2 == 0, as_map("new")).otherwise(none)
    rows = products(spark, sf_dir).select("product_id", F.when(k % 3 == 0, sources_).otherwise(none).alias("sources"), contributions.alias("contributions"), old.alias("old"), new.alias("new"))
    merged = merge.merged_patterns(F.col("old"), F.col("new"))
    return rows.select("product_id", F.array_join(merge.active_strategies(F.col("sources"), F.col("contributions")), ";").alias("active"), F.try_element_at(merged, F.lit("price")).alias("price_pattern"), F.try_element_at(merged, F.lit("name")).alias("name_pattern"))


@query(f"SELECT product_id, name || ' & more it''s' AS description, CASE product_id % 2 WHEN 0 THEN 'Khaite' END AS brand, CASE WHEN product_id % 3 = 0 THEN NULL ELSE 'Silk Dress' END AS named, CASE WHEN product_id % 5 > 3 THEN 'high' ELSE 'low' END AS scrapable FROM {PRODUCTS_SQL}")
def described_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("product_id")
    raw = F.concat(F.lit("<p>"), F.col("name"), F.lit(" &amp;amp;\\n more​ <br>it\\u0027s</p> "))
    host = F.when(k % 2 == 0, "https://www.khaite.com/a").otherwise("https://www.example.com/a")
    slug = F.when(k % 3 == 0, "https://x.com/p/0a1b2c?x=1").otherwise(F.concat(F.lit("https://x.com/p/silk_dress-"), (k + 10_000).cast("string"), F.lit(".html?x=1")))
    links = F.array_repeat(F.lit("https://x.com/product/1"), (k % 5).cast("int"))
    return products(spark, sf_dir).select("product_id", text.clean_description(raw).alias("description"), urls.brand_of_host(host).alias("brand"), urls.product_name(slug).alias("named"), predicates.scrapability(links)[0].alias("scrapable"))
