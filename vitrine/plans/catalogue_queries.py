"""Queries of the catalogue's own operators over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions import predicates, text, urls
from vitrine.operators import catalogue, dedupe, trees
from vitrine.sources.catalogue import BRIDGE_SQL, NODES_SQL, PRODUCTS_SQL, VARIANTS_SQL, category_nodes, category_products, products, table, variants

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# URLs

_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_HOST = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
_SCHEME = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)"
_CANONICAL = "regexp_replace(regexp_replace(split_part(url, '?', 1), '/+$', ''), '/collections/[^/]+/products/', '/products/', 'g')"


@query(f"SELECT product_id, {_CANONICAL} AS canonical FROM {PRODUCTS_SQL}")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("product_id", urls.canonical(F.col("url")).alias("canonical"))


@query(rf"""
SELECT page_id, replace({_HOST}, 'www.', '') AS domain, regexp_replace({_HOST}, '^www\.', '') AS host_tail,
  'https://' || replace({_HOST}, 'www.', '') || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END AS normalized
FROM (SELECT *, regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS rest FROM pages)
""")
def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.domain(u).alias("domain"), urls.domain_without_prefix(u).alias("host_tail"), urls.normalized(u).alias("normalized"))


@query(rf"""
SELECT page_id, {_SCHEME} AS scheme, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query,
  list_extract(string_split(regexp_replace({_PATH}, '/+$', ''), '/'), -1) AS last_segment,
  CAST(coalesce(nullif(regexp_extract(url, '[?&](?:page|p|pg)=(\d+)', 1), ''), nullif(regexp_extract(url, '/page/(\d+)', 1), ''), '1') AS INT) AS page_no FROM pages
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.last_segment(u).alias("last_segment"), urls.page_number(u).alias("page_no"))


@query(rf"""
SELECT product_id, coalesce(nullif(regexp_extract({_PATH}, '.*/(?:products?|p)/([^/]+)', 1), ''), '') AS slug,
  coalesce({", ".join(f"nullif(regexp_extract(url, '{p}', 1), '')" for p in urls.PRODUCT_ID_PATTERNS)}) AS id_in_url FROM {PRODUCTS_SQL}
""")
def product_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("product_id", urls.product_slug(F.col("url")).alias("slug"), urls.product_id(F.col("url")).alias("id_in_url"))


@query("""
SELECT product_id, p AS page_no, 'https://shop.example.com/c/' || lower(kind) || '?page=' || p AS url
FROM (SELECT product_id, kind, unnest(range(2, size_no % 6 + 1)) AS p FROM """ + PRODUCTS_SQL + ")")  # fmt: skip
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = urls.page_urls(F.concat(F.lit("https://shop.example.com/c/"), F.lower("kind")), F.col("size_no") % 6)
    rows = products(spark, sf_dir).select("product_id", F.explode(pages).alias("url"))
    return rows.select("product_id", F.regexp_extract("url", r"page=(\d+)", 1).cast("long").alias("page_no"), "url")


@query(r"""
SELECT product_id, 'cdn.example.com|/files/' || product_id || '.jpg|' || product_id AS identity,
  'https://cdn.example.com/files/' || product_id || '.jpg?v=7' AS whole
FROM """ + PRODUCTS_SQL)  # fmt: skip
def image_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.concat(F.lit("https://CDN.example.com/files/large/"), F.col("product_id").cast("string"), F.lit(".jpg?width=600&v=7"))
    sized = F.concat(F.lit("https://cdn.example.com/files/"), F.col("product_id").cast("string"), F.lit("_140x140.jpg?width=960&v=7"))
    return products(spark, sf_dir).select("product_id", urls.image_identity(image).alias("identity"), urls.without_size(sized).alias("whole"))


@query(rf"""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN {_SCHEME} || '://' || {_HOST} || '/img/a.png' WHEN page_id % 4 = 1 THEN {_SCHEME} || '://cdn.example.com/b.png'
  WHEN page_id % 4 = 2 THEN 'https://other.example.com/c.png' ELSE {_SCHEME} || '://' || {_HOST} || regexp_replace({_PATH}, '[^/]*$', '') || 'd.png?x=1&y=2' END AS url FROM pages
""")
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    link = F.when(k == 0, "/img/a.png").when(k == 1, "//cdn.example.com/b.png").when(k == 2, "https://other.example.com/c.png").otherwise("d.png?x=1&amp;y=2")
    return table(spark, sf_dir, "pages").select("page_id", urls.absolute(link, F.col("url")).alias("url"))


# Queries of products


@query(f"SELECT product_id, name, price FROM {PRODUCTS_SQL} WHERE brand_id = 'brand_7' AND price BETWEEN 905 AND 960 AND lower(name) LIKE '%ring%'")
def product_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of a brand's products: price range and text."""
    rows = catalogue.filtered(products(spark, sf_dir), brand="brand_7", least=905, most=960)
    return catalogue.search(rows, "RING", "name").select("product_id", "name", "price")


@query(f"SELECT product_id, brand_id, name FROM {PRODUCTS_SQL} WHERE lower(name || ' ' || kind) LIKE '%red%' AND lower(name || ' ' || kind) LIKE '%promo%'")
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.full_text(products(spark, sf_dir), "promo red", "name", "kind").select("product_id", "brand_id", "name")


@query(f"SELECT product_id, name FROM {PRODUCTS_SQL} WHERE lower(name) LIKE '%widg%'")
def trigram_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir)
    return catalogue.search_by_trigrams(catalogue.trigrams(rows), rows, "widg").select("product_id", "name")


@query(f"""
SELECT product_id, name FROM {PRODUCTS_SQL} WHERE product_id IN (SELECT product_id FROM {VARIANTS_SQL} WHERE color = 'red') AND product_id IN (SELECT product_id FROM {VARIANTS_SQL} WHERE size = 'M') AND kind = 'PROMO'
""")
def variant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.filtered(products(spark, sf_dir), classification="PROMO", variants=variants(spark, sf_dir), color="Red", size="m")
    return rows.select("product_id", "name")


@query(f"""
SELECT product_id, price, row_number() OVER (ORDER BY price DESC, product_id) AS position, count(*) OVER () AS total, 70 < count(*) OVER () AS has_more
FROM {PRODUCTS_SQL} WHERE brand_id = 'brand_3' ORDER BY position LIMIT 20 OFFSET 50
""")
def product_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.filtered(products(spark, sf_dir), brand="brand_3")
    out = catalogue.page(rows, catalogue.sort_key("price_desc"), offset=50, limit=20)
    return out.select("product_id", "price", F.col("position").cast("long").alias("position"), "total", "has_more")


@query(f"SELECT brand_id, count(*) AS products, row_number() OVER (ORDER BY lower(brand_id)) AS position FROM {PRODUCTS_SQL} GROUP BY brand_id")
def brand_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue.counts_of(products(spark, sf_dir), "brand_id")
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.lower("brand_id"))).cast("long"))


@query(f"""
SELECT 'brand' AS facet, brand_id AS value, count(DISTINCT product_id) AS products FROM {PRODUCTS_SQL} GROUP BY brand_id
UNION ALL SELECT 'category', kind, count(DISTINCT product_id) FROM {PRODUCTS_SQL} GROUP BY kind
UNION ALL SELECT 'color', color, count(DISTINCT product_id) FROM {VARIANTS_SQL} WHERE color IS NOT NULL GROUP BY color
UNION ALL SELECT 'size', size, count(DISTINCT product_id) FROM {VARIANTS_SQL} WHERE size IS NOT NULL GROUP BY size
""")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.facets(products(spark, sf_dir), variants(spark, sf_dir))


@query(f"SELECT min(price) AS least, max(price) AS most, count(DISTINCT brand_id) AS brands FROM {PRODUCTS_SQL}")
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.price_range(products(spark, sf_dir))


@query(f"""
SELECT kind, count(*) AS products, string_agg(name, ';' ORDER BY product_id) FILTER (r <= 3) AS samples
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY product_id) AS r FROM {PRODUCTS_SQL}) GROUP BY kind
""")
def groups_with_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.groups_with_samples(products(spark, sf_dir), "kind")


@query(f"SELECT product_id FROM {PRODUCTS_SQL} WHERE {_CANONICAL} IN (SELECT {_CANONICAL} FROM {PRODUCTS_SQL} WHERE product_id % 40 = 0)")
def category_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir)
    return catalogue.in_category(rows, rows.where("product_id % 40 = 0").select("url"), "url").select("product_id")


@query(f"""
SELECT node_id, count(*) AS products FROM {BRIDGE_SQL} b JOIN {PRODUCTS_SQL} p USING (product_id) WHERE p.kind <> 'SMALL' GROUP BY node_id
""")
def extracted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each category whose product was extracted."""
    rows = products(spark, sf_dir).withColumn("url", F.concat(F.lit("https://e.example.com/products/"), F.col("product_id").cast("string")))
    listed = category_products(spark, sf_dir).withColumn("url", F.concat(F.lit("https://e.example.com/products/"), F.col("product_id").cast("string"), F.lit("?from=list")))
    return catalogue.extracted_counts(listed, rows.where("kind <> 'SMALL'"))


@query("SELECT 'brand_12' AS exact, 'brand_12' AS loose, 'nowhere' AS unknown")
def brand_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = products(spark, sf_dir).select("brand_id").distinct()
    one = lambda wanted, name: catalogue.resolve_brand(brands, wanted).select(F.col("brand_id").alias(name))
    return one("brand_12", "exact").crossJoin(one("Brand-12_com", "loose")).crossJoin(one("nowhere", "unknown"))


@query(f"SELECT product_id, brand_id, name, price FROM {PRODUCTS_SQL} WHERE url = 'https://www.brand-2.example.com/collections/economy/products/small-ring-0?variant=11'")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).where(F.col("url") == "https://www.brand-2.example.com/collections/economy/products/small-ring-0?variant=11").select("product_id", "brand_id", "name", "price")


# De-duplication

_FILES = f"(SELECT product_id, url, kind || '/' || product_id AS file_path, size_no AS modified_at FROM {PRODUCTS_SQL})"


@query(f"SELECT product_id, file_path FROM (SELECT *, row_number() OVER (PARTITION BY {_CANONICAL} ORDER BY modified_at DESC, file_path) AS r FROM {_FILES}) WHERE r = 1")
def latest_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = products(spark, sf_dir).select("product_id", "url", F.concat_ws("/", "kind", F.col("product_id").cast("string")).alias("file_path"), F.col("size_no").alias("modified_at"))
    return dedupe.latest_per_url(files).select("product_id", "file_path")


@query(f"""
SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY {_SCHEME}, {_HOST}, {_PATH} ORDER BY {_QUERY} <> '', length(url), page_id) AS r FROM pages) WHERE r = 1
""")
def best_url_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.best_per_path(table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), "url")).select(F.col("pos").alias("page_id"), "url")


@query(f"SELECT raw, deduped, raw - deduped AS removed, (raw - deduped) > 0.7 * raw AS warning FROM (SELECT count(*) AS raw, count(DISTINCT {_SCHEME} || '|' || {_HOST} || '|' || {_PATH}) AS deduped FROM pages)")
def url_dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.url_summary(table(spark, sf_dir, "pages"))


_LISTS = f"(SELECT product_id % 3 AS list_no, product_id AS pos, {_CANONICAL} AS url, brand_id AS brand, name FROM {PRODUCTS_SQL})"


@query(f"""
SELECT list_no, pos, url FROM (
  SELECT *, min(list_no) OVER (PARTITION BY brand, name) AS first_list FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY list_no, pos) AS r FROM {_LISTS}) WHERE r = 1
) WHERE list_no = first_list
""")
def cross_list_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir).select((F.col("product_id") % 3).alias("list_no"), F.col("product_id").alias("pos"), urls.canonical(F.col("url")).alias("url"), F.col("brand_id").alias("brand"), "name")
    return dedupe.across_lists(rows).select("list_no", "pos", "url")


@query("""
WITH f AS (SELECT l_partkey AS url, 'c' || (l_suppkey % 9) AS category_url, min(l_orderkey * 8 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2)
SELECT url, string_agg(category_url, ';' ORDER BY pos, category_url) AS categories FROM f GROUP BY url
""")
def products_over_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("url"), F.lit("").alias("name"), F.concat(F.lit("c"), (F.col("l_suppkey") % 9).cast("string")).alias("category_url"))
    return dedupe.merged_over_categories(rows).select("url", "categories")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.latest_job(table(spark, sf_dir, "events").withColumnRenamed("event_id", "job_id"), "user_id", "ts").select("user_id", F.col("job_id").alias("event_id"), "event_type")


@query("""
SELECT user_id, run_no, count(*) AS events, min(event_type) AS event_type FROM (
  SELECT *, sum(CASE WHEN event_type IS DISTINCT FROM before OR first THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run_no FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS first FROM events)
) GROUP BY user_id, run_no
""")
def adjacent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedupe.runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "run_no").agg(F.count("*").alias("events"), F.min("event_type").alias("event_type"))


# Trees

_TREE = f"""
WITH RECURSIVE nodes AS {NODES_SQL}, t AS (
  SELECT node_id, parent_id, name, url, 0 AS depth, name AS path, lpad(ordinal::VARCHAR, 12, '0') AS sort_path FROM nodes WHERE parent_id IS NULL
  UNION ALL SELECT c.node_id, c.parent_id, c.name, c.url, t.depth + 1, t.path || ' > ' || c.name, t.sort_path || '/' || lpad(c.ordinal::VARCHAR, 12, '0') FROM t JOIN nodes c ON c.parent_id = t.node_id
)"""
_CLOSURE = f"""
WITH RECURSIVE nodes AS {NODES_SQL}, up AS (
  SELECT node_id, node_id AS ancestor_id, parent_id AS nxt, 0 AS distance FROM nodes UNION ALL SELECT up.node_id, p.node_id, p.parent_id, up.distance + 1 FROM up JOIN nodes p ON p.node_id = up.nxt
)"""


@query(_TREE + " SELECT node_id, depth, path, sort_path FROM t")
def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.with_paths(category_nodes(spark, sf_dir)).select("node_id", "depth", "path", "sort_path")


@query(_TREE + " SELECT sort_path, repeat('  ', depth) || name AS line FROM t")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.listing(category_nodes(spark, sf_dir))


@query(_CLOSURE + " SELECT node_id, ancestor_id, distance FROM up")
def tree_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.closure(category_nodes(spark, sf_dir))


@query(f"""
WITH nodes AS {NODES_SQL}, l AS (SELECT *, count(*) OVER (PARTITION BY parent_id) AS at_level FROM nodes WHERE url IS NOT NULL AND node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL))
SELECT node_id, at_level FROM l WHERE NOT (regexp_matches(lower(name), '\\ball\\b') AND at_level >= 3)
""")
def leaf_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.kept_leaves(category_nodes(spark, sf_dir)).select("node_id", "at_level")


@query(f"""
WITH nodes AS {NODES_SQL} SELECT count(*) AS nodes, count(url) AS with_url, count(DISTINCT url) AS distinct_urls,
  (SELECT count(url) FROM nodes WHERE node_id NOT IN (SELECT parent_id FROM nodes WHERE parent_id IS NOT NULL)) AS leaves FROM nodes
""")
def tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.counts(category_nodes(spark, sf_dir))


@query(_CLOSURE + f" SELECT ancestor_id AS node_id, count(DISTINCT product_id) AS products FROM up JOIN {BRIDGE_SQL} b USING (node_id) GROUP BY ancestor_id")
def subtree_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    #: The lines as they are: the operator takes each product of a category once.
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("node_id"), F.col("l_partkey").alias("product_id"))
    return trees.subtree_products(category_nodes(spark, sf_dir), lines)


@query(_CLOSURE + f" SELECT node_id, name FROM nodes WHERE node_id IN (SELECT ancestor_id FROM up WHERE node_id IN (SELECT node_id FROM {BRIDGE_SQL} WHERE node_id LIKE '%1'))")
def pruned_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.pruned(category_nodes(spark, sf_dir), category_products(spark, sf_dir).where("node_id LIKE '%1'")).select("node_id", "name")


_NATIONS_LISTED = "(SELECT 'n' || n_nationkey AS node_id, p_partkey AS product_id, p_partkey AS pos FROM nation, part WHERE n_nationkey % 5 <> 0 AND p_partkey % 25 = n_nationkey)"


@query(f"""
WITH nodes AS {NODES_SQL}, listed AS {_NATIONS_LISTED}, s AS (SELECT *, count(*) OVER (PARTITION BY parent_id) AS siblings FROM nodes),
a AS (SELECT node_id AS all_id, parent_id FROM s WHERE regexp_matches(lower(name), '\\ball\\b') AND siblings >= 3 AND node_id NOT IN (SELECT node_id FROM listed))
SELECT node_id, product_id, pos FROM listed
UNION ALL SELECT all_id, product_id, min(pos) FROM a JOIN nodes n USING (parent_id) JOIN listed l ON l.node_id = n.node_id WHERE NOT regexp_matches(lower(n.name), '\\ball\\b') GROUP BY all_id, product_id
""")
def rolled_into_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0")
    listed = table(spark, sf_dir, "part").join(F.broadcast(nations), F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node_id"), F.col("p_partkey").alias("product_id"), F.col("p_partkey").alias("pos"))
    return trees.rolled_into_all(category_nodes(spark, sf_dir), listed)


@query(f"""
WITH nodes AS {NODES_SQL} SELECT n.node_id, CASE WHEN c.url IS NULL THEN n.url END AS url FROM nodes n LEFT JOIN (SELECT DISTINCT parent_id, url FROM nodes WHERE url IS NOT NULL) c ON c.parent_id = n.node_id AND c.url = n.url
""")
def redundant_parent_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.redundant_urls(category_nodes(spark, sf_dir)).select("node_id", "url")


@query("""
WITH l AS (SELECT l_suppkey % 5 AS parent_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'c' || (l_linenumber % 3) END AS child_id, l_partkey AS url FROM lineitem),
b AS (SELECT parent_id, url, count(DISTINCT child_id) AS children, min(child_id) AS child FROM l GROUP BY parent_id, url)
SELECT parent_id, url, CASE WHEN children = 1 THEN child END AS child_id FROM b
""")
def lifted_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    links = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("parent_id"), F.when(n != 0, F.concat(F.lit("c"), n.cast("string"))).alias("child_id"), F.col("l_partkey").alias("url"))
    return trees.lifted_links(links)


@query("""
WITH r AS (SELECT r_name || ' > ' || n_name AS path, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT split_part(path, ' > ', 1) AS node_id, NULL AS parent_id, min(pos)::INT AS ordinal FROM r GROUP BY 1
UNION ALL SELECT path, split_part(path, ' > ', 1), min(pos)::INT FROM r GROUP BY path
""")
def tree_from_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    paths = rows.select(F.concat_ws(" > ", "r_name", "n_name", "n_name").alias("path"), F.lit(None).cast("string").alias("url"), F.col("n_nationkey").alias("pos"))
    return trees.from_paths(paths).select("node_id", "parent_id", "ordinal")


@query(f"""
WITH l AS (SELECT page_id, {_PATH} AS path FROM pages), k AS (SELECT path, min(page_id) AS page_id FROM l GROUP BY path)
SELECT l.path, max(length(p.path)) AS above FROM (SELECT DISTINCT path FROM l) l LEFT JOIN k p ON starts_with(l.path, p.path || '/') AND p.path <> '/' GROUP BY l.path
""")
def url_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per path, the length of the nearest path above it that has a page; a trailing slash makes a path lie below the one without."""
    paths = table(spark, sf_dir, "pages").select(urls.path(F.col("url")).alias("path")).distinct()
    links = paths.select(F.col("path").alias("url"), "path")
    return trees.url_hierarchy(links).select("path", F.length("parent_url").cast("long").alias("above"))


@query(_TREE + f" SELECT product_id, arg_min(path, sort_path) AS path FROM {BRIDGE_SQL} b JOIN t USING (node_id) GROUP BY product_id")
def first_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.first_category(category_nodes(spark, sf_dir), category_products(spark, sf_dir))


@query(f"""
WITH nodes AS {NODES_SQL} SELECT n.node_id, row_number() OVER (PARTITION BY n.parent_id ORDER BY p.parent_id IS NULL, ordinal, n.node_id)::INT AS position
FROM nodes n LEFT JOIN (SELECT DISTINCT parent_id FROM nodes WHERE parent_id IS NOT NULL) p ON p.parent_id = n.node_id
""")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.ordered_for_display(category_nodes(spark, sf_dir)).select("node_id", "position")


# Text and predicates


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query(rf"""
SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, length(html) <= 5000 AND ({" OR ".join(f"contains(lower(html), '{m}')" for m in predicates.CHALLENGE_MARKS)}) AS challenge FROM pages
""")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.extract(F.col("html"), "(?is)<title[^>]*>(.*?)</title>").alias("title"), predicates.is_challenge(F.col("html")).alias("challenge"))


@query("""
SELECT product_id, TRY_CAST(regexp_replace('$' || price || CASE WHEN product_id % 4 = 0 THEN ' (was 1.2)' ELSE ' USD' END, '[^0-9.]', '', 'g') AS DOUBLE) AS price,
  CASE product_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS available FROM """ + PRODUCTS_SQL)  # fmt: skip
def parsed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("$"), F.col("price").cast("string"), F.when(F.col("product_id") % 4 == 0, " (was 1.2)").otherwise(" USD"))
    k = F.col("product_id") % 3
    stock = F.when(k == 0, "https://schema.org/InStock").when(k == 1, "OutOfStock").otherwise("PreOrder")
    return products(spark, sf_dir).select("product_id", text.price(shown).alias("price"), text.availability(stock).alias("available"))


@query(r"""
SELECT c_custkey, left(trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '-'), 50) AS slug, lpad(c_custkey::VARCHAR, 3, '0') AS folder,
  left(md5(c_name), 8) AS tag, sha256(c_name) AS digest FROM customer
""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.slug(F.col("c_name")).alias("slug"), text.padded_number(F.col("c_custkey")).alias("folder"), text.url_tag(F.col("c_name")).alias("tag"), text.password_hash(F.col("c_name")).alias("digest"))


@query("SELECT product_id, name FROM " + PRODUCTS_SQL)
def undoubled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubled = F.when(F.col("product_id") % 2 == 0, F.concat_ws(" ", "name", "name")).otherwise(F.col("name"))
    return products(spark, sf_dir).select("product_id", text.undoubled(doubled).alias("name"))


@query(r"""
SELECT event_id, 'run_' || strftime(ts, '%Y%m%d_%H%M%S') AS run_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s // 3600 || 'h ' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || 'm' END AS took
FROM (SELECT *, event_id % 9000 AS s FROM events)
""")
def run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.run_id(F.col("ts")).alias("run_id"), text.iso(F.col("ts")).alias("iso"), text.duration(F.col("event_id") % 9000).alias("took"))


@query(r"""
SELECT product_id, s, upper(s) IN ('XXS','XS','S','M','L','XL','XXL','XXXL','OS','ONE SIZE','FREE','UNIQUE') OR regexp_matches(upper(s), '^[0-9]{1,2}(\.[05])?$') OR regexp_matches(upper(s), '^[XSML]{1,4}$') OR regexp_matches(upper(s), '^[A-Z0-9]{1,4}[-/][A-Z0-9]{1,4}$') OR length(s) <= 5 AS valid
FROM (SELECT product_id, CASE product_id % 4 WHEN 0 THEN size_no::VARCHAR WHEN 1 THEN kind WHEN 2 THEN 'one size' ELSE '32-34' END AS s FROM """ + PRODUCTS_SQL + ")")  # fmt: skip
def valid_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("product_id") % 4
    s = F.when(k == 0, F.col("size_no").cast("string")).when(k == 1, F.col("kind")).when(k == 2, "one size").otherwise("32-34")
    return products(spark, sf_dir).select("product_id", s.alias("s"), text.valid_size(s).alias("valid"))


@query("""
SELECT product_id, CASE WHEN kind <> 'PROMO' THEN 15 ELSE 0 END + 15 + 5 + CASE WHEN product_id % 2 = 0 THEN 15 ELSE 0 END + 10 + CASE WHEN v.n > 0 THEN 15 ELSE 0 END + CASE WHEN v.known > 0 THEN 10 ELSE 0 END + 5 + 0 + 5 AS score
FROM """ + PRODUCTS_SQL + " p LEFT JOIN (SELECT product_id, count(*) AS n, count(available) AS known FROM " + VARIANTS_SQL + " GROUP BY product_id) v USING (product_id)")  # fmt: skip
def completeness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).groupBy("product_id").agg(F.count("*").alias("n"), (F.count("available") > 0).alias("known"))
    p = products(spark, sf_dir).join(v, "product_id", "left")
    name = F.when(F.col("kind") != "PROMO", F.col("name"))
    images = F.when(F.col("product_id") % 2 == 0, F.array(F.col("url")))
    some = F.when(F.col("n") > 0, F.array(F.lit(1)))
    score = predicates.completeness_score(name, F.col("price"), F.lit("USD"), images, F.col("kind"), some, F.coalesce("known", F.lit(False)), F.col("brand_id"), F.lit(None).cast("string"), F.col("kind"))
    return p.select("product_id", score.alias("score"))
