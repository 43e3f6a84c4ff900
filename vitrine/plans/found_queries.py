"""Queries of listing pages, brand folders, emitted frames, approximate search, pools and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import predicates, text
from vitrine.operators import extract, joins, looks, merge, ranking, usage
from vitrine.plans.catalogue_queries import Query, products, table
from vitrine.plans.record_queries import _LINES, _lines
from vitrine.shared import shared_path
from vitrine.sources import brand_folders, listings
from vitrine.sources import catalogue as sources
from vitrine.sources.catalogue import PRODUCTS_SQL, dealt_products
from vitrine.streaming import frames, live

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""
SELECT page_id, replace(href, '&amp;', '&') AS href, 'nav > ul > li' AS lineage, 0 AS images
FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]+)">', 1)) AS href FROM pages)
""")
def page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pattern finds in the stored pages themselves: each link of a list item once a page, with the lineage of its container."""
    found = listings.listing_products(table(spark, sf_dir, "pages").select("page_id", "html"), "nav li", "a")
    return found.select("page_id", "href", "lineage", F.size("images").alias("images"))


@query("""
SELECT 's' || s_suppkey AS brand_id, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey ELSE s_name END AS domain, CASE WHEN s_suppkey % 2 = 0 THEN 8 ELSE 1 END AS fields,
  CASE WHEN s_suppkey % 2 = 0 THEN 100.0::DOUBLE ELSE s_acctbal END AS score, s_suppkey % 2 = 0 AS migrated, CASE WHEN s_suppkey % 3 = 0 THEN '.gallery' END AS container_selector
FROM supplier
""")
def saved_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files for each brand, half of them of the older shape, some with a gallery's; read in one shape."""
    path, k = shared_path(spark, "brand-folders"), F.col("s_suppkey")
    old = F.to_json(F.struct(F.lit("api").alias("strategy")))
    new = F.to_json(F.struct(F.col("s_name").alias("domain"), F.array(F.struct(F.lit("json").alias("strategy"), F.array(F.lit("price")).alias("fields"), F.col("s_acctbal").alias("score"))).alias("contributions")))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("brand_id"), "s_suppkey", F.when(k % 2 == 0, old).otherwise(new).alias("body"))
    gallery = F.when(k % 2 == 0, F.lit('{"gallery_selector": ".gallery"}')).otherwise(F.lit('{"image_selector": "img", "url_attribute": "src", "container_selector": ".gallery"}'))
    brand_folders.save_files(rows.withColumn("file", F.lit("config.json")).unionByName(rows.where(k % 3 == 0).withColumns({"file": F.lit("gallery.json"), "body": gallery})), path)
    one = F.get("contributions", 0)
    return brand_folders.read_brand_folders(spark, path).select("brand_id", "domain", F.size(one["fields"]).alias("fields"), one["score"].alias("score"), "migrated", "container_selector")


@query("SELECT DISTINCT CASE WHEN s_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END || '_' || (s_suppkey % 7) AS brand_id FROM supplier")
def brand_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are the folders that hold nav.json or brand.json; one with other files alone is none."""
    path = shared_path(spark, "brand-directories")
    brand = F.concat(F.when(F.col("s_nationkey") % 2 == 0, "even").otherwise("odd"), F.lit("_"), (F.col("s_suppkey") % 7).cast("string"))
    rows = table(spark, sf_dir, "supplier").select(brand.alias("brand_id")).distinct()
    file = F.when(F.substring("brand_id", -1, 1).cast("int") % 2 == 0, "nav.json").otherwise("brand.json")
    other = rows.select(F.concat("brand_id", F.lit("_none")).alias("brand_id"), F.lit("products.json").alias("file"), F.lit("[]").alias("body"))
    brand_folders.save_files(rows.select("brand_id", file.alias("file"), F.lit("{}").alias("body")).unionByName(other), path)
    return sources.list_brands(spark, path)


@query("SELECT event_id AS seq, 'event: ' || event_type || chr(10) || 'data: ' || event_id || chr(10) || chr(10) AS frame FROM events")
def emitted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of frames goes to the sink; a listener that comes afterwards reads all of them."""
    sink, checkpoint = shared_path(spark, "frames"), shared_path(spark, "frames-checkpoint")
    frame = F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), F.col("event_id").cast("string"), F.lit("\n\n"))
    rows = live.stream_table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), frame.alias("frame"))
    run = frames.emit(rows, sink, checkpoint)
    run.awaitTermination()
    return frames.heard(spark, sink).select("seq", "frame")


def _errors(column: str) -> str:
    return f"(SELECT min(levenshtein(substr(lower({column}), i, n), 'rde wigdet')) FROM (SELECT unnest(range(1, length({column}) + 1)) AS i), (SELECT unnest(range(1, 16)) AS n))"


@query(f"""
WITH p AS (SELECT product_id, name, kind, least({_errors('name')}, 10) AS a, least({_errors('kind')}, 10) AS b FROM (SELECT DISTINCT ON (name, kind) * FROM {PRODUCTS_SQL} ORDER BY product_id)),
s AS (SELECT name, kind, (2.0::DOUBLE * CASE WHEN a <= 5 THEN 1 - a / 10.0::DOUBLE ELSE 0 END + 1.0::DOUBLE * CASE WHEN b <= 5 THEN 1 - b / 10.0::DOUBLE ELSE 0 END) / 3.0::DOUBLE AS score FROM p WHERE a <= 5 OR b <= 5)
SELECT product_id, score FROM {PRODUCTS_SQL} JOIN s USING (name, kind)
""")
def fuzzy_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A misspelt search over two weighted columns, by the fewest edits with which it occurs in them."""
    return ranking.fuzzy_ranked(dealt_products(spark, sf_dir), "rde wigdet", {"name": 2.0, "kind": 1.0}).select("product_id", "score")


@query("""
WITH u AS (SELECT user_id % 8 AS pool, ts AS s, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS e FROM events WHERE value >= 0),
b AS (SELECT a.pool, a.s, count(*) AS busy FROM u a JOIN u o ON o.pool = a.pool AND o.s <= a.s AND a.s < o.e WHERE a.e > a.s GROUP BY ALL)
SELECT pool, count(*) AS served, coalesce((SELECT max(busy) FROM b WHERE b.pool = u.pool), 0) AS peak, 100 - coalesce((SELECT max(busy) FROM b WHERE b.pool = u.pool), 0) AS available_at_peak, sum(date_diff('microsecond', s, e)) / 1000000.0::DOUBLE AS busy_seconds
FROM u GROUP BY pool
""")
def pool_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uses of eight pools, each as many minutes long as its value."""
    start = F.col("ts").cast("timestamp")
    uses = table(spark, sf_dir, "events").where("value >= 0").select((F.col("user_id") % 8).alias("pool"), start.alias("start"), (start + F.make_dt_interval(secs=F.floor(F.col("value") * 60))).alias("end"))
    return usage.pool_statistics(uses, 100)


@query(f"SELECT product_id, CASE WHEN length(name) > 1 THEN 30 ELSE 0 END + CASE WHEN price > 0 THEN 30 ELSE 0 END + 10 * least(product_id % 5, 3) + CASE WHEN product_id % 2 = 0 AND length(name) > 10 THEN 10 ELSE 0 END AS score FROM {PRODUCTS_SQL}")
def benchmark_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = products(spark, sf_dir).withColumns({"images": F.array_repeat(F.lit("x"), (F.col("product_id") % 5).cast("int")), "description": F.when(F.col("product_id") % 2 == 0, F.col("name"))})
    return rows.select("product_id", predicates.benchmark_score(F.col("name"), F.col("price"), F.col("images"), F.col("description")).cast("long").alias("score"))


@query("SELECT page_id, regexp_matches(lower(url), 'google|facebook|analytics|tracking|pixel|doubleclick|criteo|onetrust|cookielaw') AS passed_over FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || '/Pixel.gif' ELSE url END AS url FROM pages)")
def load_trackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit("/Pixel.gif"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", predicates.is_load_tracker(url).alias("passed_over"))


@query(f"SELECT product_id, unnest(['data[0].items[0].price', 'data[0].items[0].a.b.title', 'skuList', 'w[0][0].color']) AS path FROM {PRODUCTS_SQL}")
def product_field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that speak of a product: five names deep, through any number of arrays; a sixth name is too deep, and other names don't count."""
    deep = F.struct(F.struct(F.col("name").alias("title"), F.struct(F.col("name").alias("image")).alias("c")).alias("b"))
    item = F.struct(F.col("price").alias("price"), deep.alias("a"), F.lit(1).alias("other"))
    body = F.struct(F.array(F.struct(F.array(item, item).alias("items"))).alias("data"), F.array(F.lit(1)).alias("skuList"), F.array(F.array(F.struct(F.lit(1).alias("color")))).alias("w"))
    return extract.product_paths(dealt_products(spark, sf_dir).select("product_id", F.parse_json(F.to_json(body)).alias("body")), "product_id")


@query(f"""
WITH b AS (SELECT * FROM {_LINES} WHERE kind IN ('button', 'heading'))
SELECT a.doc_id, a.line_no, arg_max(b.line_no, b.indent) AS parent_line FROM {_LINES} a LEFT JOIN b ON a.doc_id = b.doc_id AND b.line_no < a.line_no AND b.indent < a.indent
  AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.line_no > b.line_no AND c.line_no < a.line_no AND c.indent <= b.indent)
GROUP BY a.doc_id, a.line_no
""")
def expandable_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.expandable_above(_lines(spark, sf_dir), ("button", "heading")).select("doc_id", "line_no", "parent_line")


@query("""
WITH c AS (SELECT user_id AS domain, event_type AS strategy, max(value) AS score, bool_or(event_id % 2 = 0) AS even, bool_or(event_id % 3 = 0) AS third FROM events GROUP BY ALL),
f AS (SELECT domain, strategy, score, unnest(CASE WHEN even AND third THEN ['even', 'third'] WHEN even THEN ['even'] WHEN third THEN ['third'] ELSE [] END) AS field FROM c),
w AS (SELECT *, row_number() OVER (PARTITION BY domain, field ORDER BY score DESC, strategy) AS r FROM f)
SELECT domain, strategy, string_agg(field, ';' ORDER BY field) AS added FROM w WHERE r = 1 GROUP BY domain, strategy
""")
def minimal_strategy_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy cover of each user's event types by score: a type is kept for the fields that no better one has."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("domain"), F.col("event_type").alias("strategy")).agg(F.max("value").alias("score"), F.bool_or(F.col("event_id") % 2 == 0).alias("even"), F.bool_or(F.col("event_id") % 3 == 0).alias("third"))
    fields = F.filter(F.array(F.when(F.col("even"), "even"), F.when(F.col("third"), "third")), lambda x: x.isNotNull())
    return merge.minimal_strategies(rows.withColumn("fields", fields)).select("domain", "strategy", "added")


@query(f"""
WITH i AS (SELECT p.product_id % 100 AS page, p.product_id AS pos, 'https://x.com/' || (p.product_id % 7) || '/' || (p.product_id % 300) || '.jpg' AS url,
  CASE WHEN p.product_id % 4 < 2 THEN 3 ELSE 0 END + CASE WHEN p.product_id % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN p.product_id % 5 = 0 THEN 2 ELSE 0 END AS score FROM {PRODUCTS_SQL} p),
o AS (SELECT *, row_number() OVER (PARTITION BY page, pos % 300 ORDER BY score DESC, pos) AS r FROM i WHERE score > 1)
SELECT page, url, score, row_number() OVER (PARTITION BY page ORDER BY score DESC, pos) AS rank FROM o WHERE r = 1
""")
def relevant_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in order of relevance, those of little left out, each file once."""
    k = F.col("product_id")
    url = F.concat(F.lit("https://x.com/"), (k % 7).cast("string"), F.lit("/"), (k % 300).cast("string"), F.lit(".jpg"))
    score = extract.relevance(F.when(k % 4 < 2, F.col("name")), k % 3 == 0, F.when(k % 5 == 0, F.lit("Gallery")), F.col("name"))
    found = products(spark, sf_dir).select((k % 100).alias("page"), k.alias("pos"), url.alias("url"), score.alias("score"))
    return extract.by_relevance(found, "page").select("page", "url", "score", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT product_id::VARCHAR AS key, CASE WHEN product_id % 5 > 0 THEN name END AS title, CASE WHEN product_id % 5 > 0 THEN size_no::VARCHAR END AS size FROM {PRODUCTS_SQL}")
def template_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by the template of a brand, around the page's own slug, however its words are parted; every fifth page has another slug alone."""
    k = F.col("product_id").cast("string")
    own = F.when(F.col("product_id") % 5 > 0, F.concat(F.lit("item_"), k, F.lit(" x"))).otherwise("other")
    html = F.concat(F.lit('<script>[{"slug":"other","title":"No","size":0},  {"slug" : "'), own, F.lit('", "title":  "'), F.col("name"), F.lit('","size":'), F.col("size_no").cast("string"), F.lit("}]</script>"))
    pages = dealt_products(spark, sf_dir).select(F.col("brand_id").alias("domain"), F.concat(F.lit("https://x.example.com/p/item-"), k, F.lit("-x?v=1")).alias("url"), html.alias("html"))
    template = F.lit('{ "slug" : "{{SLUG}}" , "title" : "{title}" , "size" : {size} }')
    templates = products(spark, sf_dir).select(F.col("brand_id").alias("domain"), template.alias("template")).distinct()
    found = extract.by_templates(pages, templates, {"title": '[^"]*', "size": r"\d+"})
    return found.select(F.regexp_extract("url", r"item-(\d+)-x", 1).alias("key"), "title", "size")


@query(f"""
SELECT product_id, CASE WHEN product_id % 4 = 0 THEN 'https://b.myshopify.com/graphql' WHEN product_id % 4 = 1 THEN 'https://a.myshopify.com/graphql' WHEN product_id % 4 = 2 THEN 'https://shop-' || product_id || '.myshopify.com/api/2024-01/graphql.json' END AS endpoint,
  CASE WHEN product_id % 4 = 0 THEN name WHEN product_id % 4 < 3 THEN lpad(product_id::VARCHAR, 32, 'a') END AS token
FROM {PRODUCTS_SQL}
""")
def graph_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By headers of the second request, by an address without a token and the page's script, by the script alone, or not at all."""
    k = F.col("product_id")
    request = lambda url, token: F.struct(F.lit(url).alias("url"), F.create_map(F.lit("Accept"), F.lit("*"), F.lit("X-Shopify-Storefront-Access-Token"), token).alias("headers"))
    bare = lambda url: F.struct(F.lit(url).alias("url"), F.create_map(F.lit("Accept"), F.lit("*")).alias("headers"))
    requests = F.when(k % 4 == 0, F.array(bare("https://a.myshopify.com/graphql"), request("https://b.myshopify.com/graphql", F.col("name")))).when(k % 4 == 1, F.array(bare("https://x.com/graphql"), bare("https://a.myshopify.com/graphql"))).when(k % 4 == 2, F.array(bare("https://a.myshopify.com/cart")))
    html = F.when(k % 4 != 3, F.concat(F.lit("<script>var s = 'shop-"), k.cast("string"), F.lit(".myshopify.com', t = {\"storefrontAccessToken\": \""), F.lpad(k.cast("string"), 32, "a"), F.lit("\"}</script>"))).otherwise("<p>none</p>")
    return extract.graph_endpoint(dealt_products(spark, sf_dir).select("product_id", requests.alias("requests"), html.alias("html"))).select("product_id", "endpoint", "token")


@query("""
WITH i AS (SELECT user_id AS page, event_id AS dom, event_type AS ancestry, 'https://x.com/' || event_id || '/' || (event_id % 50) || '.jpg' AS url, event_id % 50 AS stem FROM events),
c AS (SELECT page, ancestry, count(*) AS n, min(dom) AS f FROM i GROUP BY ALL), b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY page ORDER BY n DESC, f) = 1),
o AS (SELECT i.*, n FROM i JOIN b USING (page, ancestry) QUALIFY row_number() OVER (PARTITION BY page, stem ORDER BY dom) = 1)
SELECT page, ancestry, n AS images, url, CAST(row_number() OVER (PARTITION BY page ORDER BY dom) AS INTEGER) AS position FROM o
""")
def primary_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of each user's commonest ancestry, in page order, each file once."""
    e = F.col("event_id")
    url = F.concat(F.lit("https://x.com/"), e.cast("string"), F.lit("/"), (e % 50).cast("string"), F.lit(".jpg"))
    images = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), e.alias("dom_index"), F.col("event_type").alias("ancestry"), url.alias("url"))
    return looks.primary_cluster(images, "page").select("page", "ancestry", "images", "url", "position")


@query("""
WITH g AS (SELECT user_id AS page, event_type AS css_class, count(*) AS members FROM events WHERE event_id % 3 > 0 OR event_type = 'view' GROUP BY ALL HAVING count(*) > 1)
SELECT *, count(*) OVER (PARTITION BY page) > 1 AS filterable FROM g
""")
def class_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of one class; a third of them, but for one class, has none."""
    css = F.when((F.col("event_id") % 3 > 0) | (F.col("event_type") == "view"), F.col("event_type"))
    return looks.class_groups(table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.lit("x").alias("name"), css.alias("css_class")), "page")


@query(f"""
SELECT product_id, CASE WHEN product_id % 4 = 0 THEN '#g' || product_id WHEN product_id % 4 = 1 THEN '.Product-Media' WHEN product_id % 4 = 2 THEN '.' || replace(name, ' ', '-') || '.big' ELSE '.flex.block' END || ' img' AS selector,
  CASE WHEN product_id % 4 = 0 THEN 'a > #g' || product_id WHEN product_id % 4 = 1 THEN 'a > relative.x > Product-Media.y' WHEN product_id % 4 = 2 THEN 'a > flex.' || replace(name, ' ', '-') || '.big.red' ELSE 'a > flex.block.hidden' END || ' > ul' AS signature
FROM {PRODUCTS_SQL}
""")
def gallery_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with an id, with a gallery's class, with telling classes, and with none that tells anything."""
    k, part = F.col("product_id"), lambda tag, cls="", id_="": F.struct(F.lit(tag).alias("tag"), (cls if not isinstance(cls, str) else F.lit(cls)).alias("cls"), (id_ if not isinstance(id_, str) else F.lit(id_)).alias("id"))
    name = F.replace("name", F.lit(" "), F.lit("-"))
    path = F.when(k % 4 == 0, F.array(part("a"), part("div", "", F.concat(F.lit("g"), k.cast("string"))), part("ul"))).when(k % 4 == 1, F.array(part("a"), part("div", "relative.x"), part("div", "Product-Media.y"), part("ul")))
    path = path.when(k % 4 == 2, F.array(part("a"), part("div", F.concat(F.lit("flex."), name, F.lit(".big.red"))), part("ul"))).otherwise(F.array(part("a"), part("div", "flex.block.hidden"), part("ul")))
    rows = dealt_products(spark, sf_dir).select("product_id", path.alias("path"))
    return rows.select("product_id", text.image_selector(F.col("path")).alias("selector"), text.container_signature(F.col("path")).alias("signature"))
