"""Queries of predicates, menus, extraction and small sources over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import predicates, text, urls
from vitrine.operators import extract, menus, records
from vitrine.plans.catalogue_queries import Query, products, table
from vitrine.sources.catalogue import PRODUCTS_SQL, dealt_products

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _any(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _pick(key: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _pick_sql(key: str, *values: str) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[({key}) % {len(values)} + 1]"


def _k() -> Column:
    return F.col("product_id")


# Predicates

_IMAGES = ("https://cdn.example.com/files/a.jpg", "https://www.google.com/a.jpg", "https://cdn.example.com/logo/a.png", "https://cdn.example.com/a.SVG", "https://cdn.example.com/b_140x140.jpg", "https://cdn.example.com/c.gif?x=1", "https://cdn.example.com/d.jpg?width=150", "https://cdn.example.com/nav/e.jpg?width=900")


@query(f"""
SELECT product_id, NOT {_any("low", predicates.IMAGE_HOSTS)} AND NOT {_any("low", predicates.IMAGE_PATHS)} AND NOT ends_with(low, '.svg') AS shown,
  NOT {_any("regexp_extract(low, '^[a-z]+://[^/]*([^?]*)', 1)", predicates.SAVED_IMAGE_PATHS)} AND NOT regexp_matches(low, '_140x140|_100x100|_50x50|\\.(gif|svg)(\\?|$)') AND coalesce(CAST(nullif(regexp_extract(low, 'width=([0-9]+)', 1), '') AS INT) >= 200, true) AS saved
FROM (SELECT product_id, lower({_pick_sql("product_id", *_IMAGES)}) AS low FROM {PRODUCTS_SQL})
""")
def image_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _pick(_k(), *_IMAGES)
    return products(spark, sf_dir).select("product_id", predicates.is_product_image(u).alias("shown"), predicates.is_saved_image(u).alias("saved"))


_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
_HOST = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"


@query(rf"""
SELECT page_id, {_any("lower(name)", predicates.UTILITY_NAMES)} OR {_any("lower(url)", ["/cart", "/account", "/login", "/search", "/help", "/policies"])} AS utility,
  {_HOST} = 'www.example.com' AND {_PATH} IN ('', '/') AS homepage, regexp_matches(lower({_PATH}), '/(products?|p|item)/') AS product, page_id % 3 = 1 AS same_category,
  {_any("lower(url)", predicates.RESPONSE_TRACKERS)} AS response_tracker, {_any(f"lower({_HOST})", predicates.ENDPOINT_TRACKERS)} AS endpoint_tracker
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://www.example.com/' WHEN 1 THEN url WHEN 2 THEN 'https://cdn.example.com/products/' || page_id WHEN 3 THEN 'https://x.example.com/google/item/' || page_id ELSE 'https://www.snapshop.com/Cart' END AS url,
  {_pick_sql("page_id", "Rings", "My Wishlist", "Bags", "Sign-In HELP")} AS name FROM pages)
""")
def link_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    u = F.when(k % 5 == 0, "https://www.example.com/").when(k % 5 == 1, F.col("url")).when(k % 5 == 2, F.concat(F.lit("https://cdn.example.com/products/"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("https://x.example.com/google/item/"), k.cast("string"))).otherwise("https://www.snapshop.com/Cart")
    rows = table(spark, sf_dir, "pages").select(k, u.alias("url"), _pick(k, "Rings", "My Wishlist", "Bags", "Sign-In HELP").alias("name"))
    u, name = F.col("url"), F.col("name")
    listing = _pick(k, "https://a.com/c/rings?page=1&tag=x", "https://a.com/c/rings?tag=x&page=3", "https://a.com/c/bags?tag=x&page=3")
    same = predicates.is_same_category(listing, F.lit("https://a.com/c/rings?page=1&tag=x"))
    return rows.select(
        "page_id", predicates.is_utility(name, u).alias("utility"), predicates.is_homepage(u, F.lit("https://www.example.com/shop")).alias("homepage"), predicates.is_product_link(u).alias("product"), same.alias("same_category"),
        predicates.is_response_tracker(u).alias("response_tracker"), predicates.is_endpoint_tracker(u).alias("endpoint_tracker"),
    )


_API = ("https://a.com/api/product/", "https://a.com/Session/", "https://pixel.a.com/v2/item-", "https://a.com/about/", "https://a.com/catalog/stock.json?pixel=")


@query(f"""
WITH r AS (SELECT product_id, {_pick_sql("product_id", *_API)} || product_id AS url, repeat('x', (product_id * 37 % 9000)::INT) AS body, CASE WHEN product_id % 2 = 0 THEN 'application/json' ELSE 'text/html' END AS kind FROM {PRODUCTS_SQL})
SELECT product_id, NOT {_any("lower(split_part(url, '?', 1))", predicates.USELESS_RESPONSES)} AND length(body) >= 100 AS useful,
  regexp_matches(lower(url), '/api/|/graphql|/v[0-9]+/|\\.json|/rest/|/ajax/|/products?/|/catalog/|/commerce/') AS api,
  (10 * (product_id % 4) + CASE WHEN length(body) > 1000 THEN 5 ELSE 0 END + CASE WHEN length(body) > 5000 THEN 10 ELSE 0 END + CASE WHEN contains(kind, 'json') THEN 15 ELSE 0 END
  + 20 * ({" + ".join(f"contains(lower(url), '{w}')::INT" for w in predicates.ENDPOINT_WORDS)}) - CASE WHEN {_any("regexp_extract(lower(url), '//([^/]*)', 1)", predicates.ENDPOINT_TRACKERS)} THEN 100 ELSE 0 END)::BIGINT AS score FROM r
""")
def response_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, body = F.concat(_pick(_k(), *_API), _k().cast("string")), F.repeat(F.lit("x"), (_k() * 37 % 9000).cast("int"))
    score = predicates.endpoint_score(u, _k() % 4, F.length(body), F.when(_k() % 2 == 0, "application/json").otherwise("text/html"))
    return products(spark, sf_dir).select("product_id", predicates.is_useful_response(u, body).alias("useful"), urls.looks_like_api(u).alias("api"), score.cast("long").alias("score"))


_NAMES = ("Ring", " 404 ", "Access Denied", "", "x", "Gold chain")


@query(f"""
WITH r AS (SELECT product_id, {_pick_sql("product_id", *_NAMES)} AS name, CASE WHEN product_id % 4 > 0 THEN price END AS price, product_id % 5 = 0 AS image, CASE WHEN product_id % 7 = 0 THEN 'a long description' ELSE '' END AS d, CASE WHEN product_id % 11 = 0 THEN 429 ELSE 200 END AS status FROM {PRODUCTS_SQL})
SELECT product_id, length(trim(name)) > 1 AND lower(trim(name)) NOT IN ({", ".join(f"'{x}'" for x in predicates.GARBAGE_NAMES)}) AND (coalesce(price, 0) <> 0 OR image OR length(d) > 10) AND status = 200 AS extracted,
  name <> '' AND price IS NOT NULL AND image AND d <> '' AS complete, list_filter(['name', 'price', 'description'], lambda f: (f = 'name' AND name = '') OR (f = 'price' AND price IS NULL) OR (f = 'description' AND d = '')) AS missing FROM r
""")
def extraction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = F.when(_k() % 5 == 0, F.array(F.lit("i"))).otherwise(F.array().cast("array<string>"))
    rows = products(spark, sf_dir).select("product_id", _pick(_k(), *_NAMES).alias("name"), F.when(_k() % 4 > 0, F.col("price")).alias("price"), images.alias("images"), F.when(_k() % 7 == 0, "a long description").otherwise("").alias("d"), F.when(_k() % 11 == 0, 429).otherwise(200).alias("status"))
    name, price, d = F.col("name"), F.col("price"), F.col("d")
    return rows.select(
        "product_id", predicates.is_extracted(name, price, F.col("images"), d, F.col("status")).alias("extracted"), predicates.is_complete(name, price, F.lit("USD"), F.col("images"), d).alias("complete"),
        predicates.missing_fields(name=name == "", price=price.isNull(), description=d == "").alias("missing"),
    )


@query(f"""
WITH r AS (SELECT product_id, name, upper(name) AS shown, price, CASE WHEN product_id % 3 = 0 THEN price + 0.01 WHEN product_id % 3 = 1 THEN price + 1 END AS got, product_id % 9 AS n, product_id % 4 AS seen FROM {PRODUCTS_SQL})
SELECT product_id, coalesce(abs(got - price) < 0.02, false) AS price_ok, true AS name_ok, product_id % 2 = 0 AS currency_ok, length(name) // 2 >= 0.3 * length(name) AS description_ok, n = 0 OR (seen > 0 AND abs(seen - n) <= greatest(2.0, n * 0.3)) AS variants_ok FROM r
""")
def field_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("price")
    got = F.when(_k() % 3 == 0, p + 0.01).when(_k() % 3 == 1, p + 1)
    return products(spark, sf_dir).select(
        "product_id", predicates.matches_truth("price", got, p).alias("price_ok"), predicates.matches_truth("name", F.upper("name"), F.col("name")).alias("name_ok"),
        predicates.matches_truth("currency", F.when(_k() % 2 == 0, "usd").otherwise("eur"), F.lit("USD")).alias("currency_ok"),
        predicates.matches_truth("description", F.left("name", (F.length("name") / 2).cast("int")), F.col("name")).alias("description_ok"), predicates.matches_truth("variants", _k() % 4, _k() % 9).alias("variants_ok"),
    )


_MODALS = ("Join our NEWSLETTER today", "We value your privacy", "Are you 18+?", "Latest news", "50% discount", "Sign In please", "Hello there")


@query(f"""
SELECT product_id, CASE {" ".join(f"WHEN {_any('t', w)} THEN '{k}'" for k, w in predicates.MODAL_WORDS.items())} ELSE 'unknown' END AS kind FROM (SELECT product_id, lower({_pick_sql("product_id", *_MODALS)}) AS t FROM {PRODUCTS_SQL})
""")
def modal_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("product_id", predicates.modal_kind(_pick(_k(), *_MODALS)).alias("kind"))


_TITLES = ("Acme Spring 2021 Runway", "acme haute couture 2021", "Acme menswear 2020", "Nord show 2021", "Acme 2021 reaction", "Acme men's fall")


@query(f"""
SELECT product_id, CASE WHEN NOT contains(t, 'acme') THEN 'brand' WHEN contains(t, 'reaction') THEN 'source' WHEN regexp_extract(t, '(20[0-9]{{2}})', 1) NOT IN ('', '2021') THEN 'year'
  WHEN kind = 'couture' AND NOT contains(t, 'couture') OR kind = 'menswear' AND NOT regexp_matches(t, 'mens?wear|men''s') OR kind = 'ready' AND (contains(t, 'couture') OR regexp_matches(t, 'mens?wear')) THEN 'collection type' ELSE 'ok' END AS verdict
FROM (SELECT product_id, lower({_pick_sql("product_id", *_TITLES)}) AS t, {_pick_sql("product_id // 6", "couture", "menswear", "ready")} AS kind FROM {PRODUCTS_SQL})
""")
def video_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _pick(F.floor(_k() / 6), "couture", "menswear", "ready")
    return products(spark, sf_dir).select("product_id", predicates.title_verdict(_pick(_k(), *_TITLES), F.lit("Acme"), F.lit(2021), kind, ["reaction"]).alias("verdict"))


# Menus and pages before and after an interaction: a document's lines, with some changed

_LINES_SQL = "list_filter(list_transform(string_split({}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS a, replace(coalesce(text, ''), ' the ', ' a ') AS b FROM documents), l AS (SELECT doc_id, {_LINES_SQL.format("a")} AS a, {_LINES_SQL.format("b")} AS b FROM d),
n AS (SELECT *, list_distinct(list_filter(b, lambda x: NOT list_contains(a, x))) AS new, len(list_filter(b, lambda x: list_contains(a, x))) AS old, len(list_filter(list_distinct(a), lambda x: list_contains(b, x))) AS shared FROM l)
SELECT doc_id, len(b) > 0 AND old >= 0.8 * len(b) AS duplicate, len(new) >= 10 AS reacted, shared >= 0.7 * greatest(len(list_distinct(a)), len(list_distinct(b)), 1) AS same_menu FROM n
""")
def page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.coalesce("text", F.lit(""))
    after = F.replace(before, F.lit(" the "), F.lit(" a "))
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", predicates.is_duplicate_block(before, after).alias("duplicate"), records.page_reacted(before, after).alias("reacted"), records.fingerprint_matches(lines(before), lines(after)).alias("same_menu"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A menu of each nation's suppliers: a heading button, then links whose URL is on their line, on the next, or missing."""
    s = F.col("s_suppkey")
    line = F.when(s % 3 == 0, F.concat(F.lit('  - link "'), F.col("s_name"), F.lit('" /url: /s/'), s.cast("string"))).when(s % 3 == 1, F.concat(F.lit("  - link:\n    - /url: /s/rings-and_bags-"), s.cast("string"), F.lit("/"))).otherwise(F.concat(F.lit('  - link "'), F.col("s_name"), F.lit('"\n  - button "Open Open"')))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"]), "\n")
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.concat(F.lit('- tab "Close"\n- menuitem "Nation"\n'), lines).alias("snapshot"))


@query("""
SELECT s_nationkey AS doc_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'Rings And Bags ' || s_suppkey END AS name, '/s/' || CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey::VARCHAR ELSE 'rings-and_bags-' || s_suppkey || '/' END AS url FROM supplier WHERE s_suppkey % 3 < 2
""")
def snapshot_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return menus.snapshot_links(_snapshots(spark, sf_dir)).select("doc_id", "name", "url")


@query("""
SELECT s_nationkey AS doc_id, 'menuitem' AS role, 'Nation' AS name, count(*) - count(*) AS indent, 1::BIGINT AS n FROM supplier GROUP BY s_nationkey
UNION ALL SELECT s_nationkey, 'button', 'Open', 2, count(*) FROM supplier WHERE s_suppkey % 3 = 2 GROUP BY s_nationkey
""")
def snapshot_openers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = menus.snapshot_openers(_snapshots(spark, sf_dir))
    return rows.groupBy("doc_id", "role", "name", F.col("indent").cast("long").alias("indent")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT s_suppkey AS pos, r_name, n_name, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
l AS (SELECT pos, lower(r_name) || ' > ' || lower(n_name) AS node, unnest([1, 2, 3]) AS nth, r_name, n_name, s_name FROM s),
u AS (SELECT node, pos, nth, CASE nth WHEN 1 THEN s_name WHEN 2 THEN lower(n_name) ELSE 'All' END AS name, CASE nth WHEN 1 THEN 'https://shop.example.com/c/' || (pos % 10) WHEN 2 THEN 'https://shop.example.com/c/' || (pos % 3) ELSE 'https://shop.example.com/all' END AS url, nth = 2 AS own FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY node, url ORDER BY pos, nth) AS again FROM u WHERE own OR url NOT IN ('https://shop.example.com/c/4', 'https://shop.example.com/c/1'))
SELECT node, name, url, row_number() OVER (PARTITION BY node ORDER BY pos, nth)::INT AS link_no FROM k WHERE own OR again = 1
UNION ALL SELECT DISTINCT lower(r_name), NULL, NULL, NULL::INT FROM s
""")
def tree_of_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    s = F.col("s_suppkey")
    path = F.array(F.when(s % 2 == 0, F.col("r_name")).otherwise(F.initcap("r_name")), F.col("n_name"))
    links = F.map_from_arrays(
        F.array(F.col("s_name"), F.lower("n_name"), F.lit("All"), F.lit("Home"), F.lit("One")),
        F.array(F.concat(F.lit("/c/"), (s % 10).cast("string")), F.concat(F.lit("https://shop.example.com/c/"), (s % 3).cast("string")), F.lit("all"), F.lit("/"), F.lit("/products/one")),
    )
    filtered = spark.createDataFrame([("https://shop.example.com/c/4",), ("https://shop.example.com/c/1",)], "url string")
    return menus.tree_of_states(rows.select(s.alias("pos"), path.alias("path"), links.alias("links")), "https://shop.example.com/", filtered).select("node", "name", "url", "link_no")


# URLs and text


@query(rf"""
SELECT page_id, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_replace(seg, '\.[a-z]+$', ''), ''), 'Main Collection'), '[-_]+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS category,
  CASE page_id % 4 WHEN 3 THEN NULL ELSE 'abcdefghi_' || (page_id % 10) END AS video, CASE page_id % 3 WHEN 0 THEN 'https://' || {_HOST} || '/icon.svg' ELSE 'https://' || {_HOST} || '/favicon.ico' END AS icon, 4 + (page_id % 3 = 0)::INT AS icons
FROM (SELECT page_id, url, list_extract(string_split(regexp_replace({_PATH}, '/+$', ''), '/'), -1) AS seg FROM pages)
""")
def url_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("page_id"), F.col("url")
    secure = F.regexp_replace(u, "^http:", "https:")
    video = F.concat(_pick(k, "https://www.youtube.com/watch?x=1&v=", "https://youtu.be/", "https://www.youtube.com/embed/", "https://vimeo.com/"), F.lit("abcdefghi_"), (k % 10).cast("string"))
    icons = urls.favicons(secure, F.when(k % 3 == 0, F.array(F.concat(F.lit("https://"), urls.host(u), F.lit("/icon.svg")))))
    return table(spark, sf_dir, "pages").select("page_id", urls.category_name(u).alias("category"), urls.video_id(video).alias("video"), icons[0].alias("icon"), F.size(icons).alias("icons"))


_TYPES = ("image/png; q=1", "image/svg+xml", "text/plain", "image/x-icon", "image/jpeg")


@query(f"""
SELECT product_id, 'say "' || name || '"' || chr(10) || 'it''s a/b' AS unescaped, replace(name, ' ', '\\:') AS css, 'div.c' || product_id % 3 AS signature, name AS said, CASE WHEN product_id % 2 = 0 THEN price END AS found FROM {PRODUCTS_SQL}
""")
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = F.concat(F.lit(' say \\"'), F.col("name"), F.lit('\\"\\nit\\\'s a\\/b\\r '))
    reply = F.concat(F.lit("Sure!\n"), F.when(_k() % 2 == 0, "```json\n").otherwise(""), F.to_json(F.struct("name", F.when(_k() % 2 == 0, F.col("price")).alias("price"))), F.when(_k() % 2 == 0, "\n```").otherwise(" Done."))
    path = F.concat(F.lit("html > body > div.c"), (_k() % 3).cast("string"), F.lit(" > p#x"))
    said = text.json_object(reply)
    return dealt_products(spark, sf_dir).select(
        "product_id", text.unescaped(escaped).alias("unescaped"), text.css_escaped(F.replace("name", F.lit(" "), F.lit(":"))).alias("css"), text.path_signature(path).alias("signature"),
        F.try_variant_get(said, "$.name", "string").alias("said"), F.try_variant_get(said, "$.price", "double").alias("found"),
    )


@query(f"SELECT product_id, {_pick_sql('product_id', '.png', '.svg', '.ico', '.ico', '.jpg')} AS extension FROM {PRODUCTS_SQL}")
def content_type_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).select("product_id", text.extension_of(_pick(_k(), *_TYPES)).alias("extension"))


@query(f"SELECT product_id, CASE WHEN product_id % 3 > 0 THEN 'c' || chr(10) || 'd' || chr(10) || 'e' || chr(10) || '  - link \"' || name || '\"' || chr(10) || 'end' END AS opened FROM {PRODUCTS_SQL}")
def menu_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three lines before the first new one, and all after it; nothing where nothing is new."""
    before = F.lit("a\nb\nc\nd\ne\nend")
    after = F.when(_k() % 3 > 0, F.concat(F.lit("a\nb\nc\nd\ne\n  - link \""), F.col("name"), F.lit("\"\nend"))).otherwise(before)
    return products(spark, sf_dir).select("product_id", F.array_join(records.menu_slice(before, after), "\n").alias("opened"))


# Extraction: a page and its responses are made of a product's own fields, so what comes out is known


def _json_of(fields: dict[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


@query(f"SELECT product_id, name, price, 'USD' AS currency, kind AS brand, 2 AS images, CASE WHEN product_id % 2 = 0 THEN 'M' ELSE 'L' END AS size, product_id % 3 > 0 AS available FROM {PRODUCTS_SQL}")
def shop_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(_k() % 2 == 0, "M").otherwise("L")
    variant = F.struct(F.lit("red").alias("option1"), size.alias("option2"), F.lit("s").alias("sku"), F.col("price").cast("string").alias("price"), (_k() % 3).cast("int").alias("inventory_quantity"))
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("position")) for i, n in enumerate(("Color", "Size"), 1)])
    images = F.array(*[F.struct(F.lit(x).alias("src")) for x in ("a.jpg", "b.jpg")])
    body = F.parse_json(_json_of({"product": F.struct(F.col("name").alias("title"), F.col("kind").alias("vendor"), options.alias("options"), images.alias("images"), F.array(variant).alias("variants"))}))
    f = extract.shop_product(F.col("body"))
    rows = dealt_products(spark, sf_dir).select("product_id", body.alias("body")).select("product_id", *[c.alias(k) for k, c in f.items() if k != "description"])
    return rows.select("product_id", "name", "price", "currency", "brand", F.size("images").alias("images"), F.col("variants")[0]["size"].alias("size"), F.col("variants")[0]["available"].alias("available"))


@query(f"SELECT product_id, name, price, 'EUR' AS currency, CASE WHEN product_id % 2 = 0 THEN 'S' ELSE 'M' END AS size, 'blue' AS color FROM {PRODUCTS_SQL}")
def graph_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = F.struct(F.when(_k() % 2 == 0, "S / blue").otherwise("M / blue").alias("title"), F.lit("x").alias("sku"), F.lit(True).alias("availableForSale"), F.struct(F.col("price").cast("string").alias("amount")).alias("price"))
    low = F.struct(F.struct(F.col("price").cast("string").alias("amount"), F.lit("EUR").alias("currencyCode")).alias("minVariantPrice"))
    body = _json_of({"data": F.struct(F.struct(F.col("name").alias("title"), low.alias("priceRange"), F.struct(F.array(F.struct(node.alias("node"))).alias("edges")).alias("variants")).alias("product"))})
    f = extract.graph_product(F.col("body"))
    rows = dealt_products(spark, sf_dir).select("product_id", F.parse_json(body).alias("body")).select("product_id", *[f[k].alias(k) for k in ("name", "price", "currency", "variants")])
    return rows.select("product_id", "name", "price", "currency", F.col("variants")[0]["size"].alias("size"), F.col("variants")[0]["color"].alias("color"))


@query(f"SELECT product_id::VARCHAR AS url, name, price, 'USD' AS currency, kind AS brand, true AS available FROM {PRODUCTS_SQL} WHERE product_id % 4 > 0")
def linked_data_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    offer = F.struct(F.col("price").cast("string").alias("price"), F.lit("USD").alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"), F.lit("A-42").alias("sku"))
    product = F.struct(F.lit("Product").alias("@type"), "name", F.struct(F.col("kind").alias("name")).alias("brand"), F.array(offer).alias("offers"))
    thing = F.struct(F.lit("Thing").alias("@type"), F.lit("no").alias("name"))
    block = F.when(_k() % 4 == 1, F.to_json(product)).when(_k() % 4 == 2, F.to_json(F.array(product))).when(_k() % 4 == 3, _json_of({"@graph": F.array(product)})).otherwise(F.to_json(thing))
    page = F.concat(F.lit("<script type='application/ld+json'>{broken</script><p>x</p><script type=\"application/ld+json\">"), block, F.lit("</script>"))
    pages = dealt_products(spark, sf_dir).select(_k().cast("string").alias("url"), page.alias("html"))
    return extract.linked_data(pages).select("url", "name", "price", "currency", "brand", F.col("variants")[0]["available"].alias("available"))


@query(f"SELECT product_id, name, price, CASE WHEN product_id % 3 = 0 THEN 'EUR' END AS currency, product_id::VARCHAR AS sku FROM {PRODUCTS_SQL}")
def api_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _json_of({"title": F.col("name"), "currentPrice": F.struct(F.col("price").alias("value")), "currency": F.when(_k() % 3 == 0, "EUR"), "productId": _k()})
    body = F.when(_k() % 3 == 0, flat).when(_k() % 3 == 1, F.concat(F.lit('{"data": {"product": '), flat, F.lit("}}"))).otherwise(F.concat(F.lit('{"result": '), flat, F.lit("}")))
    f = extract.api_product(F.col("body"))
    return dealt_products(spark, sf_dir).select("product_id", F.parse_json(body).alias("body")).select("product_id", *[f[k].alias(k) for k in ("name", "price", "currency", "sku")])


@query(f"SELECT product_id::VARCHAR AS url, name, CASE WHEN product_id % 2 = 0 THEN kind END AS kind, 'USD' AS currency FROM {PRODUCTS_SQL}")
def schema_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = F.lit('{"other": 1}'), _json_of({"p": F.struct(F.array("name").alias("names"), F.when(_k() % 2 == 0, F.col("kind")).alias("kind"))})
    pages = dealt_products(spark, sf_dir).select(F.col("brand_id").alias("domain"), _k().cast("string").alias("url"), F.array(first, second).alias("responses"))
    paths = F.create_map(*[F.lit(x) for x in ("name", "[2].p.names[0]", "kind", "p.kind", "currency", "USD")])
    schemas = products(spark, sf_dir).select(F.col("brand_id").alias("domain")).distinct().withColumn("paths", paths)
    return extract.by_schema(pages, schemas, ["name", "kind", "currency"])


@query(f"SELECT product_id::VARCHAR AS key, name AS title, CASE WHEN product_id % 2 = 0 THEN size_no::VARCHAR END AS size FROM {PRODUCTS_SQL}")
def pattern_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own script is the one that names its slug; the other script has the same fields."""
    slug = F.concat(F.lit("item-"), _k().cast("string"), F.lit("x"))
    script = F.concat(F.lit("<script>var a = {slug: 'other', title: 'No'}</script><script>var b = {slug: '"), slug, F.lit("', title: '"), F.col("name"), F.when(_k() % 2 == 0, F.concat(F.lit("', size: "), F.col("size_no").cast("string"))).otherwise("', none: 1"), F.lit("}</script>"))
    pages = dealt_products(spark, sf_dir).select(F.col("brand_id").alias("domain"), F.concat(F.lit("https://x.example.com/p/"), slug, F.lit("?v=1")).alias("url"), script.alias("html"))
    patterns = products(spark, sf_dir).select(F.col("brand_id").alias("domain")).distinct().withColumn("patterns", F.create_map(*[F.lit(x) for x in ("title", "slug: '{{SLUG}}', title: '([^']*)'", "size", r"size: (\d+)")]))
    found = extract.by_patterns(pages, patterns, ["title", "size"])
    return found.select(F.regexp_extract("url", r"item-(\d+)x", 1).alias("key"), "title", "size")


@query("""
WITH r AS (SELECT l_partkey AS page_url, l_orderkey * 8 + l_linenumber AS response_no, l_quantity::INT AS score, CASE WHEN l_linenumber % 2 = 0 THEN l_shipmode END AS name, CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice END AS price FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
b AS (SELECT page_url, arg_max(name, score * 1e9 - response_no) FILTER (name IS NOT NULL) AS name, arg_max(price, score * 1e9 - response_no) FILTER (price IS NOT NULL) AS price, arg_max(struct_pack(p := price), score * 1e9 - response_no) AS best FROM r GROUP BY page_url)
SELECT page_url, name, CASE WHEN name IS NOT NULL THEN price ELSE best.p END AS price FROM b
""")
def merged_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("page_url"), (F.col("l_orderkey") * 8 + n).alias("response_no"), F.col("l_quantity").cast("int").alias("score"), F.when(n % 2 == 0, F.concat("l_returnflag", "l_linestatus")).alias("name"), F.when(n % 3 == 0, F.col("l_extendedprice")).alias("price"))
    return extract.merged_responses(rows, {"name": "string", "price": "double"})


@query(f"""
SELECT product_id AS page_id, pos::INT AS pos, 'img/' || product_id || CASE pos WHEN 0 THEN 'a_1.jpg' WHEN 2 THEN 'b.png?x=1' ELSE 'c-2.webp' END AS url FROM {PRODUCTS_SQL}, (SELECT unnest([0, 2, 3]) AS pos)
""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sizes of one image count once, at the first."""
    k = _k().cast("string")
    page = F.concat(F.lit("<img src='img/"), k, F.lit("a_1.jpg'><img data-src='img/"), k, F.lit("a_2.jpg'><img src=\"img/"), k, F.lit("b.png?x=1\"><img data-zoom='img/"), k, F.lit("c-2.webp'><img src='x.svg'>"))
    return extract.images(dealt_products(spark, sf_dir).select(_k().alias("page_id"), page.alias("html")))


@query(f"SELECT product_id, 'https://shop.example.com/products/p' || product_id AS product_url, 'https://shop.example.com/' || CASE WHEN product_id % 2 = 0 THEN 'in' ELSE 'before' END || product_id || '.jpg' AS image_url FROM {PRODUCTS_SQL} WHERE product_id % 3 > 0")
def sample_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k().cast("string")
    inside = F.when(_k() % 2 == 0, F.concat(F.lit("<img src='/in"), k, F.lit(".jpg'>"))).otherwise("text")
    page = F.concat(F.lit("<a href='/about'>About</a><img src='/before"), k, F.lit(".jpg'>"), F.when(_k() % 3 > 0, F.concat(F.lit("<a class=x href='/products/p"), k, F.lit("'>"), inside, F.lit("</a><a href='/products/other'><img src='/no.jpg'></a>"))).otherwise(""))
    pages = dealt_products(spark, sf_dir).select("product_id", F.lit("https://shop.example.com/c/all").alias("url"), page.alias("html"))
    return records.sample_product(pages, "product_id")


@query(f"SELECT product_id, (3 * (product_id % 2 = 0)::INT + (product_id % 3 > 0)::INT + 2 * (product_id % 5 = 0)::INT)::INT AS score FROM {PRODUCTS_SQL}")
def image_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt = F.when(_k() % 2 == 0, F.concat(F.lit("The "), F.upper("name"))).otherwise("logo")
    return products(spark, sf_dir).select("product_id", extract.relevance(alt, _k() % 3 == 0, F.when(_k() % 5 == 0, "main-Gallery").otherwise("x"), F.col("name")).cast("int").alias("score"))


@query(f"SELECT product_id, unnest(['a', 'b', 'd', 'a[0]', 'b.c', 'a[0].price', 'b.c.deep']) AS path FROM {PRODUCTS_SQL}")
def response_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.parse_json(_json_of({"a": F.array(F.struct(F.col("price").alias("price")), F.struct(F.col("price").alias("price"))), "b": F.struct(F.struct(F.col("name").alias("deep")).alias("c")), "d": F.col("name")}))
    return extract.keys_of(dealt_products(spark, sf_dir).select("product_id", body.alias("body")), "product_id").select("product_id", "path")


# Small sources


@query("SELECT event_id, position FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS position, count(*) OVER () AS n FROM events) WHERE (position - 1) % (n // 30) = 0 AND (position - 1) // (n // 30) < 30")
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return menus.every_kth(table(spark, sf_dir, "events").select("event_id"), F.col("event_id"), 30).select("event_id", "position")


@query(f"SELECT text, url, row_number() OVER (ORDER BY text, url) AS position FROM (SELECT DISTINCT name AS text, 'https://x.com/fashion/collections/' || kind AS url FROM {PRODUCTS_SQL} WHERE product_id % 2 = 0 AND length(name) > 5)")
def season_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.when(_k() % 2 == 0, "https://x.com/fashion/collections/").otherwise("https://x.com/other/"), "kind")
    return menus.seasons(products(spark, sf_dir).select(url.alias("url"), F.concat(F.lit(" "), "name").alias("text")))


@query(f"SELECT brand_id AS folder, product_id || '.' || {_pick_sql('product_id', 'jpg', 'TXT', 'PNG', 'webp2', 'Gif')} AS filename, row_number() OVER (PARTITION BY brand_id ORDER BY product_id || '.' || {_pick_sql('product_id', 'jpg', 'TXT', 'PNG', 'webp2', 'Gif')})::INT AS position FROM {PRODUCTS_SQL} WHERE product_id % 5 IN (0, 2, 4)")
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(".", _k().cast("string"), _pick(_k(), "jpg", "TXT", "PNG", "webp2", "Gif"))
    return menus.image_files(products(spark, sf_dir).select(F.col("brand_id").alias("folder"), name.alias("filename")))


@query(f"SELECT brand_id, 'https://youtu.be/watch?v=' || size_no AS url, min(product_id) AS pos FROM {PRODUCTS_SQL} WHERE product_id % 3 < 2 GROUP BY brand_id, size_no")
def video_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.concat(F.lit("https://youtu.be/watch?v="), F.col("size_no").cast("string"))
    href = F.when(_k() % 3 == 0, plain).when(_k() % 3 == 1, F.concat(F.lit("/url?q="), F.url_encode(plain), F.lit("&sa=U"))).otherwise("https://other.example.com/v")
    return menus.video_candidates(products(spark, sf_dir).select("brand_id", _k().alias("pos"), href.alias("href")), "brand_id")
