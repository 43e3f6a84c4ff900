"""Extraction of products and links from stored pages and captured JSON.

JSON is VARIANT, so its shape needn't be known; paths are plain column expressions. Python is used, in Arrow batches, where a row brings
its own pattern or a page must be parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import text
from vitrine.functions.predicates import any_of
from vitrine.functions.urls import absolute, extract, host
from vitrine.shared import staged

VARIANTS = "array<struct<size:string,color:string,sku:string,price:double,available:boolean>>"
#: Names under which an API response may hold a field, in the order in which they are tried.
ALIASES = {
    "name": ["name", "title", "productName", "displayName"],
    "price": ["price", "currentPrice", "salePrice", "amount"],
    "currency": ["currency", "currencyCode", "priceCurrency"],
    "description": ["description", "longDescription", "shortDescription"],
    "sku": ["sku", "productId", "id"],
}
#: Objects of a response in which a product may lie.
OBJECTS = ["product", "data.product", "data", "item", "result", "payload"]
#: Parts of keys that speak of a product.
INDICATORS = ["price", "variant", "sku", "title", "name", "image", "description", "size", "color", "stock"]


def get(body: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(body, path, kind)


def shop_product(body: Column) -> dict[str, Column]:
    """Fields of a shop's product JSON: option positions name size and colour; the price is the first variant's, the currency USD."""
    p = lambda path, kind="string": get(body, f"$.product.{path}", kind)
    options = p("options", "array<struct<name:string,position:int>>")
    raw = p("variants", "array<struct<option1:string,option2:string,option3:string,sku:string,price:string,available:boolean,inventory_quantity:int>>")

    def option(v: Column, *names: str) -> Column:
        at = F.get(F.filter(options, lambda o: F.lower(o["name"]).isin(*names)), F.lit(0))["position"]
        return F.when(at == 1, v["option1"]).when(at == 2, v["option2"]).when(at == 3, v["option3"])

    variants = F.transform(
        raw, lambda v: F.struct(option(v, "size").alias("size"), option(v, "color", "colour").alias("color"), v["sku"].alias("sku"), text.price(v["price"]).alias("price"), F.coalesce(v["available"], v["inventory_quantity"] > 0).alias("available"))
    )
    images = F.transform(p("images", "array<struct<src:string>>"), lambda i: i["src"])
    return {"name": p("title"), "price": F.get(variants, F.lit(0))["price"], "currency": F.lit("USD"), "description": text.strip_tags(p("body_html")), "brand": p("vendor"), "images": images, "variants": variants}


def graph_product(body: Column) -> dict[str, Column]:
    """Fields of a GraphQL product: edges of nodes, options by name, else a title split at " / "."""
    root = "$.data.product"
    nodes = F.transform(
        get(body, f"{root}.variants.edges", "array<struct<node:struct<title:string,sku:string,availableForSale:boolean,price:struct<amount:string>,selectedOptions:array<struct<name:string,value:string>>>>>"), lambda e: e["node"]
    )

    def option(v: Column, place: int, *names: str) -> Column:
        named = F.get(F.filter(v["selectedOptions"], lambda o: F.lower(o["name"]).isin(*names)), F.lit(0))["value"]
        return F.coalesce(named, F.get(F.split(v["title"], " / "), F.lit(place)))

    variants = F.transform(nodes, lambda v: F.struct(option(v, 0, "size").alias("size"), option(v, 1, "color", "colour").alias("color"), v["sku"].alias("sku"), text.price(v["price"]["amount"]).alias("price"), v["availableForSale"].alias("available")))
    low = f"{root}.priceRange.minVariantPrice"
    return {"name": get(body, f"{root}.title"), "price": text.price(get(body, f"{low}.amount")), "currency": get(body, f"{low}.currencyCode"), "description": get(body, f"{root}.description"), "brand": get(body, f"{root}.vendor"), "images": F.transform(get(body, f"{root}.images.edges", "array<struct<node:struct<url:string>>>"), lambda e: e["node"]["url"]), "variants": variants}


def linked_data(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """The first product of each page's linked data: directly, in a list, or in a graph; offers may be one or several."""
    block = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(block), F.lit(1))).alias("block_no", "text")).select(key, "block_no", F.try_parse_json("text").alias("j"))
    nodes = blocks.withColumn("node", F.explode(F.concat(F.array("j"), *[F.coalesce(F.try_variant_get("j", p, "array<variant>"), F.array().cast("array<variant>")) for p in ("$['@graph']", "$")])))
    j = F.col("node")
    found = nodes.where(get(j, "$['@type']") == "Product").withColumn("node_no", F.monotonically_increasing_id())
    offers = F.coalesce(get(j, "$.offers", "array<struct<price:string,priceCurrency:string,availability:string,sku:string>>"), F.array(get(j, "$.offers", "struct<price:string,priceCurrency:string,availability:string,sku:string>")))
    first = F.get(F.filter(offers, lambda o: o.isNotNull()), F.lit(0))
    variants = F.transform(F.filter(offers, lambda o: o["sku"].isNotNull()), lambda o: F.struct(extract(o["sku"], r"(\d{2,3})$").alias("size"), F.lit(None).cast("string").alias("color"), o["sku"].alias("sku"), text.price(o["price"]).alias("price"), text.availability(o["availability"]).alias("available")))
    fields = found.select(
        key, "block_no", "node_no", get(j, "$.name").alias("name"), text.price(first["price"]).alias("price"), first["priceCurrency"].alias("currency"), get(j, "$.description").alias("description"),
        F.coalesce(get(j, "$.brand.name"), get(j, "$.brand")).alias("brand"), F.coalesce(get(j, "$.category.name"), get(j, "$.category")).alias("category"), F.coalesce(get(j, "$.image", "array<string>"), F.array(get(j, "$.image"))).alias("images"), variants.alias("variants"),
    )
    whole = F.struct(*[c for c in fields.columns if c not in (key, "block_no", "node_no")])
    return fields.groupBy(key).agg(F.min_by(whole, F.struct("block_no", "node_no")).alias("p")).select(key, "p.*")


def meta_fields(html: Column) -> dict[str, Column]:
    """Name, price, currency, description and image from a page's meta tags, in either order of attributes, else its title without the site's name."""

    def tag(*names: str) -> Column:
        either = "|".join(re.escape(n) for n in names)
        one = rf"""(?is)<meta[^>]*(?:property|name|itemprop)=["'](?:{either})["'][^>]*content=["']([^"']*)["']"""
        other = rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:property|name|itemprop)=["'](?:{either})["']"""
        return F.coalesce(extract(html, one), extract(html, other))

    title = F.trim(F.regexp_replace(extract(html, "(?is)<title[^>]*>(.*?)</title>"), r"\s+[|–—-]\s+[^|–—-]*$", ""))
    return {"name": F.coalesce(tag("name"), tag("og:title"), tag("twitter:title"), title), "price": text.price(tag("price", "product:price:amount", "og:price:amount")), "currency": tag("priceCurrency", "product:price:currency", "og:price:currency"), "description": F.coalesce(tag("og:description"), tag("description"), tag("twitter:description")), "image": F.coalesce(tag("og:image"), tag("twitter:image"), tag("image"))}


def api_product(body: Column) -> dict[str, Column]:
    """Fields of any API response: each by its names, at the top or in one of the usual objects; an object's name or value stands for it."""

    #: The objects that are there, so that names aren't looked for in the others.
    objects = F.filter(F.array(body, *[get(body, f"$.{o}", "variant") for o in OBJECTS]), lambda o: o.isNotNull())

    def field(name: str) -> Column:
        def first(found: Column, o: Column) -> Column:
            tries = [get(o, f"$.{a}{end}") for a in ALIASES[name] for end in ("", ".name", ".value", ".amount")]
            return F.coalesce(found, *[F.when(~t.startswith("{") & ~t.startswith("["), t) for t in tries])

        return F.aggregate(objects, F.lit(None).cast("string"), first)

    return {k: text.price(field(k)) if k == "price" else field(k) for k in ALIASES}


#: Parts of field names that speak of a product; those that contain another one are left out.
PRODUCT_NAMES = ["price", "cost", "amount", "size", "color", "colour", "stock", "inventory", "availability", "sku", "productid", "itemid", "variantid", "name", "title", "description", "details", "image", "media", "gallery", "variant", "options", "material", "fabric", "composition"]


def response_score(keys: Column) -> Column:
    """10 for each key of a response that speaks of a product."""
    return 10 * F.size(F.filter(keys, lambda k: F.lower(k).rlike("|".join(INDICATORS))))


def keys_of(bodies: DataFrame, key: str, body: str = "body", depth: int = 3) -> DataFrame:
    """key and path of every field of a VARIANT down to `depth`, of arrays their first item: one explode per level."""
    level, out = bodies.select(key, F.lit("").alias("path"), F.col(body).alias("v")), None
    for _ in range(depth):
        inner = level.sparkSession.sql(f"SELECT b.{key}, b.path, f.pos AS pos, f.key AS k, f.value AS value FROM {{level}} b, LATERAL variant_explode_outer(b.v) AS f", level=level)
        inner = inner.where("k IS NOT NULL OR pos = 0").select(key, F.when(F.col("k").isNull(), F.concat("path", F.lit("[0]"))).when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws(".", "path", "k")).alias("path"), F.col("value").alias("v"))
        rows = inner.select(key, "path")
        out, level = rows if out is None else out.unionAll(rows), inner
    return out


def product_paths(bodies: DataFrame, key: str, body: str = "body", names: int = 5) -> DataFrame:
    """key and path of the fields of a VARIANT whose name speaks of a product, `names` names deep at most; an array stands for its first item,
    however many arrays there are on the way, and takes no depth. One explode for each level that has anything."""
    level, out = bodies.select(key, F.lit("").alias("path"), F.lit(0).alias("names"), F.lit("").alias("name"), F.col(body).alias("v")), None
    while True:
        inner = level.sparkSession.sql(f"SELECT b.{key}, b.path, b.names, f.pos AS pos, f.key AS k, f.value AS value FROM {{level}} b, LATERAL variant_explode(b.v) AS f", level=level)
        named = F.col("k").isNotNull()
        inner = inner.where((named & (F.col("names") < names)) | (~named & (F.col("pos") == 0) & (F.col("names") < names)))
        path = F.when(~named, F.concat("path", F.lit("[0]"))).when(F.col("path") == "", F.col("k")).otherwise(F.concat_ws(".", "path", "k"))
        #: The next level is small beside the texts, and is read by the level after it too.
        level = staged(inner.select(key, path.alias("path"), (F.col("names") + named.cast("int")).alias("names"), F.coalesce("k", F.lit("")).alias("name"), F.col("value").alias("v")), "paths")
        found = level.where(any_of(F.lower("name"), PRODUCT_NAMES)).select(key, "path")
        out = found if out is None else out.unionAll(found)
        if level.isEmpty():
            return out


def merged_responses(responses: DataFrame, fields: dict[str, str], key: str = "page_url") -> DataFrame:
    """Per page of responses (key, response_no, score, fields): each field from the best response that has it, if together they have a name; else the best one's."""
    best = F.max_by(F.struct(*fields), F.struct("score", -F.col("response_no")))
    each = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("score", -F.col("response_no")))).alias(c) for c in fields]
    rows = responses.groupBy(key).agg(best.alias("best"), *each)
    return rows.select(key, *[F.when(F.col("name").isNotNull(), F.col(c)).otherwise(F.col("best")[c]).alias(c) for c in fields])


def by_schema(pages: DataFrame, schemas: DataFrame, names: list[str]) -> DataFrame:
    """Fields of pages (domain, url, responses array<string>) by the path strings of their domain: "[n].a.b" is the n-th response, a path without
    number the first response that has it, a string without a dot or bracket a literal. Paths differ by row, so Arrow batches evaluate them."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = {n: [] for n in names}
            for responses, paths in zip(rows["responses"], rows["paths"], strict=True):
                bodies = [_json(json, r) for r in responses]
                for n in names:
                    out[n].append(_follow(bodies, (dict(paths) if paths is not None else {}).get(n)))
            yield pd.DataFrame({"url": rows["url"], **out})

    joined = pages.join(schemas, "domain", "left").select("url", "responses", "paths")
    return joined.mapInPandas(run, "url string, " + ", ".join(f"{n} string" for n in names))


def _json(json, body: str):  # noqa: ANN001, ANN202
    try:
        return json.loads(body)
    except ValueError:
        return None


def _follow(bodies: list, path: str | None) -> str | None:
    if path is None:
        return None
    if "." not in path and "[" not in path:
        return path
    numbered = re.match(r"\[(\d+)\]\.?(.*)", path)
    chosen = bodies[int(numbered[1]) - 1 : int(numbered[1])] if numbered else bodies
    for value in chosen:
        for part in re.findall(r"[^.\[\]]+", numbered[2] if numbered else path):
            value = value.get(part) if isinstance(value, dict) else value[int(part)] if isinstance(value, list) and part.isdigit() and int(part) < len(value) else None
        if value is not None:
            return str(value)
    return None


def by_patterns(pages: DataFrame, patterns: DataFrame, names: list[str]) -> DataFrame:
    """Fields of pages (domain, url, html) by the patterns of their domain, looked for in scripts that name the page's slug; the last group of a
    match is the value, {{SLUG}} the escaped slug. A pattern that isn't valid finds nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = {n: [] for n in names}
            for url, page, own in zip(rows["url"], rows["html"], rows["patterns"], strict=True):
                slug = re.split("[?#]", url)[0].rstrip("/").rsplit("/", 1)[-1]
                fuzzy = re.compile(text.fuzzy_slug_pattern(slug), re.I)
                scripts = "\n".join(s for s in re.findall(r"(?is)<script[^>]*>(.*?)</script>", page or "") if fuzzy.search(s))
                for n in names:
                    out[n].append(_match((dict(own) if own is not None else {}).get(n), slug, scripts))
            yield pd.DataFrame({"url": rows["url"], **out})

    return pages.join(patterns, "domain", "left").select("url", "html", "patterns").mapInPandas(run, "url string, " + ", ".join(f"{n} string" for n in names))


def graph_endpoint(pages: DataFrame) -> DataFrame:
    """pages (with requests, an array of (url, headers) in order, and html) with endpoint and token of a shop's product service: of the first
    request to one that carries a token; else the last such request's address, and what the page's own scripts say: a token, and an address
    made of the shop's name if no request has one. Null where there is none."""
    token_of = lambda r: F.get(F.map_values(F.map_filter(r["headers"], lambda k, v: F.contains(F.lower(k), F.lit("storefront-access-token")))), 0)
    fits = lambda r: F.coalesce(F.contains(r["url"], F.lit("myshopify.com")) & F.contains(r["url"], F.lit("graphql")), F.lit(False))
    none = F.struct(F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("token"))
    step = lambda acc, r: F.when(acc["token"].isNotNull() | ~fits(r), acc).otherwise(F.struct(r["url"].alias("url"), token_of(r).alias("token")))
    rows = pages.withColumn("_found", F.aggregate(F.coalesce("requests", F.array().cast(pages.schema["requests"].dataType)), none, step))
    said = F.nullif(F.regexp_extract("html", r"""(?i)storefrontAccessToken["'\s:]+([a-f0-9]{32})""", 1), F.lit(""))
    shop = F.nullif(F.regexp_extract("html", r"(?i)([a-z0-9-]+\.myshopify\.com)", 1), F.lit(""))
    made = F.when(F.col("_found.token").isNull(), F.concat(F.lit("https://"), shop, F.lit("/api/2024-01/graphql.json")))
    return rows.withColumns({"endpoint": F.coalesce("_found.url", made), "token": F.coalesce("_found.token", said)}).drop("_found")


def by_templates(pages: DataFrame, templates: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Fields of pages (domain, url, html) by the template of their domain (domain, template): text in which {field} stands for a value, of the
    pattern that `fields` gives it, and {{SLUG}} for the page's slug, whatever parts its words. Blanks of a template stand for any. The first
    place in the page that fits gives all fields; one that a template doesn't name, and all of a page where nothing fits, are null."""
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = []
            for url, page, template in zip(rows["url"], rows["html"], rows["template"], strict=True):
                slug = re.split("[?#]", url or "")[0].rstrip("/").rsplit("/", 1)[-1]
                named = text.placeholders(template or "", fields)
                m = re.search(text.compiled_pattern(template, fields, slug), page or "", re.S) if template else None
                values = dict(zip(named, m.groups(), strict=True)) if m else {}
                found.append([values.get(n) for n in names])
            yield pd.DataFrame({"url": rows["url"], **{n: [f[i] for f in found] for i, n in enumerate(names)}})

    return pages.join(templates, "domain", "left").select("url", "html", "template").mapInPandas(run, "url string, " + ", ".join(f"`{n}` string" for n in names))


def _match(pattern: str | None, slug: str, scripts: str) -> str | None:
    try:
        m = re.search(pattern.replace("{{SLUG}}", re.escape(slug)), scripts) if pattern else None
    except re.error:
        return None
    return (m[m.lastindex] if m.lastindex else m[0]) if m else None


class _Links(HTMLParser):
    """Links of a page with their text, position, depth and the nearest landmark around them."""

    def __init__(self) -> None:
        super().__init__()
        self.stack: list[str] = []
        self.found: list[list] = []
        self.open: list | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("br", "img", "meta", "link", "input", "hr"):
            return
        self.stack.append(tag)
        href = dict(attrs).get("href")
        if tag == "a" and href:
            self.open = [len(self.found), href, "", len(self.stack), next((t for t in reversed(self.stack) if t in ("nav", "header", "footer", "main", "aside", "article")), None)]
            self.found.append(self.open)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag == "a":
            self.open = None

    def handle_data(self, data: str) -> None:
        if self.open is not None:
            self.open[2] += data


def links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Links of pages (key, url, html): key, pos, href, url (in full), text (100 characters at most), depth, landmark; each (href, text) once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, base, page in zip(rows[key], rows["url"], rows["html"], strict=True):
                parser = _Links()
                parser.feed(page or "")
                out += [(k, base, pos, href, " ".join(t.split())[:100], depth, mark) for pos, href, t, depth, mark in parser.found]
            yield pd.DataFrame(out, columns=["key", "base", "pos", "href", "text", "depth", "landmark"])

    kind = pages.select(key).schema[0].dataType.simpleString()
    raw = pages.select(key, "url", "html").mapInPandas(run, f"key {kind}, base string, pos int, href string, text string, depth int, landmark string")
    first = raw.groupBy("key", "base", "href", "text").agg(F.min("pos").alias("pos"), F.min_by("depth", "pos").alias("depth"), F.min_by("landmark", "pos").alias("landmark"))
    return first.select(F.col("key").alias(key), "pos", "href", absolute(F.col("href"), F.col("base")).alias("url"), "text", "depth", "landmark")


def same_site(links_: DataFrame, base: Column) -> DataFrame:
    """Links of the same host, whatever its "www."."""
    bare = lambda u: F.regexp_replace(host(u), r"^www\.", "")
    return links_.where(bare(F.col("url")) == bare(base))


def images(pages: DataFrame, key: str = "page_id", most: int = 15) -> DataFrame:
    """Image addresses of pages from src, data-src, srcset, data-zoom and data-large: key, pos, url; each name before its first "_" once, the first `most` by position."""
    from pyspark.sql import Window

    found = F.regexp_extract_all("html", F.lit(r"""(?is)(?:data-src|data-zoom|data-large|srcset|src)=["']([^"']+\.(?:jpe?g|png|webp|gif)[^"']*)["']"""), F.lit(1))
    rows = pages.select(key, F.posexplode(found).alias("pos", "url"))
    stem = F.split_part(F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/"), -1), F.lit("_"), F.lit(1))
    first = rows.groupBy(key, stem.alias("stem")).agg(F.min("pos").alias("pos"), F.min_by("url", "pos").alias("url"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("rank") <= most).select(key, "pos", "url")


def by_relevance(found: DataFrame, page: str, score: str = "score", least: int = 1) -> DataFrame:
    """The images (page, pos, url, score) that score above `least`, in order of score, then of position, each file name once: with rank."""
    from pyspark.sql import Window

    stem = F.element_at(F.split(F.split_part("url", F.lit("?"), F.lit(1)), "/"), -1)
    best = found.where(F.col(score) > least).withColumn("_rank", F.row_number().over(Window.partitionBy(page, stem).orderBy(F.col(score).desc(), "pos"))).where("_rank = 1").drop("_rank")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.col(score).desc(), "pos")))


def relevance(alt: Column, linked: Column, container: Column, name: Column) -> Column:
    """How likely an image shows the product: its name in the alternative text 3, no link to elsewhere 1, a gallery around it 2."""
    return F.when(F.contains(F.lower(F.coalesce(alt, F.lit(""))), F.lower(name)), 3).otherwise(0) + F.when(linked, 0).otherwise(1) + F.when(F.lower(F.coalesce(container, F.lit(""))).rlike("gallery|carousel|product"), 2).otherwise(0)
