"""Records as they are served: brands, favourites, products, runs, reports and page differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.predicates import is_product_link
from vitrine.functions.urls import absolute
from vitrine.operators.ranking import positioned


def brand_record(brands: DataFrame) -> DataFrame:
    """brands (brand_id, unique_products, stage_1, stage_2, stage_3 run times) as records: a name from the id without its ending, the homepage, completed
    if there are products, and the run time of the latest stage that has one."""
    stem = F.regexp_replace("brand_id", "_(com|net|org|co|io|shop)$", "")
    return brands.select(
        "brand_id", F.initcap(F.regexp_replace(stem, "[_-]", " ")).alias("name"), F.concat(F.lit("https://"), F.replace("brand_id", F.lit("_"), F.lit("."))).alias("homepage_url"),
        F.when(F.coalesce("unique_products", F.lit(0)) > 0, "completed").otherwise("pending").alias("status"), F.coalesce("stage_3", "stage_2", "stage_1").alias("last_scrape_at"),
    )


def brand_id_of(domain: Column) -> Column:
    return F.replace(domain, F.lit("."), F.lit("_"))


def new_brands(brands: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (domain) with brand_id, whether it exists, and a default name for one that doesn't."""
    asked = wanted.withColumn("brand_id", brand_id_of(F.col("domain")))
    known = brands.select("brand_id", F.lit(True).alias("exists")).distinct()
    return asked.join(known, "brand_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False))).withColumn("name", F.when(~F.col("exists"), F.initcap(F.regexp_replace(F.regexp_replace("brand_id", "_[a-z]+$", ""), "[_-]", " "))))


def nested_favourites(rows: DataFrame) -> DataFrame:
    """Flat favourites as season, collection and look structs."""
    pick = lambda part: F.struct(*[F.col(c).alias(c.removeprefix(f"{part}_")) for c in rows.columns if c.startswith(f"{part}_")]).alias(part)
    return rows.select("id", *[pick(p) for p in ("season", "collection", "look")])


def favourite_places(nested: DataFrame) -> DataFrame:
    """nested_favourites' rows with their place among those of their season (by designer and look) and of their collection (by look)."""
    of_season = Window.partitionBy("season").orderBy("collection.designer", "look.number", "id")
    of_collection = Window.partitionBy("collection").orderBy("look.number", "id")
    return nested.withColumns({"by_season": F.row_number().over(of_season), "by_collection": F.row_number().over(of_collection)})


def with_existence(asked: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """asked with exists: whether its key is among the known rows."""
    found = known.select(*key).distinct().withColumn("exists", F.lit(True))
    return asked.join(found, key, "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def images_of(products: DataFrame, url: str) -> DataFrame:
    """The images of the product at a URL, in order: product_id, pos, image; no rows if there is none."""
    return products.where(F.col("url") == url).select("product_id", F.posexplode("images").alias("pos", "image"))


def attribute_values(variants: DataFrame, attribute: str) -> DataFrame:
    """The values of an attribute with the distinct products that have them, ranked."""
    by = variants.where(F.col(attribute).isNotNull()).groupBy(F.col(attribute).alias("value")).agg(F.count_distinct("product_id").alias("products"))
    return positioned(by, F.desc("products"), F.col("value"), name="rank").withColumn("rank", F.col("rank").cast("int"))


def report_lines(rows: DataFrame, name: str, numbers: list[str], width: int = 24) -> DataFrame:
    """Fixed-width lines of a table, a total last: pos, line."""
    total = rows.agg(F.lit("TOTAL").alias(name), *[F.sum(n).alias(n) for n in numbers]).withColumn("last", F.lit(1))
    both = rows.select(name, *numbers).withColumn("last", F.lit(0)).unionByName(total)
    line = F.concat(F.rpad(name, width, " "), *[F.lpad(F.coalesce(F.col(n).cast("string"), F.lit("")), 14, " ") for n in numbers])
    return both.select(F.row_number().over(Window.orderBy("last", name)).alias("pos"), line.alias("line"))


#: How many characters of each part a model is shown.
BUDGETS = {"response": 3000, "script": 5000, "text": 20_000, "html": 30_000}


def shaped_payload(parts: Column, kind: str) -> Column:
    """Parts in order, each numbered and cut to its budget, joined by blank lines."""
    most = BUDGETS[kind]
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("\n... [truncated]"))).otherwise(x)
    return F.array_join(F.transform(parts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), cut(x))), "\n\n")


def run_history(runs: DataFrame, key: str, start: str) -> DataFrame:
    """Runs of each key from the latest, numbered, with the time since the one before."""
    w = Window.partitionBy(key).orderBy(F.col(start).desc(), F.col("run_id").desc())
    return runs.withColumn("run_no", F.row_number().over(w)).withColumn("days_since", F.datediff(F.col(start), F.lead(start).over(w)))


def jobs_with_status(jobs: DataFrame, status: str | None) -> DataFrame:
    """Jobs from the newest, of one status if given, with how many there are of each after that filter."""
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    counted = rows.join(rows.groupBy("status").agg(F.count("*").alias("of_status")), "status")
    return positioned(counted, F.col("started").desc(), F.col("job_id").desc())


def fingerprint_matches(old: Column, new: Column, share: float = 0.7) -> Column:
    """Whether two sets of menu entries are one menu: the entries in both, against the larger set."""
    return F.size(F.array_intersect(old, new)) >= share * F.greatest(F.size(F.array_distinct(old)), F.size(F.array_distinct(new)), F.lit(1))


def new_lines(before: Column, after: Column) -> Column:
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_except(lines(after), lines(before))


def page_reacted(before: Column, after: Column) -> Column:
    """Whether an interaction changed a page: three new links or buttons, or ten new lines."""
    new = new_lines(before, after)
    return (F.size(F.filter(new, lambda x: x.rlike("^- (link|button)"))) >= 3) | (F.size(new) >= 10)


def menu_slice(before: Column, after: Column, context: int = 3) -> Column:
    """The part of a page that an opened menu added: its lines from `context` before the first new one."""
    lines, new = F.split(after, "\n"), new_lines(before, after)
    first = F.array_position(F.transform(lines, lambda x: F.trim(x)), F.get(new, F.lit(0)))
    return F.when(F.size(new) > 0, F.slice(lines, F.greatest(first - context, F.lit(1)).cast("int"), F.size(lines)))


def site_links_summary(links: DataFrame, key: str) -> DataFrame:
    """Per page, its links, those to products, and the estimate that follows from them."""
    by = links.groupBy(key).agg(F.count("*").alias("links"), F.count_if(is_product_link(F.col("url"))).alias("product_links"))
    return by.withColumn("scrapable", F.when(F.col("product_links") > 3, "high").otherwise("low")).withColumn("seconds", F.col("product_links") * 5)


def sample_product(pages: DataFrame, key: str) -> DataFrame:
    """The first product link of each page and the first image in it, else the first before it."""
    link = r"""(?is)<a[^>]*href=["']([^"']*/(?:products?|p)/[^"']+)["'][^>]*>(.*?)</a>"""
    image = r"""(?is)<img[^>]*(?:data-src|src)=["']([^"']+)["']"""
    href, inside = F.regexp_extract("html", link, 1), F.regexp_extract("html", link, 2)
    before = F.regexp_extract("html", r"""(?is)^(.*?)<a[^>]*href=["'][^"']*/(?:products?|p)/""", 1)
    found = F.coalesce(F.nullif(F.regexp_extract(inside, image, 1), F.lit("")), F.nullif(F.regexp_extract(before, image, 1), F.lit("")))
    return pages.where(href != "").select(key, absolute(href, F.col("url")).alias("product_url"), absolute(found, F.col("url")).alias("image_url"))


def products_by_attribute(products: DataFrame, attributes: Column, key: str, value: str | None = None) -> DataFrame:
    """Products whose attribute map has a key, or the key with a value."""
    test = F.map_contains_key(attributes, key) if value is None else F.try_element_at(attributes, F.lit(key)) == value
    return products.where(F.coalesce(test, F.lit(False)))


def in_classification(products: DataFrame, classifications: Column, name: str, kind: str | None = None) -> DataFrame:
    """Products one of whose classification structs (type, name) has the name, and the type if given."""
    return products.where(F.coalesce(F.exists(classifications, lambda c: (c["name"] == name) & (F.lit(kind is None) | (c["type"] == (kind or "")))), F.lit(False)))
