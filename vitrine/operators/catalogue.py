"""Queries of the catalogue: filters, search, sorts, paging, facets and counts over products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.urls import canonical


def resolve_brand(brands: DataFrame, wanted: str) -> DataFrame:
    """The brand a name means: exact; else equal without - and _; else equal without a trailing _tld; else the name itself. One row."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[-_]", "")
    stem = lambda c: F.regexp_replace(c, "_[a-z]+$", "")
    asked, own = F.lit(wanted), F.col("brand_id")
    rank = F.when(own == asked, 1).when(bare(own) == bare(asked), 2).when(bare(stem(own)) == bare(stem(asked)), 3)
    return brands.select(F.min(F.struct(rank.alias("rank"), own.alias("id"))).alias("all"), F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), own.alias("id")))).alias("best")).select(F.coalesce("best.id", asked).alias("brand_id"))


def search(products: DataFrame, text: str, *columns: str) -> DataFrame:
    """Products in which a column has the text, whatever its case; a null column has none."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return products.where(hit)


def full_text(products: DataFrame, text: str, *columns: str) -> DataFrame:
    """Products that have every word of the text, in any of the columns and any brand."""
    whole = F.lower(F.concat_ws(" ", *columns))
    for word in text.lower().split():
        products = products.where(F.contains(whole, F.lit(word)))
    return products


def filtered(products: DataFrame, *, brand: str | None = None, least: float | None = None, most: float | None = None, classification: str | None = None, attributes: dict[str, str] | None = None, variants: DataFrame | None = None, color: str | None = None, size: str | None = None) -> DataFrame:
    """All given filters together. Price bounds are inclusive; colour and size may each be met by any variant of the product."""
    tests: list[Column] = []
    if brand is not None:
        tests.append(F.col("brand_id") == brand)
    if least is not None:
        tests.append(F.col("price") >= least)
    if most is not None:
        tests.append(F.col("price") <= most)
    if classification is not None:
        tests.append(F.col("kind") == classification)
    tests += [F.col(k) == v for k, v in (attributes or {}).items()]
    for t in tests:
        products = products.where(t)
    for column, value in (("color", color), ("size", size)):
        if value is not None and variants is not None:
            products = products.join(variants.where(F.lower(column) == value.lower()).select("product_id"), "product_id", "left_semi")
    return products


def page(rows: DataFrame, order: list[Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of rows, with position, total (of all rows) and has_more. Only the page and a count leave the executors."""
    total = rows.agg(F.count("*").alias("total"))
    chosen = rows.orderBy(*order).offset(offset).limit(limit)
    numbered = chosen.withColumn("position", F.row_number().over(Window.orderBy(*order)) + offset)
    return numbered.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


SORTS = {
    "price_asc": [F.asc_nulls_last, "price"], "price_desc": [F.desc_nulls_last, "price"], "name": [F.asc_nulls_last, "name"],
}


def sort_key(name: str) -> list[Column]:
    """The order that a sort's name means; ties by product_id."""
    how, column = SORTS[name]
    key = F.lower("name") if column == "name" else F.col(column)
    direction = key.desc_nulls_last() if how is F.desc_nulls_last else key.asc_nulls_last()
    return [direction, F.col("product_id").asc()]


def price_of_text(text: Column) -> Column:
    """The number in a shown price; 0 where there is none."""
    return F.coalesce(F.regexp_replace(text, "[^0-9.]", "").try_cast("double"), F.lit(0.0))


def counts_of(products: DataFrame, *keys: str) -> DataFrame:
    return products.groupBy(*keys).agg(F.count("*").alias("products"))


def groups_with_samples(products: DataFrame, key: str, samples: int = 3) -> DataFrame:
    """Per value of key: its products and the first of them by id. Only the samples are kept while aggregating."""
    first = products.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("product_id"))).where(F.col("rank") <= samples)
    names = first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ";").alias("samples"))
    return counts_of(products, key).join(names, key)


def facets(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Values to filter by with the number of distinct products of each: facet, value, products; a null value is none."""
    own = products.select("product_id", F.explode(F.array(F.struct(F.lit("brand").alias("facet"), F.col("brand_id").alias("value")), F.struct(F.lit("category").alias("facet"), F.col("kind").alias("value")))).alias("f"))
    of_variants = variants.select("product_id", F.explode(F.array(F.struct(F.lit("color").alias("facet"), F.col("color").alias("value")), F.struct(F.lit("size").alias("facet"), F.col("size").alias("value")))).alias("f"))
    return own.union(of_variants).select("product_id", "f.*").where("value IS NOT NULL").groupBy("facet", "value").agg(F.countDistinct("product_id").alias("products"))


def price_range(products: DataFrame) -> DataFrame:
    return products.agg(F.min("price").alias("least"), F.max("price").alias("most"), F.count_distinct("brand_id").alias("brands"))


def in_category(products: DataFrame, category_urls: DataFrame, *urls: str) -> DataFrame:
    """Products one of whose URLs is, in canonical form, among the category's. Each URL is joined by itself, so both joins are hashed."""
    wanted = category_urls.select(canonical(F.col("url")).alias("key")).distinct()
    hits = None
    for u in urls:
        hit = products.withColumn("key", canonical(F.col(u))).join(wanted, "key", "left_semi").select("product_id")
        hits = hit if hits is None else hits.union(hit)
    return products.join(hits.distinct(), "product_id", "left_semi")


def extracted_counts(category_urls: DataFrame, products: DataFrame) -> DataFrame:
    """Per category, how many of its entries have an extracted product; categories without one are left out."""
    known = products.select(canonical(F.col("url")).alias("key")).distinct()
    return category_urls.withColumn("key", canonical(F.col("url"))).join(known, "key", "left_semi").groupBy("node_id").agg(F.count("*").alias("products"))


def is_stale(index_built: Column, files_changed: Column) -> Column:
    return F.coalesce(files_changed > index_built, F.lit(True))


def rebuild_index(products: DataFrame, variants: DataFrame, path: str) -> None:
    """Writes the query tables of a catalogue: products and variants partitioned by brand, so a brand's queries read its folder alone."""
    products.write.mode("overwrite").partitionBy("brand_id").parquet(f"{path}/products")
    variants.join(products.select("product_id", "brand_id"), "product_id").write.mode("overwrite").partitionBy("brand_id").parquet(f"{path}/product_variants")
    products.groupBy("brand_id").agg(F.count("*").alias("product_count")).write.mode("overwrite").parquet(f"{path}/index_metadata")


def trigrams(products: DataFrame, column: str = "name") -> DataFrame:
    """An index of three-letter runs: gram, product_id."""
    text = F.lower(column)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return products.select("product_id", F.explode(F.array_distinct(grams)).alias("gram"))


def search_by_trigrams(index: DataFrame, products: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Products whose column has the text: those that share all its runs, then checked. Shorter texts are looked for directly."""
    text = text.lower()
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    found = products.where(F.contains(F.lower(column), F.lit(text)))
    if not grams:
        return found
    candidates = index.where(F.col("gram").isin(grams)).groupBy("product_id").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("product_id")
    return found.join(candidates, "product_id", "left_semi")
