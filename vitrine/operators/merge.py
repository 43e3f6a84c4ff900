"""Merging competing extractions of a product, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("name", "price", "currency", "description", "brand", "sku", "category")
#: Strategies from the cheapest to the dearest.
COSTS = {"shopify": 1, "ld_json": 2, "html_meta": 3, "api_intercept": 4, "embedded_json": 5, "llm_schema": 6}


def filled(value: Column, kind: str = "string") -> Column:
    return value.isNotNull() & (value != "") if kind == "string" else value.isNotNull()


def merge_by_score(results: DataFrame, fields: dict[str, str], designated: dict[str, str] | None = None) -> DataFrame:
    """One row per url of results (url, strategy, score, fields): each field from its designated strategy if that has it, else from the
    result of highest score that has it; ties by strategy. One aggregation, no sort."""
    out = []
    for name, kind in fields.items():
        has = filled(F.col(name), kind)
        order = F.struct((F.col("strategy") == (designated or {}).get(name, "")).alias("d"), F.col("score"), F.hex("strategy"))
        out.append(F.max_by(name, F.when(has, order)).alias(name))
    return results.groupBy("url").agg(*out, F.max_by("strategy", F.struct("score", F.hex("strategy"))).alias("strategy"))


def with_defaults(products: DataFrame) -> DataFrame:
    """Flags of what is missing, taken first, then empty values in its place."""
    flagged = products
    for c, test in (("name", filled(F.col("name"))), ("price", F.col("price").isNotNull()), ("currency", filled(F.col("currency"))), ("description", filled(F.col("description")))):
        flagged = flagged.withColumn(f"missing_{c}", ~test)
    return flagged.withColumns({"name": F.coalesce("name", F.lit("")), "price": F.coalesce("price", F.lit(0.0)), "currency": F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit("USD")), "description": F.coalesce("description", F.lit(""))})


def cheapest_sources(checks: DataFrame) -> DataFrame:
    """Per field of checks (field, strategy, passes), the cheapest strategy that agrees with the truth."""
    cost = F.try_element_at(F.create_map(*[F.lit(x) for p in COSTS.items() for x in p]), F.col("strategy"))
    return checks.where("passes").groupBy("field").agg(F.min_by("strategy", F.struct(F.coalesce(cost, F.lit(99)), F.col("strategy"))).alias("strategy"))


def minimal_strategies(contributions: DataFrame) -> DataFrame:
    """A greedy cover of each domain's contributions (domain, strategy, score, fields): by falling score, those that add a field, and what they add."""
    ordered = contributions.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "strategy", "fields"))).alias("all"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<strategy:string,added:array<string>>>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        new = F.array_sort(F.array_except(x["fields"], acc["seen"]))
        return F.when(F.size(new) > 0, F.struct(F.array_union(acc["seen"], new).alias("seen"), F.concat(acc["kept"], F.array(F.struct(x["strategy"].alias("strategy"), new.alias("added")))).alias("kept"))).otherwise(acc)

    kept = F.aggregate("all", start, step, lambda acc: acc["kept"])
    return ordered.select("domain", F.posexplode(kept).alias("rank", "k")).select("domain", "rank", "k.strategy", F.array_join("k.added", ";").alias("added"))


def active_strategies(field_sources: Column, contributions: Column) -> Column:
    """Those named as a field's source, if any is; else those that contribute a field."""
    named = F.array_sort(F.array_distinct(F.map_values(field_sources)))
    return F.when(F.size(field_sources) > 0, named).otherwise(F.array_sort(F.transform(F.filter(contributions, lambda c: F.size(c["fields"]) > 0), lambda c: c["strategy"])))


def merged_patterns(old: Column, new: Column) -> Column:
    """Both maps, the new one's values where they share a key."""
    kept = F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(kept, new)


def pattern_usage(uses: DataFrame) -> DataFrame:
    """Per selector of uses (pos, selector, products, lineage): its products, uses and lineages; the first one seen is the primary."""
    by = uses.groupBy("selector").agg(F.min("pos").alias("first"), F.sum("products").alias("products"), F.count("*").alias("uses"), F.count_distinct("lineage").alias("lineages"))
    return by.crossJoin(F.broadcast(uses.agg(F.min("pos").alias("_least")))).withColumn("is_primary", F.col("first") == F.col("_least")).drop("_least")


def availability_by_size(sizes: DataFrame, stock: DataFrame) -> DataFrame:
    """Sizes with their availability; of several rows of one id the last counts, and a size without any is unknown."""
    last = stock.groupBy("id").agg(F.max_by("available", "pos").alias("available"))
    return sizes.join(last, "id", "left")
