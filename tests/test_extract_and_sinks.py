from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrine.operators import catalogue, extract, joins, looks, merge, trees, usage
from vitrine.sources import catalogue as sources
from vitrine.sources import sinks

SHOP = {"product": {"title": "Ring", "vendor": "Acme", "body_html": "<p>Fine &amp; red</p>", "options": [{"name": "Color", "position": 1}, {"name": "Size", "position": 2}], "images": [{"src": "a.jpg"}], "variants": [{"option1": "red", "option2": "M", "sku": "s1", "price": "12.50", "inventory_quantity": 3}, {"option1": "red", "option2": "L", "sku": "s2", "price": "13", "available": False}]}}
GRAPH = {"data": {"product": {"title": "Ring", "priceRange": {"minVariantPrice": {"amount": "9.0", "currencyCode": "EUR"}}, "variants": {"edges": [{"node": {"title": "S / blue", "sku": "x", "availableForSale": True, "price": {"amount": "9"}, "selectedOptions": [{"name": "Size", "value": "S"}]}}]}}}}


def bodies(spark, *objects):
    return spark.createDataFrame([(i, json.dumps(o)) for i, o in enumerate(objects)], "id int, j string").select("id", F.parse_json("j").alias("body"))


def test_shop_and_graph(spark) -> None:
    r = bodies(spark, SHOP).select(*[c.alias(k) for k, c in extract.shop_product(F.col("body")).items()]).first()
    assert r["name"] == "Ring" and r["price"] == 12.5 and r["currency"] == "USD" and r["variants"][0]["size"] == "M" and r["variants"][0]["available"] is True and r["variants"][1]["available"] is False and r["images"] == ["a.jpg"]
    r = bodies(spark, GRAPH).select(*[c.alias(k) for k, c in extract.graph_product(F.col("body")).items()]).first()
    assert r["price"] == 9.0 and r["currency"] == "EUR" and r["variants"][0]["size"] == "S" and r["variants"][0]["color"] == "blue"


def test_linked_data_and_meta(spark) -> None:
    graph = json.dumps({"@graph": [{"@type": "Thing"}, {"@type": "Product", "name": "Ring", "brand": {"name": "Acme"}, "offers": [{"price": "5.0", "priceCurrency": "USD", "availability": "http://schema.org/InStock", "sku": "A-42"}]}]})
    page = f"""<title>Ring | Shop</title><meta content="Desc" property="og:description"><meta property="og:title" content="OG Ring"><script type="application/ld+json">{graph}</script><script type="application/ld+json">broken</script>"""
    pages = spark.createDataFrame([("u", page), ("v", "<title>Plain - Shop</title>"), ("w", None)], "url string, html string")
    found = {r["url"]: r for r in extract.linked_data(pages).collect()}
    assert list(found) == ["u"] and found["u"]["name"] == "Ring" and found["u"]["brand"] == "Acme" and found["u"]["price"] == 5.0 and found["u"]["variants"][0]["size"] == "42" and found["u"]["variants"][0]["available"] is True
    meta = {r["url"]: r for r in pages.select("url", *[c.alias(k) for k, c in extract.meta_fields(F.col("html")).items()]).collect()}
    assert meta["u"]["name"] == "OG Ring" and meta["u"]["description"] == "Desc" and meta["v"]["name"] == "Plain" and meta["w"]["name"] is None


def test_api_and_keys(spark) -> None:
    df = bodies(spark, {"data": {"product": {"title": {"value": "Ring"}, "currentPrice": {"amount": "7"}}}}, {"a": [{"price": 1}], "b": 2})
    r = df.where("id = 0").select(*[c.alias(k) for k, c in extract.api_product(F.col("body")).items()]).first()
    assert r["name"] == "Ring" and r["price"] == 7.0
    keys = {r["path"] for r in extract.keys_of(df.where("id = 1"), "id").collect()}
    assert {"a", "b", "a[0]", "a[0].price"} <= keys
    assert df.limit(1).select(extract.response_score(F.array(F.lit("price"), F.lit("x"), F.lit("skuId"))).alias("s")).first()["s"] == 20


def test_row_wise_paths_and_patterns(spark) -> None:
    pages = spark.createDataFrame([("d", "u1", [json.dumps({"x": 1}), json.dumps({"p": {"n": ["Ring"]}})]), ("e", "u2", ["{"])], "domain string, url string, responses array<string>")
    schemas = spark.createDataFrame([("d", {"name": "[2].p.n[0]", "currency": "USD", "any": "p.n"})], "domain string, paths map<string,string>")
    got = {r["url"]: r for r in extract.by_schema(pages, schemas, ["name", "currency", "any"]).collect()}
    assert got["u1"]["name"] == "Ring" and got["u1"]["currency"] == "USD" and got["u1"]["any"] == "['Ring']" and got["u2"]["name"] is None
    html = "<script>var other = {title: 'No'}</script><script>var red_ring = {title: 'Ring', price: 5}</script>"
    pages = spark.createDataFrame([("d", "https://x/products/red-ring?a=1", html)], "domain string, url string, html string")
    patterns = spark.createDataFrame([("d", {"title": "title: '([^']*)'", "price": r"price: (\d+)", "bad": "("})], "domain string, patterns map<string,string>")
    r = extract.by_patterns(pages, patterns, ["title", "price", "bad"]).first()
    assert r["title"] == "Ring" and r["price"] == "5" and r["bad"] is None


def test_links_and_images(spark) -> None:
    html = '<nav><a href="/a">A <b>x</b></a><a href="/a">A x</a></nav><main><a href="b">B</a><img src="r_1.jpg"><img data-src="r_2.jpg"><img src="s.png"></main>'
    pages = spark.createDataFrame([(1, "https://x.com/c/d", html), (2, "https://x.com/", None)], "page_id long, url string, html string")
    rows = sorted(extract.links(pages).collect(), key=lambda r: r["pos"])
    assert [(r["url"], r["text"], r["landmark"]) for r in rows] == [("https://x.com/a", "A x", "nav"), ("https://x.com/c/b", "B", "main")]
    assert [r["url"] for r in sorted(extract.images(pages).collect(), key=lambda r: r["pos"])] == ["r_1.jpg", "s.png"]


def test_merge_and_cover(spark) -> None:
    c = spark.createDataFrame([("d", "a", 5, ["name", "price"]), ("d", "b", 9, ["name"]), ("d", "c", 1, ["name"])], "domain string, strategy string, score int, fields array<string>")
    rows = sorted(merge.minimal_strategies(c).collect(), key=lambda r: r["rank"])
    assert [(r["strategy"], r["added"]) for r in rows] == [("b", "name"), ("a", "price")]
    r = spark.range(1).select(merge.merged_patterns(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("9"))).alias("m")).first()
    assert r["m"] == {"a": "9", "b": "2"}
    r = spark.createDataFrame([("p", 1, 5, "n", None), ("p", 2, 5, None, 3.0)], "page_url string, response_no int, score int, name string, price double")
    assert tuple(extract.merged_responses(r, {"name": "string", "price": "double"}).first()) == ("p", "n", 3.0)


def test_trees(spark) -> None:
    nodes = spark.createDataFrame([("a", None, 0, "Root", "https://x/"), ("b", "a", 0, "All", "https://x/b"), ("c", "a", 1, "C", "https://x/c")], "node_id string, parent_id string, ordinal long, name string, url string")
    assert {r["node_id"] for r in trees.collapsed(nodes).where("parent_id IS NULL").collect()} == {"b", "c"}
    assert trees.without_homepages(nodes, "https://x/").count() == 3
    more = nodes.union(spark.createDataFrame([("d", None, 1, "Other", "https://x/d")], nodes.schema))
    assert {r["node_id"] for r in trees.without_homepages(more, "https://x/").collect()} == {"d"}
    assert {r["name"]: r["url"] for r in trees.url_map(nodes).collect()}["C"] == "https://x/c"
    empty = nodes.where("false")
    assert trees.with_paths(empty).count() == 0 and trees.counts(empty).first()["nodes"] == 0


def test_product_files(spark, tmp_path: Path) -> None:
    for place, name in (("acme/products/new/in", "a"), ("acme/products", "b"), ("zed/products/x", "c")):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / f"{name}.json").write_text(json.dumps({"name": name, "price": 1.5, "variants": [{"size": "M"}]}, indent=1))
    (tmp_path / "acme/nav.json").write_text("[1]")
    rows = {r["name"]: r for r in sources.read_product_files(spark, f"{tmp_path}/*/products").collect()}
    assert rows["a"]["brand_id"] == "acme" and rows["a"]["classification"] == "new/in" and rows["b"]["classification"] is None and rows["c"]["brand_id"] == "zed" and rows["a"]["variants"][0]["size"] == "M"
    assert [r["brand_id"] for r in sources.list_brands(spark, str(tmp_path)).collect()] == ["acme"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text("{")
    assert sources.read_documents(spark, str(tmp_path / "bad")).first()["body"] is None
    with pytest.raises(Exception):
        sources.read_product_files(spark, str(tmp_path / "bad")).collect()


def test_sinks(spark, tmp_path: Path) -> None:
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, name string, at int")
    new = spark.createDataFrame([(2, "B", 2), (3, "c", 2)], "id int, name string, at int")
    assert {r["id"]: r["name"] for r in sinks.upserted(old, new, ["id"], "at").collect()} == {1: "a", 2: "B", 3: "c"}
    rows, outcome = sinks.insert_unique(old, new, ["id"])
    assert rows.count() == 3 and {r["id"]: r["inserted"] for r in outcome.collect()} == {2: False, 3: True}
    assert sinks.delete(old, new, ["id"]).count() == 1
    changes = spark.createDataFrame([(1, None, 9)], "id int, name string, at int")
    assert {r["id"]: (r["name"], r["at"]) for r in sinks.updated(old, changes, "id").collect()} == {1: ("a", 9), 2: ("b", 1)}
    users = spark.createDataFrame([(1, "user_007", True)], "user_id int, user_folder string, is_active boolean")
    assert sinks.next_folder(users).first()[0] == "user_008" and sinks.next_folder(users.where("false")).first()[0] == "user_001"
    version = sinks.replace_table(spark, old, str(tmp_path / "t"))
    assert spark.read.parquet(version).count() == 2
    sinks.write_csv(old.withColumn("tags", F.array(F.lit("x"), F.lit("y"))), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["tags"] == "x;y"
    files = spark.createDataFrame([("nav.json",), ("products/a.json",), ("brand_meta.json",)], "name string")
    assert {r["name"] for r in sinks.kept_artifacts(files, [1, 3]).collect()} == {"brand_meta.json"}
    assert spark.range(1).select(sinks.product_path(F.lit("c"), F.lit(None).cast("string"), F.lit("Red Ring!"))).first()[0] == "products/c/red-ring.json"
    catalogue.rebuild_index(spark.createDataFrame([(1, "b", "n", 1.0)], "product_id int, brand_id string, name string, price double"), spark.createDataFrame([(1, "M")], "product_id int, size string"), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/index_metadata")).first()["product_count"] == 1


def test_nearest_above_at_any_indent(spark) -> None:
    rng = random.Random(1)
    rows = [(doc, k, rng.choice([None, *range(-1, 60)]), f"x{k}") for doc in (1, 2, None) for k in range(150)]
    want = {(d, k): max((j for e, j, other, _ in rows if e == d and j < k and i is not None and other is not None and other < i), default=None) for d, k, i, _ in rows}
    lines = spark.createDataFrame(rows, "doc_id long, line_no long, indent int, kind string")
    out = joins.nearest_above(lines)
    assert out.columns == [*lines.columns, "parent_line"] and {(r["doc_id"], r["line_no"]): r["parent_line"] for r in out.collect()} == want
    deep = spark.createDataFrame([(1, k, 2 * k, "x") for k in range(40)], lines.schema)
    assert {r["line_no"]: r["parent_line"] for r in joins.nearest_above(deep).collect()} == {k: k - 1 if k else None for k in range(40)}


def test_small_operators(spark) -> None:
    lines = spark.createDataFrame([(1, 1, 0, "heading", "H"), (1, 2, 2, "link", "L"), (1, 3, 0, "link", "M")], "doc_id int, line_no int, indent int, kind string, text string")
    assert {r["line_no"]: r["parent_line"] for r in joins.nearest_above(lines).collect()} == {1: None, 2: 1, 3: None}
    r = spark.range(1).select(usage.direction(F.lit(1.2), F.lit(1.0)).alias("a"), usage.direction(F.lit(1.01), F.lit(1.0)).alias("b")).first()
    assert tuple(r) == ("up", "steady")
    files = spark.createDataFrame([("f", 1, "x", "s", 2020), ("f", 2, "x", "s", 2021), ("f", 3, "y", "t", 2021)], "folder string, pos int, designer string, season string, year int")
    assert {r["pos"]: r["group_no"] for r in looks.similarity_groups(files).collect()} == {1: 0, 2: 0, 3: 1}
