"""Listing pages, brand folders and the sink of frames."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vitrine.shared import shared_path
from vitrine.sources import brand_folders, listings
from vitrine.streaming import frames

GRID = """<html><body><div id="main" class="page wide"><ul class="grid two"><li class="item first"><a href="/products/red-wool-coat?x=1"><img src="/i/a.jpg" alt="Coat A"><img data-srcset="/i/b.webp 1x, /i/c.webp 2x"><img src="/icons/x.svg"></a><p class="name">The  red
 coat</p></li><li class="item"><a href="/products/4f3a"><img src="data:x" data-src="/i/d.png" alt="By alt"></a><h3 class="name">By <b>selector</b></h3></li><li class="item"><a href="/products/red-wool-coat?x=1"><img src="/i/e.jpg"><img src="/i/a.jpg"></a></li><li class="item"><span>No link</span></li><li class="item"><a href="/p/ab"><img src="/i/f.jpg" alt=" Alt only "></a></li><li class="other"><a href="/products/elsewhere">x</a></li></ul></div></body></html>"""


def test_listing(spark) -> None:
    pages = spark.createDataFrame([(1, GRID), (2, None), (3, "<ul class=grid><li class=item>broken <a href=/products/BigBlueHat")], "page_id int, html string")
    got = {(r["page_id"], r["pos"]): (r["href"], r["name"], r["images"], r["lineage"]) for r in listings.listing_products(pages, "ul.grid li.item", "a", ".name").collect()}
    lineage = "div.page.wide#main > ul.grid.two > li.item"
    assert got == {
        (1, 0): ("/products/red-wool-coat?x=1", "Red Wool Coat", ["/i/a.jpg", "/i/b.webp", "/i/e.jpg"], lineage + ".first"),
        (1, 1): ("/products/4f3a", "By selector", ["/i/d.png"], lineage),
        (1, 2): ("/p/ab", "Alt only", ["/i/f.jpg"], lineage),
    }
    assert listings.name_of_url("/x/BigBlueHat.jpg") == "Big Blue Hat" and listings.name_of_url("/x/SALE") == listings.UNKNOWN
    by_sql = spark.sql("SELECT l.href FROM {p} p, LATERAL listing_products(p.html, 'li.other a', 'li.other a', '') l", p=pages).collect()
    assert [r["href"] for r in by_sql] == ["/products/elsewhere"]
    with pytest.raises(Exception, match="container"):
        listings.listing_products(pages, " ").collect()


def put(path: str, files: dict[str, str]) -> None:
    for name, text in files.items():
        file = Path(path.removeprefix("file://"), name)
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)


def test_brand_folders(spark) -> None:
    path = shared_path(spark, "brands")
    new = {"domain": "a.com", "contributions": [{"strategy": "json", "fields": ["price", "name"], "score": 80}, {"strategy": "html", "fields": [], "score": None}], "verified": True, "discovery_url": "u"}
    put(path, {"a_com/config.json": json.dumps(new), "a_com/gallery.json": json.dumps({"gallery_selector": ".g"}), "b_com/config.json": json.dumps({"strategy": "api"}), "b_com/gallery.json": json.dumps({"image_selector": "img", "url_attribute": "data-src", "container_selector": ".c"})})
    put(path, {"c_com/config.json": "{broken", "d_com/other.json": "{}", "e_com/config.json": json.dumps({"neither": 1}), "f_com/config.json": "[1]"})
    rows = {r["brand_id"]: r for r in brand_folders.read_brand_folders(spark, path).collect()}
    assert sorted(rows) == ["a_com", "b_com", "c_com", "e_com", "f_com"]
    a, b = rows["a_com"], rows["b_com"]
    assert [tuple(c) for c in a["contributions"]] == [("json", ["name", "price"], 80.0), ("html", [], 0.0)] and a["migrated"] and (a["image_selector"], a["url_attribute"], a["container_selector"]) == ("", "src", ".g")
    assert (b["domain"], b["contributions"][0]["strategy"], sorted(b["contributions"][0]["fields"]), b["verified"], b["migrated"], b["url_attribute"]) == ("b.com", "api", sorted(brand_folders.TRACKED_FIELDS), False, True, "data-src")
    assert rows["c_com"]["error"] and rows["c_com"]["contributions"] is None and rows["e_com"]["contributions"] is None and rows["e_com"]["error"] is None
    assert brand_folders.read_brand_folders(spark, shared_path(spark, "nowhere")).count() == 0


def test_a_filter_opens_one_folder(spark) -> None:
    path = shared_path(spark, "brands")
    put(path, {f"b{i}/config.json": json.dumps({"strategy": "api"}) for i in range(30)})
    one = brand_folders.read_brand_folders(spark, path).where("brand_id = 'b7'")
    assert one.rdd.getNumPartitions() == 1 and [r["brand_id"] for r in one.collect()] == ["b7"]
    few = brand_folders.read_brand_folders(spark, path).where(F.col("brand_id").isin("b7", "b9", "none"))
    assert few.rdd.getNumPartitions() == 2 and few.count() == 2
    assert brand_folders.read_brand_folders(spark, path).where("NOT verified").count() == 30


def test_frames_once_and_in_order(spark) -> None:
    """A stream that is stopped, whose epoch is then run again, gives each frame once; a late listener reads them all."""
    source, sink, checkpoint = (shared_path(spark, x) for x in ("rows", "frames", "checkpoint"))
    for part in range(3):
        spark.range(part * 50, part * 50 + 50).selectExpr("id AS seq", "concat('data: ', id) AS frame").coalesce(2).write.mode("append").parquet(source)
        frames.emit(spark.readStream.schema("seq long, frame string").option("maxFilesPerTrigger", 1).parquet(source), sink, checkpoint).awaitTermination()
    want = [(i, f"data: {i}") for i in range(150)]
    read = lambda: [(r["seq"], r["frame"]) for r in frames.heard(spark, sink).orderBy("epoch", "seq").collect()]
    assert sorted(read()) == want
    last = frames.heard(spark, sink).agg(F.max("epoch")).first()[0]
    before = frames.heard(spark, sink).where(F.col("epoch") == last).count()
    Path(checkpoint.removeprefix("file://"), "commits", str(last)).unlink()
    Path(checkpoint.removeprefix("file://"), "commits", f".{last}.crc").unlink(missing_ok=True)
    frames.emit(spark.readStream.schema("seq long, frame string").option("maxFilesPerTrigger", 1).parquet(source), sink, checkpoint).awaitTermination()
    assert sorted(read()) == want and frames.heard(spark, sink, last - 1).where(F.col("epoch") == last).count() == before
    stray = Path(sink.removeprefix("file://"), "frames", "stray.json")
    stray.write_text('{"seq": 999, "frame": "of a failed attempt"}\n')
    assert sorted(read()) == want
