"""Tables that change by partition, stored indexes and stored orders."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from vitrine.operators import inverted, pages
from vitrine.shared import shared_path
from vitrine.sources import versions

COLUMNS = "brand string, id long, name string, at long"


def rows_of(df, *columns: str) -> list[tuple]:
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_a_change_of_one_brand_writes_one_folder(spark) -> None:
    path = shared_path(spark, "versions")
    assert versions.snapshot(spark, path) is None
    first = spark.createDataFrame([(b, i, f"{b}{i}", 0) for b in ("a b", "c%d", "e=f") for i in range(4)], COLUMNS)
    assert versions.upsert(spark, path, first, "brand", ["id"], "at") == ["a b", "c%d", "e=f"]
    change = spark.createDataFrame([("c%d", 1, "new", 1), ("c%d", 9, "more", 1), ("c%d", 2, "older", -1)], COLUMNS)
    assert versions.upsert(spark, path, change, "brand", ["id"], "at") == ["c%d"]
    folders = lambda v: {r["value"]: r["folder"] for r in versions.manifest(spark, path, v).collect() if r["value"]}
    before, after = folders(1), folders(2)
    assert {b for b in after if after[b] != before[b]} == {"c%d"}
    assert rows_of(versions.snapshot(spark, path, values=["c%d"]), "id", "name") == [(0, "c%d0"), (1, "new"), (2, "c%d2"), (3, "c%d3"), (9, "more")]
    assert rows_of(versions.snapshot(spark, path, version=1), "brand", "id", "name", "at") == rows_of(first, "brand", "id", "name", "at")
    opened = versions.snapshot(spark, path, values=["a b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in opened and versions.snapshot(spark, path, values=["a b"]).select(F.input_file_name()).distinct().count() == 1


def test_an_interrupted_write_leaves_the_old_version(spark) -> None:
    path = shared_path(spark, "versions")
    versions.replace(spark, path, spark.createDataFrame([("a", 1, "x", 0), ("b", 2, "y", 0)], COLUMNS), "brand")
    broken = spark.createDataFrame([("a", 1, "z", 1)], COLUMNS).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        versions.replace(spark, path, broken, "brand")
    assert rows_of(versions.snapshot(spark, path), "brand", "name") == [("a", "x"), ("b", "y")]
    with pytest.raises(ValueError, match="value"):
        versions.replace(spark, path, spark.createDataFrame([(None, 1, "z", 1)], COLUMNS), "brand")
    with pytest.raises(ValueError, match="version 7"):
        versions.snapshot(spark, path, version=7)


def test_two_writers(spark) -> None:
    """A writer that another one has overtaken is told, and what the other wrote stands."""
    path = shared_path(spark, "versions")
    rows = lambda name: spark.createDataFrame([("a", 1, name, 0)], COLUMNS)
    versions.replace(spark, path, rows("old"), "brand")

    def slow(old, new):  # noqa: ANN001, ANN202
        versions.replace(spark, path, rows("fast"), "brand")
        return new

    with pytest.raises(versions.VersionConflict):
        versions.rewrite(spark, path, rows("slow"), slow, "brand")
    assert rows_of(versions.snapshot(spark, path), "name") == [("fast",)]


def test_inserts_removals_and_changes(spark) -> None:
    path = shared_path(spark, "versions")
    versions.insert(spark, path, spark.createDataFrame([("a", 1, "x", 0), ("a", 1, "x", 0), ("b", 1, "y", 0)], COLUMNS), "brand", ["id"])
    versions.insert(spark, path, spark.createDataFrame([("a", 1, "taken", 0), ("a", 2, "free", 0)], COLUMNS), "brand", ["id"])
    assert rows_of(versions.snapshot(spark, path), "brand", "id", "name") == [("a", 1, "x"), ("a", 2, "free"), ("b", 1, "y")]
    versions.change(spark, path, spark.createDataFrame([("a", 2, "noted", None), ("a", 7, "nobody", 1)], COLUMNS), "brand", "id")
    assert rows_of(versions.snapshot(spark, path), "brand", "id", "name", "at") == [("a", 1, "x", 0), ("a", 2, "noted", 0), ("b", 1, "y", 0)]
    versions.remove(spark, path, spark.createDataFrame([("b", 1), ("a", 1)], "brand string, id long"), "brand", ["id"])
    assert rows_of(versions.snapshot(spark, path), "brand", "id") == [("a", 2)]
    assert {r["value"] for r in versions.manifest(spark, path).collect()} == {"a", None}
    versions.remove(spark, path, spark.createDataFrame([("a", 2)], "brand string, id long"), "brand", ["id"])
    assert versions.snapshot(spark, path).count() == 0


NAMES = ["red widget", "blue bolt", "Covered red-hot ring", "RED", "", None, "öl ring", "a", "ab", "abc abc", "x_y 12", "ring ring"]


@pytest.fixture(scope="module")
def goods(spark):  # noqa: ANN001, ANN201
    rng = random.Random(6)
    rows = [(i, NAMES[i % len(NAMES)], rng.choice(["PROMO", "small", None])) for i in range(9000, 9300)] + [(None, "red ring", "PROMO"), (5, "red widget", "PROMO"), (2**40, "Red Ring", "promo")]
    return rows, spark.createDataFrame(rows, "product_id long, name string, kind string")


def has_words(row: tuple, text: str) -> bool:
    own = set(re.findall(r"[^\W_]+", f"{row[1] or ''}\n{row[2] or ''}".lower()))
    wanted = re.findall(r"[^\W_]+", text.lower())
    return row[0] is not None and bool(wanted) and own.issuperset(wanted)


def test_words(spark, goods, monkeypatch) -> None:
    monkeypatch.setattr(inverted, "RANGE", 32)
    rows, df = goods
    path = shared_path(spark, "words")
    inverted.add(path, df, inverted.words, "name", "kind")
    for text in ("red", "RED promo", "ring red hot", "covered", "cover", "", "öl", "12 x", "nothing", "red nothing"):
        assert rows_of(inverted.with_words(spark, path, text), "product_id") == sorted((r[0],) for r in rows if has_words(r, text)), text
    plan = inverted.holding(spark, path, ["red"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [" in plan and "token" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_batches(spark, goods) -> None:
    """A batch adds rows, replaces rows of its keys, and removes rows; nothing that is there is written again."""
    rows, df = goods
    path = shared_path(spark, "words")
    inverted.add(path, df, inverted.words, "name", "kind")
    batch = [(9000, "green ring", "PROMO"), (9001, "red", None), (1, "red gem", "x")]
    inverted.add(path, spark.createDataFrame(batch, "product_id long, name string, kind string"), inverted.words, "name", "kind", removed=spark.createDataFrame([(9003,), (9004,), (None,)], "product_id long"))
    inverted.add(path, spark.createDataFrame([(9003, "red again", None)], "product_id long, name string, kind string"), inverted.words, "name", "kind")
    now = {r[0]: r for r in rows if r[0] is not None} | {r[0]: r for r in batch}
    del now[9003], now[9004]
    now[9003] = (9003, "red again", None)
    for text in ("red", "ring", "red widget", "green"):
        assert rows_of(inverted.with_words(spark, path, text), "product_id", "name") == sorted((r[0], r[1]) for r in now.values() if has_words(r, text)), text


@pytest.mark.parametrize("text", ["r", "ed", "red", "Red W", "ring", " öl ", "-h", "zzz", "abca", "bc a", "y 1", ""])
def test_letter_runs(spark, goods, text: str) -> None:
    rows, df = goods
    path = shared_path(spark, "runs")
    inverted.add(path, df, inverted.runs, "name")
    t = text.strip().lower()
    assert rows_of(inverted.with_part(spark, path, text, "name"), "product_id") == sorted((r[0],) for r in rows if r[0] is not None and t and t in (r[1] or "").lower())


def test_pages(spark) -> None:
    rng = random.Random(1)
    keys = [(i, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(1000)]
    path = shared_path(spark, "pages")
    pages.store_order(spark.createDataFrame(keys, "id long, price double"), path, F.col("price").desc_nulls_last(), F.col("id"), range_rows=64)
    order = sorted(keys, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for offset, limit in ((0, 50), (60, 10), (990, 50), (1000, 5), (5000, 5), (63, 2), (0, 1000)):
        got = sorted((r["position"], r["id"], r["total"], r["has_more"]) for r in pages.stored_page(spark, path, offset, limit, range_rows=64).collect())
        assert got == [(offset + k + 1, r[0], 1000, offset + limit < 1000) for k, r in enumerate(order[offset : offset + limit])]
    last = pages.numbered_page(spark, path, 34, 30, range_rows=64).collect()
    assert len(last) == 10 and last[0]["pages"] == 34 and not last[0]["has_next"] and last[0]["has_prev"] and pages.numbered_page(spark, path, 35, 30, range_rows=64).count() == 0
    assert [r["id"] for r in pages.page_after(spark, path, 100, 5, range_rows=64).orderBy("position").collect()] == [r[0] for r in order[100:105]]
    deep = pages.stored_page(spark, path, 900, 10, range_rows=64)
    assert deep.select(F.input_file_name()).distinct().count() == 1
    empty = shared_path(spark, "pages")
    pages.store_order(spark.createDataFrame([], "id long, price double"), empty, F.col("id"))
    assert pages.stored_page(spark, empty).count() == 0
