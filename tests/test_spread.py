"""Work that is heavy row by row goes to all tasks, and small files are no tasks of their own."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vitrine import plans
from vitrine.operators import extract, menus
from vitrine.plans import written_queries
from vitrine.shared import shared_path, spread
from vitrine.sources import brand_folders, sinks
from vitrine.streaming import rates, state


def test_spread(spark) -> None:
    rows = spread(spark.range(0, 100, 1, 1), "id")
    assert sorted(r["id"] for r in rows.collect()) == list(range(100)) and rows.rdd.getNumPartitions() == 4


def test_product_files_of_odd_keys(spark, tmp_path) -> None:
    """A key that comes twice or is null, or a null nation, loses no file."""
    rows = {"s_suppkey": [2, 2, 3, None, None], "s_name": list("abcde"), "s_nationkey": [1, 2, None, 5, None], "s_acctbal": [1.0, 2.0, 3.0, 4.0, 5.0]}
    pq.write_table(pa.table(rows, pa.schema([("s_suppkey", pa.int64()), ("s_name", pa.string()), ("s_nationkey", pa.int32()), ("s_acctbal", pa.float64())])), tmp_path / "supplier.parquet")
    found = sorted((r["name"], r["price"], r["images"], r["brand_id"], r["classification"]) for r in written_queries.product_files(spark, str(tmp_path)).collect())
    assert found == [("a", 1.0, 1, "acme", "kind=1"), ("b", 2.0, 1, "acme", "kind=2"), ("c", 3.0, 1, "nord", None), ("d", 4.0, 1, "nord", "kind=2"), ("e", 5.0, 1, "nord", None)]


def test_folders_share_partitions(spark) -> None:
    path = shared_path(spark, "many-folders")
    brand_folders.save_files(spark.range(0, 200, 1, 1).selectExpr("concat('b', id) AS brand_id", "'config.json' AS file", "'{\"strategy\": \"api\"}' AS body"), path)
    rows = brand_folders.read_brand_folders(spark, path)
    assert rows.rdd.getNumPartitions() <= brand_folders.FEW_PARTITIONS
    assert sorted(r["brand_id"] for r in rows.collect()) == sorted(f"b{i}" for i in range(200))


def test_tolerant_files_are_not_of_four_tasks(spark) -> None:
    """Every row is a file of its own, written by its task at once, with no side files that a commit moves one by one."""
    path = shared_path(spark, "small-files")
    brand_folders.save_files(spark.range(0, 50, 1, 1).selectExpr("'a/b' AS brand_id", "concat(id, '.json') AS file", "'{}' AS body"), path)
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(path)
    assert sorted(i.base_name for i in store.get_file_info(fs.FileSelector(f"{base}/a/b"))) == sorted(f"{i}.json" for i in range(50))


def test_a_line_goes_without_its_page(spark) -> None:
    """A line of a snapshot carries the few below it, not all lines of its page."""
    pages = spark.createDataFrame([(1, '- link "A"\n  - text\n- link:\n\n\n    - /url: /s/b-c\n- link "D"\n\n\n\n  - /url: /no\n- link "E" /url: /e'), (2, None), (3, "")], "doc_id long, snapshot string")
    found = menus.snapshot_links(pages)
    plan = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate posexplode" in line]
    assert plan and "lines#" not in plan[0]
    assert sorted((r["doc_id"], r["name"], r["url"], r["line_no"]) for r in found.collect()) == [(1, "B C", "/s/b-c", 2), (1, "E", "/e", 11)]


@pytest.mark.parametrize("name", ["template_products", "pattern_products", "api_products", "fuzzy_ranking"])
def test_heavy_rows_are_dealt(spark, name: str) -> None:
    df = plans.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == 4
    #: Nothing heavy comes before the dealing.
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("aggregate(" in line for line in plan[plan.index("RepartitionByExpression") :].splitlines())


def test_api_fields_of_odd_objects(spark) -> None:
    """An object that is null or no object is passed over; the top comes before objects, objects and names go in their order."""
    rows = [('{"product": null, "data": {"name": {"value": "n"}}, "item": 3}', "n"), ('{"title": "t", "product": {"name": "p"}}', "t"), ('{"payload": {"title": "x"}, "result": {"displayName": "d"}}', "d"), ("[1]", None), (None, None)]
    df = spark.createDataFrame(rows, "body string, want string")
    assert [r["name"] for r in df.select(extract.api_product(F.try_parse_json("body"))["name"].alias("name")).collect()] == [w for _, w in rows]


@pytest.mark.parametrize("name", ["subtree_products", "favourite_writes"])
def test_sets_stay_dealt(spark, name: str) -> None:
    """Every dealing of whole sets is of a given number of tasks."""
    df = plans.queries()[name](spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_insert_unique_is_one_aggregation(spark) -> None:
    """Null keys are equal; other columns come with the row that is inserted; nothing is joined."""
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, l string, v string")
    new = spark.createDataFrame([(1, None, "c"), (None, "x", "d"), (None, "x", "d"), (3, "y", None)], "k int, l string, v string")
    rows, outcome = sinks.insert_unique(old, new, ["k", "l"])
    assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in rows.collect()} == {(1, None, "a"), (2, "x", "b"), (None, "x", "d"), (3, "y", None)} and rows.count() == 4
    assert {tuple(r) for r in outcome.collect()} == {(1, None, False), (None, "x", True), (3, "y", True)} and outcome.count() == 3


def test_a_site_goes_out_in_blocks() -> None:
    """Rows of a site come in any order and go out in order, in blocks, by one limiter."""
    n = 2 * rates.BLOCK + 5
    whole = pd.DataFrame({"site": "s", "event_id": range(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta([i // 2 * 100 for i in range(n)], unit="ms"), "status": [rates.REFUSED if i % 97 == 0 else 200 for i in range(n)], "retry_after": [2.0 if i % 3 == 0 else None for i in range(n)]})
    mixed = whole.sample(frac=1, random_state=1)
    blocks = list(rates._advance(rates.Limiter(), "s", iter([mixed[:7000], mixed[7000:]])))
    assert [len(b) for b in blocks] == [rates.BLOCK, rates.BLOCK, 5]
    one, got = rates.Limiter(), pd.concat(blocks)
    want = [(i, one.step(t.timestamp(), s, None if pd.isna(r) else r), one.rate, one.tokens) for i, t, s, r in zip(whole["event_id"], whole["ts"], whole["status"], whole["retry_after"], strict=True)]
    assert [tuple(r) for r in got[["event_id", "wait", "rate", "tokens"]].itertuples(index=False)] == want and list(got["ts"]) == list(whole["ts"])


def test_a_barrier_looks_at_what_waits_once() -> None:
    """Not once a row: each look is a call to the state store."""
    barrier, looks = state._Barrier(2, None), []
    barrier.config = SimpleNamespace(get=lambda: ("1,2", 3.0))
    barrier.waiting = SimpleNamespace(exists=lambda: looks.append(1) or False)
    rows = [Row(key="k", item=i, discovery=False, value=1.0) for i in range(5)]
    assert [r["item"] for r in barrier.handleInputRows(("k",), iter(rows), None)] == list(range(5)) and len(looks) == 1
