"""Approximate search, pools and scores against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vitrine.functions import predicates
from vitrine.operators import extract, joins, looks, ranking, usage


def fewest(text: str, pattern: str) -> int:
    """Edits of the pattern against the best part of the text, by the usual table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


@pytest.mark.parametrize("pattern", ["a", "ab", "abcab", "öxö日", "aaaa", "b" * 62])
def test_least_errors(spark, pattern: str) -> None:
    rng = random.Random(len(pattern))
    texts = ["".join(rng.choices("abcöx日", k=rng.randrange(0, 30))) for _ in range(150)] + [pattern, pattern.upper(), "", pattern[1:], "z" + pattern[:-1] + "zz"]
    most = 3
    got = [r["e"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ranking.least_errors(F.col("t"), pattern, most).alias("e")).orderBy("i").collect()]
    want = [fewest(t.lower(), pattern) for t in texts]
    assert got == [w if w <= min(most, len(pattern)) else None for w in want]


def test_fuzzy_ranked(spark) -> None:
    rows = spark.createDataFrame([(1, "Silver Sunglasses", None), (2, None, "sunglases"), (3, "Hat", "Wool"), (4, None, None)], "id int, name string, kind string")
    got = {r["id"]: round(r["score"], 6) for r in ranking.fuzzy_ranked(rows, "sunglasses", {"name": 3.0, "kind": 1.0}).collect()}
    assert got == {1: 0.75, 2: 0.225} and ranking.fuzzy_ranked(rows, "sunglasses", {"name": 1.0}).columns == ["id", "name", "kind", "score"]
    with pytest.raises(ValueError):
        ranking.least_errors(F.col("name"), "x" * 63, 1)


def test_pools(spark) -> None:
    rng = random.Random(9)
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    uses = [(k % 3, a := rng.randrange(0, 20_000), a + rng.choice([0, 10, 3600, 9000])) for k in range(200)]
    rows = [(p, at(a), at(b)) for p, a, b in uses] + [(0, None, at(5)), (1, at(9), at(3)), (7, at(4), at(4))]
    got = {r["pool"]: r for r in usage.pool_statistics(spark.createDataFrame(rows, "pool int, start timestamp, end timestamp"), 10, width_seconds=1800).collect()}
    for pool in range(3):
        own = [(a, b) for p, a, b in uses if p == pool]
        peak = max(sum(a <= t < b for a, b in own) for t, _ in own)
        assert (got[pool]["served"], got[pool]["peak"], got[pool]["available_at_peak"], got[pool]["busy_seconds"]) == (len(own), peak, 10 - peak, float(sum(b - a for a, b in own)))
    assert (got[7]["served"], got[7]["peak"]) == (1, 0)


def test_paths_of_products(spark) -> None:
    body = '{"a":{"b":{"c":{"d":{"price":1,"e":{"price":2}}}}},"title":[[{"x":[{"sku":1}]},{"color":2}]],"none":null,"empty":[],"Size.x":1}'
    rows = spark.createDataFrame([(1, body), (2, "[]"), (3, None)], "id int, j string").select("id", F.parse_json("j").alias("body"))
    got = sorted((r["id"], r["path"]) for r in extract.product_paths(rows, "id").collect())
    assert got == [(1, "Size.x"), (1, "a.b.c.d.price"), (1, "title"), (1, "title[0][0].x[0].sku")]


def test_parents_that_open(spark) -> None:
    lines = [("button", 4), ("link", 2), ("link", 6), ("button", 2), ("link", 6), ("tab", 6), ("link", 6), ("link", 8), ("text", 0), ("link", None)]
    rows = spark.createDataFrame([(1, i, indent, kind) for i, (kind, indent) in enumerate(lines)], "doc_id int, line_no int, indent int, kind string")
    got = {r["line_no"]: r["parent_line"] for r in joins.expandable_above(rows).collect()}
    assert got == {0: None, 1: None, 2: 0, 3: None, 4: 3, 5: 3, 6: 3, 7: 5, 8: None, 9: None}


def test_scores(spark) -> None:
    rows = spark.createDataFrame([("ab", "12", ["x"] * 5, "long enough text"), ("a", "0", [], "short"), (None, None, None, None), ("abc", "0.0", ["x"], None)], "name string, price string, images array<string>, description string")
    assert [r[0] for r in rows.select(predicates.benchmark_score(*(F.col(c) for c in rows.columns))).collect()] == [100, 0, 0, 40]


def test_templates(spark) -> None:
    rows = [("a", "https://x.com/p/big-hat?c=1", "x {name:'Big Hat', sku: 12} {id:'big hat',name: 'A.B*', sku:7}"), ("a", "https://x.com/p/none", "{id:'big hat', name:'x', sku:1}"), ("b", "https://x.com/p/big-hat", "{id:'big hat'}"), ("c", None, None)]
    pages = spark.createDataFrame(rows, "domain string, url string, html string")
    templates = spark.createDataFrame([("a", "{id:'{{SLUG}}', name: '{name}', sku: {sku}}"), ("b", "{other}{{SLUG}}"), ("c", None)], "domain string, template string")
    got = sorted(((r["url"] or "", r["name"], r["sku"], r["more"]) for r in extract.by_templates(pages, templates, {"name": "[^']*", "sku": r"\d+", "more": ".*"}).collect()), key=str)
    assert got == sorted([("https://x.com/p/big-hat?c=1", "A.B*", "7", None), ("https://x.com/p/none", None, None, None), ("https://x.com/p/big-hat", None, None, None), ("", None, None, None)], key=str)


def test_similarity_groups_by_nested_loop(spark) -> None:
    """Against a loop over all files of a folder, with names, seasons and years of which at least two are known."""
    rng = random.Random(8)
    rows = []
    for folder in ("f", "g", "h"):
        for pos in range(60):
            v = [rng.choice(["ann", "bo", "cy"]), rng.choice(["fall", "spring"]), rng.choice([2020, 2021])]
            if rng.random() < 0.3:
                v[rng.randrange(3)] = None
            rows.append((folder, pos, *v))
    got = {(r["folder"], r["pos"]): r["group_no"] for r in looks.similarity_groups(spark.createDataFrame(rows, "folder string, pos int, designer string, season string, year int")).collect()}
    for folder in ("f", "g", "h"):
        seeds: list[tuple] = []
        for r in sorted(r for r in rows if r[0] == folder):
            hit = next((k for k, s in enumerate(seeds) if sum(a is not None and a == b for a, b in zip(r[2:], s, strict=True)) >= 2), None)
            if hit is None:
                hit = len(seeds)
                seeds.append(r[2:])
            assert got[folder, r[1]] == hit
    few = [("f", 1, "ann", None, None), ("f", 0, "ann", None, None), ("f", 2, "bo", "fall", None), ("f", 3, "bo", "fall", None), ("g", 0, None, None, None)]
    got = {(r["folder"], r["pos"]): r["group_no"] for r in looks.similarity_groups(spark.createDataFrame(few, "folder string, pos int, designer string, season string, year int")).collect()}
    assert got == {("f", 2): 0, ("f", 3): 0, ("f", 0): 1, ("f", 1): 2, ("g", 0): 0}


def test_endpoints(spark) -> None:
    rows = [(1, None, None), (2, [("https://a.myshopify.com/graphql", None)], "storefrontAccessToken: '" + "0f" * 16 + "'"), (3, [], "x.myshopify.com")]
    got = {r["id"]: (r["endpoint"], r["token"]) for r in extract.graph_endpoint(spark.createDataFrame(rows, "id int, requests array<struct<url:string,headers:map<string,string>>>, html string")).collect()}
    assert got == {1: (None, None), 2: ("https://a.myshopify.com/graphql", "0f" * 16), 3: ("https://x.myshopify.com/api/2024-01/graphql.json", None)}
