"""Trees of any depth, lines of any indent, and the rate limiter against plain steps."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import joins, trees
from vitrine.plans import stream_queries
from vitrine.streaming import rates

NODE = "node_id string, parent_id string, ordinal long, name string, url string"


def chain(spark, n: int):
    return spark.createDataFrame([(f"c{i}", f"c{i - 1}" if i else None, i, f"n{i}", None) for i in range(n)], NODE)


def test_deep_trees(spark) -> None:
    n = 150
    deep = chain(spark, n)
    paths = {r["node_id"]: r for r in trees.with_paths(deep).collect()}
    assert len(paths) == n and all(paths[f"c{i}"]["depth"] == i and paths[f"c{i}"]["path"] == " > ".join(f"n{j}" for j in range(i + 1)) for i in range(n))
    assert trees.closure(deep).count() == n * (n + 1) // 2
    forked = deep.unionByName(spark.createDataFrame([("x", f"c{n - 2}", 1, "x", "u"), ("y", "x", 1, "y", None)], NODE))
    got = {r["node_id"]: r["parent_id"] for r in trees.collapsed(forked).collect()}
    assert got == {f"c{n - 1}": None, "x": None, "y": "x"}
    assert [r["node_id"] for r in trees.collapsed(deep).collect()] == [f"c{n - 1}"]


def test_trees_against_steps(spark) -> None:
    rng = random.Random(3)
    rows = [(f"k{i}", None if i < 3 else f"k{rng.randrange(i)}", i, f"name{i % 7}", None) for i in range(200)] + [("lost", "nowhere", 1, "lost", None), ("lower", "lost", 1, "lower", None)]
    nodes = spark.createDataFrame(rows, NODE)
    parent = {r[0]: r[1] for r in rows}
    want = set()
    for node in parent:
        at, d = node, 0
        while at in parent:
            want.add((node, at, d))
            at, d = parent[at], d + 1
    assert {tuple(r) for r in trees.closure(nodes).collect()} == want
    assert {r["node_id"] for r in trees.with_paths(nodes).collect()} == {r[0] for r in rows[:200]}
    with pytest.raises(ValueError, match="cycle"):
        trees.closure(spark.createDataFrame([("a", "b", 1, "a", None), ("b", "c", 1, "b", None), ("c", "a", 1, "c", None), ("d", "a", 1, "d", None)], NODE))


def test_many_links_of_one_path(spark) -> None:
    links = spark.createDataFrame([(f"https://x/a?{i}", "/a") for i in range(50)] + [(f"https://x/a/b{i}", f"/a/b{i}") for i in range(50)], "url string, path string")
    got = {r["url"]: r["parent_url"] for r in trees.url_hierarchy(links).collect()}
    assert len(got) == 100 and {v for k, v in got.items() if "/b" in k} == {"https://x/a?9"}


def test_lines_of_any_indent(spark) -> None:
    rng = random.Random(1)
    lines = [(d, i, rng.choice([0, 2, 25, 30, 60, None]), rng.choice(["link", "button", "heading", "text"]), "t" * rng.choice([3, 40])) for d in range(5) for i in range(80)]
    df = spark.createDataFrame(lines, "doc_id int, line_no int, indent int, kind string, text string")
    parents, links, headings = {}, {}, {}
    for d in range(5):
        own = [x for x in lines if x[0] == d]
        current = None
        for _, i, indent, kind, text in own:
            before = [x for x in own if x[1] < i and x[2] is not None and indent is not None]
            parents[d, i] = max((x[1] for x in before if x[2] < indent), default=None)
            links[d, i] = max((x[1] for x in before if x[3] == "link" and x[2] <= indent), default=None)
            if kind in ("heading", "button") and len(text) < 30:
                current = (text, indent, i)
            elif current and indent is not None and current[1] is not None and indent <= current[1]:
                current = (None, None, i)
            if kind == "link":
                headings[d, i] = current and current[0]
    key = lambda r: (r["doc_id"], r["line_no"])
    assert {key(r): r["parent_line"] for r in joins.nearest_above(df).collect()} == parents
    assert {key(r): r["link_line"] for r in joins.nearby_links(df).collect()} == links
    assert {key(r): r["heading"] for r in joins.carried_headings(df).collect()} == headings


def plain_limiter(rows: list[tuple[float, int, float | None]]) -> list[tuple[float, float, float]]:
    """(rate, tokens, wait) after each outcome (time, status, retry_after): the rules one by one, on plain variables."""
    out: list[tuple[float, float, float]] = []
    tokens, rate, since, refused_at, ramped_at, good, paused_until, last = 15.0, 15.0, rows[0][0], float("-inf"), float("-inf"), 0, 0.0, rows[0][0]
    for now, status, retry in rows:
        begin = max(now, last, paused_until)
        tokens = min(max(rate, 1.0), tokens + (begin - last) * rate)
        wait = min((1 - tokens) / rate, 60.0) if tokens < 1 else 0.0
        tokens = max(0.0, tokens + wait * rate - 1)
        last = begin + wait
        if status == 429:
            reached = 0.9 * good / (last - since) if good and last > since else rate / 2
            rate = max(2.0, min(reached, rate, 50.0))
            paused_until = last + (1.0 if retry is None else retry)
            since, refused_at, good, tokens = last, last, 0, min(tokens, 3.0)
        else:
            good += 1
            if last - ramped_at >= 5 and last - refused_at >= 10 and good >= 10:
                rate, ramped_at = min(50.0, rate * 1.3), last
        out.append((rate, tokens, begin + wait - now))
    return out


def test_rate_limiter_steps_and_stream(spark) -> None:
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    outcomes = stream_queries._outcomes(events)
    batch = {r["event_id"]: r for r in rates.limited(outcomes).collect()}
    by_site: dict = {}
    rows = outcomes.select("site", "event_id", F.col("ts").cast("double").alias("at"), "status", "retry_after").collect()
    for r in sorted(rows, key=lambda r: (r["site"], r["at"], r["event_id"])):
        by_site.setdefault(r["site"], []).append(r)
    assert len(batch) == len(rows)
    for own in by_site.values():
        for r, want in zip(own, plain_limiter([(r["at"], r["status"], r["retry_after"]) for r in own]), strict=True):
            assert all(abs(batch[r["event_id"]][c] - v) < 1e-5 for c, v in zip(("rate", "tokens", "wait"), want, strict=True))
    stream = {r["event_id"]: r for r in stream_queries.stream_rate_limiter(spark, sf).collect()}
    assert stream.keys() == batch.keys() and all(abs(stream[k][c] - batch[k][c]) < 1e-5 for k in batch for c in ("rate", "tokens", "wait"))
