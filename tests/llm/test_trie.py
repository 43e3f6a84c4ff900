"""The prefix trie against brute force: odd rows, long conversations, many equal ones, blocks of any size."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
import reference
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import neardup, trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, n int, digest string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")



def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, digest(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = [*turns.get(c - c % 20, [])[:h], *own[h:]]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        saved[node] = sum(saved[k] for k in children[node]) + ((len(members[node]) - 1) * len(reference.words(node[-1][1])) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def found(spark: SparkSession, rows: list[tuple]) -> list[tuple]:
    return nodes_of(spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA))


def nodes_of(conversations: DataFrame) -> list[tuple]:
    ordered = trie.staged(trie.in_order(trie.turn_facts(conversations)), "ordered")
    nodes = trie.trie(*trie.rebuilt(ordered, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4))
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in nodes.collect())


@pytest.mark.parametrize(("block", "hot"), [(1024, 400), (3, 2)])
def test_by_brute_force(spark, monkeypatch, block: int, hot: int) -> None:
    """Shared, absent and short first conversations, repeated and odd rows, one long conversation, many equal ones."""
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(neardup, "HOT", hot)
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "日本 é", "a\nb c"])) for c in [*range(0, 70), *range(81, 100), 10**12 + 7] for t in range(rng.randint(1, 7))]
    rows += [(5, None, "user", "first"), (5, 0, "user", "first"), (5, 0, "user", "first"), (None, 0, "user", "nobody"), (None, None, None, None)]
    rows += [(2000 + c, t, "user", f"same {t}") for c in range(40) for t in range(5)] + [(3000, t, "user", f"turn {t % 5}") for t in range(50)] + [(3001, t, "user", f"turn {t % 5}") for t in range(45)]
    assert found(spark, rows) == brute(rows)


def test_long_and_many(spark) -> None:
    """A conversation of 20,000 turns and its twin cost a row for each prefix; 3,000 equal conversations end in one node."""
    long_ = spark.range(40_000).select((F.col("id") % 2 + 20_000_000).alias("conv_id"), F.floor(F.col("id") / 2).alias("turn"), F.lit("user").alias("role"), F.lit("two words").alias("text"))
    equal = spark.range(3_000).select((F.col("id") * 7 + 40_000_000).alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hello").alias("text"))
    ordered = trie.staged(trie.in_order(trie.turn_facts(long_.unionByName(equal))), "ordered")
    nodes = {(r["conv_id"], r["depth"]): r for r in trie.trie(*trie.rebuilt(ordered, F.col("conv_id"), F.lit(0))).collect()}
    assert len(nodes) == 20_002
    for d in (1, 1023, 1024, 1025, 19_999, 20_000):
        r = nodes[20_000_000, d]
        assert (r["n_convs"], r["n_leaves"], r["saved_tokens"], r["n_children"]) == (2, 1, 2 * (20_000 - d + 1), int(d < 20_000))
    end = nodes[40_000_000, 1]
    assert end["n_convs"] == 3000 and end["ends_sha256"] == hashlib.sha256(",".join(str(40_000_000 + 7 * i) for i in range(3000)).encode()).hexdigest()
    assert nodes[20_000_000, 0]["n_leaves"] == 2 and nodes[20_000_000, 0]["saved_tokens"] == 40_000 + 2999


def test_empty_and_turnless(spark) -> None:
    assert found(spark, []) == []
    for rows in ([(21, 0, "user", "x")], [(25, 0, "user", "x"), (20, 0, "a", "b")], [(c, 0, "user", "x") for c in range(1, 20)], [(-7, 0, "user", None), (-7, 1, None, "y")]):
        want = brute(rows) if rows[0][0] > 0 else None
        got = found(spark, rows)
        assert want is None or got == want
        assert got[0][1] == 0 and sum(r[1] == 0 for r in got) == 1
