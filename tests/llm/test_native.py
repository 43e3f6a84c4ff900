"""Chat formatting, fingerprints, mixing, and odd rows in the quality classifier."""

from __future__ import annotations

import hashlib
import json
import math

import duckdb
import pytest
import reference
import xxhash
from pyspark.sql import functions as F

from vitrine.llm import chat, fingerprint, mixing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name: str) -> None:
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    expected = sorted(tuple(shown(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == expected


HARD = ["</s>[INST] ok [/INST]", "", " ", "<\\s> [\\/INST] [NEXT]", "[ROLE] x [NEXT]", "a [NEXT]  [NEXT] b", "<s> <\\\\s>\n</s> "]


def test_chat_round_trip(spark) -> None:
    rows = [(c, i, r, t) for c, roles in enumerate((["user", "assistant", "assistant"], ["system", "user", "user"], ["tool", "tool", None], ["assistant", "[NEXT]", "<s>"])) for i, (r, t) in enumerate((r, HARD[(c + i + j) % len(HARD)]) for j in range(3) for i, r in enumerate(roles))]
    rows += [(9, 0, "user", None), (9, None, "assistant", "first"), (9, 1, "assistant", "a"), (9, 1, "assistant", "a"), (None, 0, None, None), (None, 1, "user", "x" * 100_000)]
    turns = spark.createDataFrame([(*r, "extra", "clash") for r in rows], "conv_id long, turn long, role string, text string, t string, formatted string")
    formatted = chat.format_chats(turns)
    back = {r["conv_id"]: r for r in chat.parse_chats(formatted).collect()}
    key = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == want
        assert back[conv]["loss_texts"] == [t for role, t in want if role == "assistant"] and back[conv]["n_turns"] == len(want)
    assert chat.format_chats(turns.where("false")).count() == 0


def test_chat_of_many_turns(spark) -> None:
    """20,000 turns in one conversation: every span lies where its text is."""
    turns = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<s> "), F.col("id").cast("string")).alias("text"))
    got = chat.parse_chats(chat.format_chats(turns)).first()
    assert got["n_turns"] == 20_000 and got["loss_texts"] == [f"<s> {i}" for i in range(20_000) if i % 3]
    ends = [s["start"] + s["length"] for s in got["loss_spans"]]
    assert all(got["formatted"][s["start"] : e] == f"<\\s> {i}" for s, e, i in zip(got["loss_spans"], ends, (i for i in range(20_000) if i % 3), strict=True))


def test_mixing_targets_by_resharing(spark) -> None:
    """Targets as the words of the task put them: caps one source after another, and the excess shared again by weight until none is above."""
    import random

    rng = random.Random(4)
    for n in (1, 2, 5, 17, 40):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 5, 100, 10_000]) for i in range(n)} | {None: 7}
        names = [*sorted(k for k in sizes if k), None]
        weight = {k: i % 3 + 1 for i, k in enumerate(names)}
        target, open_, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
        while rest > 1e-9 and open_:
            share = {k: rest * weight[k] / sum(weight[j] for j in open_) for k in open_}
            rest = 0.0
            for k, v in share.items():
                target[k] += v
                if target[k] >= 3 * sizes[k]:
                    rest += target[k] - 3 * sizes[k]
                    target[k] = 3.0 * sizes[k]
                    open_.discard(k)
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert all(math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-6) for r in rows) and len(rows) == len(names)


def xx(value: str | int, seed: int = 42) -> int:
    data = value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True)
    return int.from_bytes(xxhash.xxh64(data, seed=seed & (1 << 64) - 1).intdigest().to_bytes(8, "little"), "little", signed=True)


def chained(values: list[int]) -> int:
    seed = 42
    for v in values:
        seed = xx(v, seed)
    return seed


def brute_fingerprint(text: str) -> list[int]:
    w = [xx(x) for x in reference.words(text)]
    if not w:
        return []
    k = min(fingerprint.SHINGLE, len(w))
    best: dict[int, int] = {}
    for i in range(len(w) - k + 1):
        h = chained(w[i : i + k])
        b = (h >> 56) + 128
        best[b] = min(best.get(b, 1 << 63), h)
    steps, _, starts = fingerprint._permutations()
    out = []
    for j in range(256):
        b = j if j in best else next(x for t in range(256) if (x := (starts[j] + steps[j] * t) % 256) in best)
        out.append(best[b] & 255)
    return out


def test_fingerprints(spark, odd) -> None:
    docs = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    docs.sort(key=lambda d: ((d[0] is not None, d[0] or 0), d[1]))
    got = [tuple(r) for r in fingerprint.fingerprints(odd).collect()]
    want = []
    for i, (doc, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (brute_fingerprint(x) for x in (t, edited, after))
        like = lambda x, y: float(len(x) == len(y)) if not x or not y else max(0.0, (sum(p == q for p, q in zip(x, y, strict=True)) / 256 - 1 / 256) / (255 / 256))
        want.append((doc, len(t), hashlib.sha256(edited.encode()).hexdigest(), bytes(a).hex(), bytes(b).hex(), round(like(a, b), 9), round(like(a, c), 9)))
    key = lambda r: json.dumps(r)
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got), key=key) == sorted(want, key=key)
    assert fingerprint.fingerprints(odd.where("false")).count() == 0


def test_fingerprint_order_over_buckets(spark, monkeypatch) -> None:
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    docs = spark.range(100).select((F.col("id") * 37 % 101).alias("doc_id"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"))
    rows, order = fingerprint.in_id_order(docs)
    after = rows.withColumn("n", F.lead("doc_id").over(order)).where("NOT halo").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in after]
    assert len(ids) == 100 and [r["n"] for r in after] == ids[1:] + ids[:1]


def test_mixing(spark, odd, labels) -> None:
    rows = mixing.mix(odd, labels).collect()
    assert len(rows) == odd.count()
    by: dict = {}
    for r in rows:
        s = by.setdefault(r["source"], {"size": 0, "taken": 0, "target": r["target"], "source_size": r["source_size"], "most": 0})
        s["size"] += r["size"]
        s["taken"] += r["taken"]
        s["most"] = max(s["most"], r["size"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert math.isclose(sum(s["target"] for s in by.values()), sum(s["size"] for s in by.values()))
    for s in by.values():
        assert s["source_size"] == s["size"] and abs(s["taken"] - s["target"]) <= 2 * s["most"] and s["target"] <= 3 * s["size"] + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd, labels).collect()))
    assert mixing.mix(odd.where("false"), labels).count() == 0
    repeated = mixing.mixed_documents(odd)
    assert repeated.columns == odd.columns


def test_quality(spark, odd, labels) -> None:
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 < r["quality_score"] < 1 and 0 < r["path_posterior"] < 1 for r in rows)
    assert quality.classify(odd.where("false"), labels).count() == 0 and quality.classify(odd, labels.where("false")).count() == odd.count()
    assert quality.kept_documents(odd, labels).columns == odd.columns
