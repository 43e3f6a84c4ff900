"""Quality rules against brute force, odd rows and rules of a user's own."""

from __future__ import annotations

import random

import pytest
import reference
from pyspark.sql import functions as F

from vitrine.llm import rules


def repeated(words: list[str], k: int = 3) -> int:
    windows = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(k)})


def base(text: str | None) -> dict[str, int]:
    words, lines = reference.words(text), [x for x in (text or "").split("\n") if reference.words(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": repeated(words), "n_lines": len(lines)}


def test_counts_by_brute_force(spark) -> None:
    rng = random.Random(11)
    texts = [None, "", " \t\n\x0b\x0c\r", "a", "a b", "a b c", "a b c d", "a a a", "a a a a", "a b c a b c", "x\ny\nx\n\n x\nx", "é 日本 \U0001f600 é 日本 \U0001f600", "a b   c", "#* $%&|<>"]
    for _ in range(150):
        words = [rng.choice(["a", "b", "ü", "<c>", "d|", "the"][: rng.randint(1, 6)]) for _ in range(rng.randint(0, 40))]
        texts.append("".join(w + rng.choice([" ", "\n", "\t", "  ", "\r\n"]) for w in words))
    texts += [" ".join(f"w{i}" for i in range(30_000)), " ".join(f"w{i % 7000}" for i in range(30_000)), "x" * 200_000, "same line\n" * 5000]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", rules.counts(F.col("text")).alias("c")).collect()}
    for i, text in enumerate(texts[:-4]):
        assert {k: got[i][k] for k in base(text)} == base(text), text
    assert [got[len(texts) - 4 + k]["n_repeat_words"] for k in range(4)] == [0, 30_000, 0, 10_000] and got[len(texts) - 1]["n_dup_lines"] == 4999


def test_judged(spark, odd) -> None:
    rows = rules.judged(odd.withColumn("kept", F.lit("clash")).withColumn("counts", F.lit(1))).collect()
    assert len(rows) == odd.count() and all(r["key"] is None or isinstance(r["key"], str) for r in rows)
    assert all(r["kept"] is False for r in rows) and all("words" in r["base_failed"] for r in rows if reference.words(r["text"]).__len__() < 50)
    assert rules.judged(odd.where("false")).count() == 0
    texts = {"clean": "\n".join(f"The keeper{i} of garden{i} was looking at the old{i} wall{i}." for i in range(8)), "symbols": "The #a *b $c %d of " + " ".join(f"the # w{i}" for i in range(50)), "stop": " ".join(f"blorp{i}" for i in range(60)), "long": " ".join("the" + "x" * 30 + str(i) for i in range(60)), "digits": " ".join(f"the {i}" for i in range(60))}
    got = {r["name"]: r for r in rules.judged(spark.createDataFrame(list(texts.items()), "name string, text string")).collect()}
    assert got["clean"]["kept"] and got["clean"]["rules_failed"] == [] and got["clean"]["base_failed"] == []
    assert {k: [x for x in got[k]["rules_failed"] if x != "stop_words"] for k in ("symbols", "long", "digits")} == {"symbols": ["word_length", "symbols", "lettered_words"], "long": ["word_length"], "digits": ["word_length", "lettered_words"]}
    assert got["stop"]["rules_failed"] == ["stop_words"]


def test_table_of_rules(spark) -> None:
    """The table is data: other measures and bounds give other verdicts, and an empty table keeps all."""
    docs = spark.createDataFrame([("a b c",), ("a\na\na",), (None,)], "text string")
    own = (rules.Rule("few", "n_words", None, 3), rules.Rule("lines", "n_dup_lines / n_lines", None, 0.5))
    assert [r["rules_failed"] for r in rules.judged(docs, own, ()).collect()] == [[], ["lines"], []]
    assert [r["kept"] for r in rules.judged(docs, (), ()).collect()] == [True] * 3


def test_no_user_functions_and_no_shuffle(spark) -> None:
    plan = rules.judged(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Exchange"))


@pytest.mark.parametrize("table", ["documents"])
def test_good_documents_stay(spark, table: str) -> None:
    """Of the documents of sf0.01 that labels call good and that pass the base, none fails a rule; most bad ones do."""
    sf = "/root/testdata/sf0.01"
    best = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = rules.judged(spark.read.parquet(f"{sf}/{table}.parquet")).join(best, "doc_id").where("size(base_failed) = 0").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {r["quality"]: r["kept"] for r in rows}
    assert share[1] == 1.0 and share[0] <= 0.3
