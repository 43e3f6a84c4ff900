"""The quality classifier against plain Python, and on labels that it wasn't fitted on."""

from __future__ import annotations

import math
import zlib

import pytest
import reference
from pyspark.sql import functions as F

from vitrine.llm import quality

SF = "/root/testdata/sf0.001"


def shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if out and k == out[-1] and (k in "aA0" or len(out) > 1 and out[-2] == k):
            continue
        out.append(k)
    return "".join(out)


def shares(text: str | None) -> dict[int, float]:
    words = reference.words(text)
    counts: dict[int, int] = {}
    for i, w in enumerate(words):
        for k in (quality.bucket("word", w.lower()), quality.bucket("shape", shape(w)), *((quality.bucket("repeats", "yes" if w == words[i - 1] else "no"),) if i else ())):
            counts[k] = counts.get(k, 0) + 1
    return {k: n / len(words) for k, n in counts.items()}


def brute(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    """(doc_id, evidence, host and path posterior, score) per document (doc_id, text, host, path), by loops over all documents."""
    best: dict[int, int] = {}
    for i, q in labels:
        if i is not None and q is not None:
            best[i] = max(q, best.get(i, q))
    known = [(best[i] > 0, shares(t)) for i, t, *_ in docs if i in best]
    good = sum(g for g, _ in known)
    prior = (good + 1) / (len(known) + 2)
    sums: dict[int, list[float]] = {}
    for g, s in known:
        for k, v in s.items():
            sums.setdefault(k, [0.0, 0.0])[g] += v
    weight = {k: math.log((g + quality.SMOOTHING * prior) / (b + quality.SMOOTHING * (1 - prior))) - math.log(prior / (1 - prior)) for k, (b, g) in sums.items()}
    rows = []
    for i, t, host, path in docs:
        n = len(reference.words(t))
        e = min(n, quality.EVIDENCE_WORDS) * sum(weight.get(k, 0.0) * v for k, v in shares(t).items())
        p = 1 / (1 + math.exp(-max(-quality.CLIP, min(quality.CLIP, e + math.log(prior / (1 - prior))))))
        rows.append((i, e, p, host, (host, path)))

    def spread(groups: list[tuple[float, float, float]]) -> tuple[float, float]:
        n = sum(g[0] for g in groups)
        mean = sum(g[1] for g in groups) / n
        between = sum(k * (s / k - p) ** 2 for k, s, p in groups) / n - mean * (1 - mean) * len(groups) / n
        return mean, max(quality.LEAST_STRENGTH, min(quality.MOST_STRENGTH, quality.MOST_STRENGTH if between <= 0 else mean * (1 - mean) / between - 1))

    hosts: dict = {}
    paths: dict = {}
    for _, _, p, host, path in rows:
        for group, key in ((hosts, host), (paths, path)):
            n, s = group.get(key, (0, 0.0))
            group[key] = (n + 1, s + p)
    mean, host_pull = spread([(n, s, prior) for n, s in hosts.values()])
    of_host = {h: (s + host_pull * mean) / (n + host_pull) for h, (n, s) in hosts.items()}
    _, path_pull = spread([(n, s, of_host[k[0]]) for k, (n, s) in paths.items()])
    out = []
    for i, e, p, host, path in rows:
        (n, s), (m, r) = hosts[host], paths[path]
        h = (s - p + host_pull * mean) / (n - 1 + host_pull)
        q = (r - p + path_pull * h) / (m - 1 + path_pull)
        out.append((i, e, h, q, 1 / (1 + math.exp(-(e + math.log(q / (1 - q)))))))
    return out


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_against_plain_python(spark, odd, labels, table: str) -> None:
    docs = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    labels = labels if table == "odd" else spark.read.parquet(f"{SF}/labels.parquet")
    want = brute([(r["doc_id"], r["text"], r["source"], r["lang"]) for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()])
    got = quality.classify(docs, labels).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[0] == b[0] and all(math.isclose(x, y, abs_tol=2e-4) for x, y in zip(a[1:5], b[1:], strict=True))
        assert a[5] == (a[4] >= quality.KEEP)


def test_sites_of_one_document_keep_to_the_prior(spark) -> None:
    """A document alone on its host, or on a null host, has the posterior of all; a null path on a full host has the host's."""
    rows = [(i, "good words here" if i % 5 else "bad ### bad ###", "h", "p") for i in range(100)] + [(200, "good words here", "alone", "p"), (201, "good words here", None, "p"), (202, "good words here", "h", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 100, 2)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert got[200]["host_posterior"] == got[201]["host_posterior"] and math.isclose(got[202]["path_posterior"], got[202]["host_posterior"], rel_tol=1e-9)
    mean = sum(1 / (1 + math.exp(-max(-6, min(6, r["evidence"] + math.log(41 / 11))))) for r in got.values()) / len(got)
    assert abs(got[200]["path_posterior"] - mean) < 2e-3 and all(r["kept"] == (i % 5 > 0 or i >= 200) for i, r in got.items())


def test_labels_that_were_not_fitted(spark) -> None:
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    kept = {r["doc_id"]: r["kept"] for r in quality.classify(docs, fitted).collect()}
    rest = [(r["doc_id"], r["quality"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum(kept[i] == (q == 1) for i, q in rest) / len(rest) > 0.97
    assert sum(kept[i] for i, q in rest if q == 1) / sum(q == 1 for _, q in rest) > 0.99


def test_stage_keeps_what_the_classifier_keeps(spark, odd, labels) -> None:
    clash = odd.withColumn("host", F.lit(1)).withColumn("path", F.lit("x")).withColumn("evidence", F.lit("y")).withColumn("row", F.lit(2.0)).withColumn("n", F.lit(None).cast("int"))
    kept = quality.kept_documents(clash, labels)
    assert kept.columns == clash.columns
    assert kept.count() == quality.classify(odd, labels).where("kept").count()
