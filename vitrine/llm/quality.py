"""A quality classifier by hierarchical empirical Bayes, from grouped aggregation alone.

Evidence: hashed features of all words of a text (the word, its shape, whether it repeats the word before), each weighing the log ratio of
its share in good and in bad labelled documents, shrunk towards no evidence where it is rare. A text's evidence is the mean over its
words, counted as that of EVIDENCE_WORDS words at most.
Sites: every document's probability of being good counts towards its host and its path on that host. A host's mean is shrunk towards the
global mean, a path's towards its host's, by strengths estimated from the spread between groups, so that sites with few documents keep
to the prior above them. A document's posterior joins its own evidence with the posterior of its path, from which it is left out itself.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vitrine.llm.common import join_checked, read, slices, staged
from vitrine.llm.remember import remembers, work_for

#: Labelled documents that the fit reads, about; chosen by a hash of their ids among all.
FIT_DOCUMENTS = 20_000
BUCKETS = 1 << 16
#: Documents' worth of prior that a feature's ratio is shrunk by.
SMOOTHING = 0.5
EVIDENCE_WORDS = 20
#: Bounds of a group's pull towards the prior above it, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1000.0
#: Bound of the evidence of one document for its site.
CLIP = 6.0
KEEP = 0.5
#: Words whose features a Python worker remembers; beyond that it starts afresh, which bounds memory and changes no result.
REMEMBERED = 200_000


@dataclass
class Evidence:
    prior: float
    weights: np.ndarray  # by bucket


class _Classes(dict):
    """Of each character: a for a letter, A for a capital, 0 for a digit, else itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return self[code]


_classes = _Classes()
_RUN, _MARKS = re.compile(r"([aA0])\1+"), re.compile(r"([^aA0\n])\1\1+")


def bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}:{value}".encode("utf-8", "surrogatepass")) % BUCKETS


SAME, NEW = bucket("repeats", "yes"), bucket("repeats", "no")
_known: dict[str, int] = {}
remembers("quality", _known.clear)


def word_buckets(words: list[str]) -> np.ndarray:
    """[word, 2]: the buckets of each word and of its shape, in which runs of letters or digits are one and longer runs of a mark two."""
    new = [w for w in words if w not in _known]
    if new:
        if len(_known) > REMEMBERED:
            _known.clear()
            new = words
        shapes = _MARKS.sub(r"\1\1", _RUN.sub(r"\1", "\n".join(new).translate(_classes))).split("\n")
        of_shape = {s: bucket("shape", s) for s in set(shapes)}
        _known.update((w, bucket("word", w.lower()) * BUCKETS + of_shape[s]) for w, s in zip(new, shapes, strict=True))
    both = np.fromiter(map(_known.__getitem__, words), np.int64, len(words))
    return np.stack([both // BUCKETS, both % BUCKETS], axis=1)


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, buckets, repeats) of each word of the texts, in order: the text it is in, its two buckets, and whether the word before it in
    the text is the same (1), another (0) or none (-1)."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    words = lists.values.dictionary_encode()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    at = words.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(column)), np.diff(lists.offsets.to_numpy()))
    full = at != (distinct.index("") if "" in distinct else -1)
    at, text = at[full], text[full]
    repeats = np.full(len(at), -1)
    if len(at):
        inside = text[1:] == text[:-1]
        repeats[1:] = np.where(inside, at[1:] == at[:-1], -1)
    return text, word_buckets(distinct)[at], repeats


def site(host: Column, path: Column) -> tuple[Column, Column]:
    """Keys of a host and a path that are never null and keep a null apart from every text."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    return name(host), F.concat_ws("\n", name(host), name(path))


def fit_evidence(docs: DataFrame, labels: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Evidence:
    """From labelled rows of docs (doc_id, text); a document with several labels has the highest. Without labels there is no evidence."""
    label = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    label = staged(label, "quality-labels")
    share = fit_documents / max(label.count(), 1)
    chosen = label.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * share)
    rows = join_checked(docs.select("doc_id", "text"), chosen, ["doc_id"], "inner", max_rows=2 * fit_documents).select("good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        #: Shares of a document's words in millionths, so sums are exact; the last bucket counts documents.
        work_for("quality")
        total = np.zeros((BUCKETS + 1, 2), np.int64)
        for batch in batches:
            for part in slices(batch):
                text, buckets, repeats = text_words(part.column("text"))
                good = part.column("good").to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.bincount(text, minlength=len(part))
                second = repeats >= 0
                keys = np.concatenate([text * BUCKETS + buckets[:, 0], text * BUCKETS + buckets[:, 1], text[second] * BUCKETS + np.where(repeats[second], SAME, NEW)])
                keys, counts = np.unique(keys, return_counts=True)
                of = keys // BUCKETS
                np.add.at(total, (keys % BUCKETS, good[of]), np.rint(1e6 * counts / n[of]).astype(np.int64))
                np.add.at(total, (BUCKETS, good), 1)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some, 0]), pa.array(total[some, 1])], ["bucket", "bad", "good"])

    sums = rows.mapInArrow(run, "bucket int, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).collect()
    shares, documents = np.zeros((BUCKETS, 2)), [0, 0]
    for r in sums:
        if r["bucket"] == BUCKETS:
            documents = [r["bad"], r["good"]]
        else:
            shares[r["bucket"]] = r["bad"] / 1e6, r["good"] / 1e6
    prior = (documents[1] + 1) / (sum(documents) + 2)
    ratio = np.log((shares[:, 1] + SMOOTHING * prior) / (shares[:, 0] + SMOOTHING * (1 - prior))) - math.log(prior / (1 - prior))
    return Evidence(round(prior, 6), np.where(shares.any(axis=1), np.round(ratio, 6), 0.0))


def with_evidence(rows: DataFrame, model: Evidence, text: str, inside: str | None = None) -> DataFrame:
    """rows with the column evidence, a log ratio, of each whole text; a text without words has 0. inside names a struct that holds text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work_for("quality")
        weights = shared.value
        for batch in batches:
            whole = pc.struct_field(batch.column(inside), text) if inside else batch.column(text)
            for part in slices(pa.RecordBatch.from_arrays([whole, pa.array(np.arange(len(batch)))], ["text", "at"])):
                of, buckets, repeats = text_words(part.column("text"))
                each = weights[buckets].sum(axis=1) + np.where(repeats < 0, 0.0, np.where(repeats > 0, weights[SAME], weights[NEW]))
                n = np.bincount(of, minlength=len(part))
                mean = np.bincount(of, each, len(part)) / np.maximum(n, 1)
                own = batch.slice(part.column("at")[0].as_py(), len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(np.round(mean * np.minimum(n, EVIDENCE_WORDS), 9))], [*own.schema.names, "evidence"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("evidence", DoubleType())]))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def own_share(model: Evidence) -> Column:
    """A document's probability of being good, as it counts towards its site: in millionths, so sums don't depend on the order of rows."""
    return F.round(1e6 * sigmoid(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col("evidence") + math.log(model.prior / (1 - model.prior)))))).cast("long")


@dataclass
class Sites:
    """One row per path: host, path, n, good, host_n, host_good; and the mean of all documents and the strengths of the two priors."""

    sums: DataFrame
    mean: float
    host_pull: float
    path_pull: float


def fit_sites(scored: DataFrame, model: Evidence) -> Sites:
    """From all rows of scored (host, path, evidence)."""
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(own_share(model)).alias("good")), "quality-paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "quality-hosts")
    mean, host_pull = _spread(hosts, "host_n", "host_good", F.lit(model.prior))
    both = staged(paths.join(hosts.hint("merge"), "host"), "quality-sites")
    of_host = (F.col("host_good") / 1e6 + host_pull * mean) / (F.col("host_n") + host_pull)
    _, path_pull = _spread(both, "n", "good", of_host)
    return Sites(both, mean, host_pull, path_pull)


def _spread(groups: DataFrame, n: str, good: str, prior: Column) -> tuple[float, float]:
    """The mean over all groups and the strength of the beta prior around `prior` that fits their spread, by moments."""
    squares = F.round(1e6 * F.col(n) * F.pow(F.col(good) / 1e6 / F.col(n) - prior, 2)).cast("long")
    r = groups.agg(F.sum(n).alias("n"), F.sum(good).alias("good"), F.count("*").alias("groups"), F.sum(squares).alias("squares")).first()
    if not r["n"]:
        return 0.5, LEAST_STRENGTH
    mean = min(1 - 1e-6, max(1e-6, r["good"] / 1e6 / r["n"]))
    between = r["squares"] / 1e6 / r["n"] - mean * (1 - mean) * r["groups"] / r["n"]
    pull = MOST_STRENGTH if between <= 0 else mean * (1 - mean) / between - 1
    return round(mean, 6), round(max(LEAST_STRENGTH, min(MOST_STRENGTH, pull)), 3)


def posterior(scored: DataFrame, model: Evidence, sites: Sites) -> DataFrame:
    """scored (path, evidence, ...) with host_posterior and path_posterior, both without the document itself, quality_score and kept."""
    joined = join_checked(scored, sites.sums.drop("host"), ["path"]).withColumn("own", own_share(model))
    #: A document alone on its host leaves the prior.
    host = ((F.col("host_good") - F.col("own")) / 1e6 + sites.host_pull * sites.mean) / (F.col("host_n") - 1 + sites.host_pull)
    path = ((F.col("good") - F.col("own")) / 1e6 + sites.path_pull * F.col("host_posterior")) / (F.col("n") - 1 + sites.path_pull)
    bounded = lambda p: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    joined = joined.withColumn("host_posterior", bounded(host)).withColumn("path_posterior", bounded(path)).drop("own", "n", "good", "host_n", "host_good")
    return joined.withColumn("quality_score", sigmoid(F.col("evidence") + logit(F.col("path_posterior")))).withColumn("kept", F.col("quality_score") >= KEEP)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Per row of docs (doc_id, text, host, path): doc_id, evidence, host_posterior, path_posterior, quality_score (0 to 1), kept.

    A null text is empty and has no evidence; a null host or path is a site of its own; a row without id isn't learned from but scored;
    repeated rows stay. Empty table: no rows. Other columns are ignored.
    """
    model = fit_evidence(docs, labels)
    host_key, path_key = site(F.col(host), F.col(path))
    rows = with_evidence(docs.select("doc_id", "text", host_key.alias("host"), path_key.alias("path")), model, "text")
    scored = staged(rows.drop("text"), "quality-evidence")
    return posterior(scored, model, fit_sites(scored, model)).select("doc_id", "evidence", "host_posterior", "path_posterior", "quality_score", "kept")


def kept_documents(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of docs that the classifier keeps, columns unchanged. Texts are read once for their evidence and written beside it, so they
    aren't shuffled."""
    model = fit_evidence(docs, labels)
    host_key, path_key = site(F.col(host), F.col(path))
    rows = with_evidence(docs.select(F.struct("*").alias("row"), host_key.alias("host"), path_key.alias("path")), model, "text", "row")
    scored = staged(rows, "quality-evidence")
    return posterior(scored, model, fit_sites(scored, model)).where("kept").select("row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
