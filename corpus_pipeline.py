"""The corpus pipeline: language ID, quality, near-duplicates, mixing, tokens. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import common, langid, mixing, neardup, quality, sp_maxplus

#: A document whose best language has a posterior below this has none.
LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; columns unchanged."""
    common.let_workers_import(spark)
    model = langid.fit(docs, langid.default_tokenizer())
    named = langid.identify(docs.select(F.struct("*").alias("row"), "text"), model)
    return named.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on `labels`, finds good; columns unchanged."""
    common.let_workers_import(spark)
    return quality.kept_documents(docs, common.read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the one of smallest id; columns unchanged."""
    common.let_workers_import(spark)
    dropped = common.staged(neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "dropped")
    return common.join_checked(docs, dropped, ["doc_id"], "left_anti", max_rows=500_000)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix, weighted by `labels`, takes them; columns unchanged."""
    return mixing.mixed_documents(docs, common.read(spark, sf_dir, "labels"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every document."""
    common.let_workers_import(spark)
    return sp_maxplus.encode(docs, langid.default_tokenizer()).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("tokenize", tokenize),
]
#: The stages fit models and segment texts, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
