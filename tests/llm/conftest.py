from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).parent))

LONG = "wörd " * 9000 + "end"


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", "x", 1.0), (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a", "x", 1.0),
        (2, "The QUICK brown fox jumps over the lazy dog and runs away", "en", None, None, None), (3, None, "en", "a", "y", 2.0), (4, "", None, "b", "y", 2.0), (5, " \n\t", "de", "b", None, None),
        (None, "ein Satz ohne Nummer", "de", "b", "y", 3.0), (None, None, None, None, None, None), (6, LONG, "de", "b", "z", 4.0), (7, "1234 !!", "de", "c", "z", 5.0), (8, "▁literal▁ <s> 日本語 é é \U0001f600", "de", "c", "z", 5.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, key string, score double")


@pytest.fixture(scope="session")
def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, None), (6, None, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
