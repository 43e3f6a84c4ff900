"""Python workers of a session find this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def let_workers_import(spark: SparkSession) -> None:
    """For local sessions whose PYTHONPATH doesn't name this package; on a cluster it is installed or sent with --py-files."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
