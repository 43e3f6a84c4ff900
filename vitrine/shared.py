"""The folder that the driver and the executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that a cluster names in spark.checkpoint.dir. A local session that names none, as in tests, gets one of its own; on a
    cluster that is an error, as executors wouldn't see it."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        top = f"file://{tempfile.mkdtemp(prefix='vitrine-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends here and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys to as many tasks as a shuffle has, for work that is heavy row by row: a small file of many rows is read by
    one or two tasks. The number is given, so that small partitions aren't put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet table at path, or None if there is no such folder; looked up as Spark sees it, so in any store."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
