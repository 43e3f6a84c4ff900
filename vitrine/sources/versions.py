"""Tables that change by partition: a write makes new folders for the partitions it touches, and a new version that names all folders.

A table's folder has `data/<write>/<partition>=<value>`, which is never changed, and `versions`, a small table with one row per partition of
each version. A version is written last and by one task, so it is there as a whole or not at all: a reader has the newest one, or the one
it asks for, whatever writers do meanwhile, and a write that fails leaves files that nobody reads. If two writers make the same version,
the one of the smaller name wins and the other is told.

Rows of a partition that isn't touched are neither read nor written. The driver sees the rows of one version, which are as many as partitions.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.shared import read_if_there
from vitrine.sources import sinks

_VERSIONS = "version long, write string, partition string, value string, folder string, columns string"


class VersionConflict(RuntimeError):
    """Another writer made a version meanwhile; the write should be tried again on it."""


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """value (of the partition), folder, columns, version and write of every partition in a version, the newest if none is named."""
    every = read_if_there(spark, f"{path}/versions", _VERSIONS)
    if every is None:
        return None
    wanted = every.agg(F.max("version")).first()[0] if version is None else version
    of = every.where(F.col("version") == wanted)
    winner = of.agg(F.min("write")).first()[0]
    if winner is None:
        raise ValueError(f"{path} has no version {version}")
    return of.where(F.col("write") == winner)


def snapshot(spark: SparkSession, path: str, version: int | None = None, values: list[str] | None = None) -> DataFrame | None:
    """The table in a version, or of some of its partitions: only their folders are opened. None if there is no version yet."""
    rows = manifest(spark, path, version)
    if rows is None:
        return None
    found = rows.collect()
    schema, partition = StructType.fromJson(json.loads(found[0]["columns"])), found[0]["partition"]
    #: Partitions by the write that they still stand on.
    by_write: dict[str, list[str]] = {}
    for r in found:
        if r["value"] is not None and (values is None or r["value"] in values):
            by_write.setdefault(r["folder"], []).append(r["value"])
    parts: DataFrame | None = None
    for folder, own in sorted(by_write.items()):
        part = spark.read.schema(schema).parquet(f"{path}/{folder}").where(F.col(partition).cast("string").isin(own)).select(*schema.names)
        parts = part if parts is None else parts.unionByName(part)
    return spark.createDataFrame([], schema) if parts is None else parts


def rewrite(spark: SparkSession, path: str, changes: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], partition: str) -> list[str]:
    """A new version in which the partitions that occur in changes are merge(their rows, changes); returns their values. merge gets None
    for rows of partitions that don't exist yet. A partition that merge leaves empty is in the new version no more. A null or empty value of
    the partition column is an error, as no folder can be named by it."""
    values = [r[0] for r in changes.select(F.col(partition).cast("string").alias("v")).distinct().collect()]
    if None in values or "" in values:
        raise ValueError(f"{partition} must have a value in every row")
    before = manifest(spark, path)
    old = before.collect() if before is not None else []
    known = {r["value"] for r in old}
    touched = [v for v in values if v in known]
    merged = merge(snapshot(spark, path, values=touched) if touched else None, changes)
    write = uuid.uuid4().hex
    folder = f"data/{write}"
    #: Rows of one partition may be many, so they are dealt over tasks as they come and not brought together.
    merged.write.partitionBy(partition).parquet(f"{path}/{folder}")
    #: Which partitions have rows is seen from the folders' names alone.
    now = spark.read.schema(merged.schema).parquet(f"{path}/{folder}").select(F.col(partition).cast("string").alias("value")).distinct()
    version = (old[0]["version"] if old else 0) + 1
    columns = merged.schema.json()
    kept = [(version, write, partition, r["value"], r["folder"], columns) for r in old if r["value"] is not None and r["value"] not in set(values)]
    new = now.select(F.lit(version).cast("long").alias("version"), F.lit(write).alias("write"), F.lit(partition).alias("partition"), "value", F.lit(folder).alias("folder"), F.lit(columns).alias("columns"))
    #: A row without a value stands for the version itself, as an empty table is a version too.
    mark = spark.createDataFrame([*kept, (version, write, partition, None, None, columns)], _VERSIONS)
    latest = manifest(spark, path)
    if latest is not None and latest.first()["version"] >= version:
        raise VersionConflict(f"version {version} of {path} was made by another writer")
    new.unionByName(mark).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return sorted(values)


def upsert(spark: SparkSession, path: str, rows: DataFrame, partition: str, key: list[str], order: str) -> list[str]:
    """Of each key (and partition) the latest row by `order`, old or new."""
    return rewrite(spark, path, rows, lambda old, new: sinks.upserted(old, new, [partition, *key], order), partition)


def replace(spark: SparkSession, path: str, rows: DataFrame, partition: str) -> list[str]:
    """All rows of a partition by new ones."""
    return rewrite(spark, path, rows, lambda _, new: new, partition)


def insert(spark: SparkSession, path: str, rows: DataFrame, partition: str, key: list[str]) -> list[str]:
    """New rows whose key is free; one of several of a key."""
    return rewrite(spark, path, rows, lambda old, new: new.dropDuplicates([partition, *key]) if old is None else sinks.insert_unique(old, new, [partition, *key])[0], partition)


def remove(spark: SparkSession, path: str, keys: DataFrame, partition: str, key: list[str]) -> list[str]:
    """Without the rows of the given keys (partition and key columns)."""
    return rewrite(spark, path, keys, lambda old, gone: sinks.delete(old, gone, [partition, *key]) if old is not None else gone.where("false"), partition)


def change(spark: SparkSession, path: str, changes: DataFrame, partition: str, key: str) -> list[str]:
    """Rows with the columns that a change of their key supplies; null means unchanged, and a key that isn't there is passed over."""
    return rewrite(spark, path, changes, lambda old, new: sinks.updated(old, new.drop(partition), key) if old is not None else new.where("false"), partition)
