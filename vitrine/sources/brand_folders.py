"""Saved configurations of brands as a data source: a partition for some brands' folders, and one shape for the older and newer files.

`<path>/<brand>/config.json` has the strategies that extract a brand's products (older files name one strategy and no fields), and
`<path>/<brand>/gallery.json` how its images are found (older files have one selector). A filter on brand_id opens those folders alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from itertools import batched
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from vitrine.shared import spread

#: The fields that a strategy may contribute.
TRACKED_FIELDS = ["name", "price", "currency", "description", "variants", "brand", "sku", "category"]
#: Partitions of few folders, and the folders that one has at most: a task costs far more than a folder.
FEW_PARTITIONS, MOST_FOLDERS = 32, 1000
#: The score of a strategy in an older file, which has none.
OLD_SCORE = 100.0
SCHEMA = (
    "brand_id string, domain string, contributions array<struct<strategy:string,fields:array<string>,score:double>>, verified boolean, discovery_url string,"
    " image_selector string, url_attribute string, container_selector string, migrated boolean, error string"
)


def one_shape(config: dict[str, Any] | None, gallery: dict[str, Any] | None, brand: str) -> dict[str, Any]:
    """A row of SCHEMA from the files of a brand, of whatever age; without a file its columns are null."""
    out: dict[str, Any] = dict.fromkeys(("domain", "contributions", "verified", "discovery_url", "image_selector", "url_attribute", "container_selector", "error")) | {"brand_id": brand, "migrated": False}
    if config is not None:
        given = config.get("contributions")
        if given is None and "strategy" in config:
            given, out["migrated"] = [{"strategy": config["strategy"], "fields": TRACKED_FIELDS, "score": OLD_SCORE}], True
        if given is not None:
            out["contributions"] = [(c.get("strategy"), sorted(c.get("fields") or []), float(c.get("score") or 0)) for c in given]
            out |= {"domain": config.get("domain") or brand.replace("_", "."), "verified": bool(config.get("verified", False)), "discovery_url": config.get("discovery_url")}
    if gallery is not None:
        if "gallery_selector" in gallery and "image_selector" not in gallery:
            gallery, out["migrated"] = {"image_selector": "", "url_attribute": "src", "container_selector": gallery["gallery_selector"]}, True
        out |= {k: gallery.get(k) for k in ("image_selector", "url_attribute", "container_selector")}
    return out


class _Folders(InputPartition):
    def __init__(self, brands: Sequence[str]) -> None:
        super().__init__(brands)
        self.brands = brands


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, schema.names
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("brand_id",):
                yield f
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> Sequence[InputPartition]:
        store, base = fs.FileSystem.from_uri(self.path)
        there = store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if self.wanted is None else [store.get_file_info(f"{base}/{w}") for w in sorted(x for x in self.wanted if x)]
        #: A brand is a folder with at least one of the files; which of them is seen when it is read.
        brands = sorted(i.base_name for i in there if i.type == fs.FileType.Directory)
        return [_Folders(b) for b in batched(brands, min(MOST_FOLDERS, -(-len(brands) // FEW_PARTITIONS)))] if brands else []

    def read(self, partition: _Folders | None) -> Iterator[tuple]:
        if partition is None:  # there are no folders
            return
        store, base = fs.FileSystem.from_uri(self.path)
        for brand in partition.brands:
            yield from self._of_brand(store, base, brand)

    def _of_brand(self, store: fs.FileSystem, base: str, brand: str) -> Iterator[tuple]:
        found: list[dict[str, Any] | None] = []
        error = None
        for name in ("config.json", "gallery.json"):
            try:
                with store.open_input_stream(f"{base}/{brand}/{name}") as f:
                    found.append(json.loads(f.read()))
            except FileNotFoundError:
                found.append(None)
            except ValueError as e:
                found.append(None)
                error = f"{name}: {type(e).__name__}"
        if error or any(x is not None for x in found):
            row = one_shape(*(x if isinstance(x, dict) else None for x in found), brand) | {"error": error}
            yield tuple(row[c] for c in self.names)


class BrandFolders(DataSource):
    """Format brand_folders; option path is the URI of the folder of brands."""

    @classmethod
    def name(cls) -> str:
        return "brand_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)


def read_brand_folders(spark: SparkSession, path: str) -> DataFrame:
    """One row per brand that has a file: SCHEMA, both shapes alike (migrated says which were older). A broken file gives an error and nulls."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BrandFolders)
    return spark.read.format("brand_folders").option("path", path).load()


def save_files(rows: DataFrame, path: str) -> None:
    """Writes rows (brand_id, file, body) as <path>/<brand_id>/<file>, each as a whole; rows are dealt to all tasks. brand_id may be folders in
    folders. A file comes under its name when it is whole, and a task that runs again writes it again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path)
        made: set[str] = set()
        for batch in batches:
            for r in batch.to_pylist():
                folder = f"{base}/{r['brand_id']}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{r['file']}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(r["body"].encode())
                store.move(part, f"{folder}/{r['file']}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    rows = spread(rows.select("brand_id", "file", "body"), "brand_id", "file")
    rows.mapInArrow(write, "files long").agg({"files": "sum"}).collect()
