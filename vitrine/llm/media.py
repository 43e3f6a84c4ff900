"""Media columns of progressive JPEG: texts stored as image coefficients, and full-resolution RGB tensors read from stored images."""

from __future__ import annotations

import contextlib
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vitrine.llm.common import SLICE_BYTES, read, slices, staged
from vitrine.llm.jpeg import PAYLOAD_COMMENT, UNIT, BrokenImage, Image, decode, encode_payload, payload_of, rows_of_rgb


def padded(text: str | None) -> tuple[int, bytes]:
    """The length of a text in UTF-8 bytes, and these with spaces up to a positive multiple of UNIT; a null is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def text_media(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, media, the whole text as the coefficients of a progressive JPEG.

    A null text is empty, and an empty one is a block of spaces; repeated rows stay; no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                made = [padded(t.as_py()) for t in rows.column("text")]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([encode_payload(p) for _, p in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _tensor(data: bytes | None) -> tuple[Image | None, np.ndarray | None, str | None]:
    """An image, its RGB tensor, and why there is none."""
    if data is None:
        return None, None, None
    try:
        image = decode(data)
        return image, np.concatenate(list(rows_of_rgb(image))), None
    except BrokenImage as e:
        return None, None, str(e)
    except KeyError:
        return None, None, "no such table of quantisation"


_TENSOR = {"height": ("integer", pa.int32()), "width": ("integer", pa.int32()), "rgb": ("binary", pa.binary()), "error": ("string", pa.string())}
_PAYLOAD = {"payload_bytes": ("long", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("long", pa.int64()), "media_bytes": ("long", pa.int64()), "media_sha256": ("string", pa.string())}


def _payload_facts(data: bytes, image: Image | None) -> tuple:
    own = (None, None, None)
    if image is not None and image.comment.startswith(PAYLOAD_COMMENT):
        with contextlib.suppress(BrokenImage):
            payload = payload_of(image)
            own = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    return *own, len(data), hashlib.sha256(data).hexdigest()


def rgb_tensors(images: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """images with height, width, rgb (uint8 [height, width, 3], row by row) and error of each JPEG in the column media.

    A null one has nulls; one that isn't a whole JPEG of 8-bit samples in one or three components has nulls and an error. payload adds
    the length and digests of the bytes that text_media stored in it (null if there are none), and the JPEG's own. Input columns of these
    names are replaced; repeated rows stay; no rows give none.
    """
    added = _TENSOR | (_PAYLOAD if payload else {})
    kept = [c for c in images.columns if c not in added]
    schema = images.select(*kept).schema
    for name, (kind, _) in added.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, made, size = 0, [], 0
            for i in range(len(batch)):
                data = batch.column(media)[i].as_py()
                image, rgb, error = _tensor(data)
                facts = () if not payload else (None,) * 5 if data is None else _payload_facts(data, image)
                made.append((image and image.height, image and image.width, None if rgb is None else rgb.tobytes(), error, *facts))
                size += 0 if rgb is None else rgb.size
                if size >= SLICE_BYTES or i + 1 == len(batch):
                    columns = [pa.array(x, k) for x, (_, k) in zip(zip(*made, strict=True), added.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(made)) for c in kept), *columns], [*kept, *added])
                    first, made, size = i + 1, [], 0

    return images.select(*kept).mapInArrow(run, schema)


def tensor_features(tensors: DataFrame) -> DataFrame:
    """tensors (height, width, rgb, ...) with feature in place of rgb: width x height, the means of R, G and B, and a checksum of the
    tensor; a null tensor has none."""
    kept = [c for c in tensors.columns if c not in ("rgb", "feature")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = []
            for height, width, rgb in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), batch.column("rgb"), strict=True):
                if not rgb.is_valid:
                    features.append(None)
                    continue
                data = np.frombuffer(rgb.as_buffer(), np.uint8)
                means = ",".join(f"{m:.3f}" for m in data.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (height * width))
                features.append(f"{width}x{height} {means} {zlib.crc32(data):08x}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(features, pa.string())], [*kept, "feature"])

    return tensors.select(*kept, "rgb").mapInArrow(run, tensors.select(*kept).schema.add("feature", "string"))


def media_features(stored: DataFrame) -> DataFrame:
    """Per row of stored (doc_id, n_bytes, media): doc_id, n_bytes, the payload's and the media's lengths and digests, and feature. Tensors
    are written as a table and features come from the rows read back. A null or broken media has a null feature; other columns are ignored."""
    tensors = rgb_tensors(stored.select("doc_id", "n_bytes", "media"), payload=True).drop("media")
    return tensor_features(staged(tensors, "tensors")).drop("height", "width", "error")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JPEGs are written as a media column and read back from there, and so are the RGB tensors."""
    return media_features(staged(text_media(read(spark, sf_dir, "documents")), "media"))
