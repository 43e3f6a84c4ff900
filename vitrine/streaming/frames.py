"""A sink of server-sent events: each epoch's frames become files, and are there once its commit is.

Tasks write files of their own names; the commit of an epoch lists its files in one small file named by the epoch, so an epoch that is
run again replaces its list, and files of a failed attempt are on none. Listeners read the epochs that are there, from the first or from
where they left off, in order of epoch and of the frames' own number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


@dataclass
class _Written(WriterCommitMessage):
    file: str
    frames: int


class _Writer(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """Lines of JSON, a frame each, as they come by."""
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{base}/frames", recursive=True)
        file, n = f"frames/{uuid.uuid4().hex}.json", 0
        with store.open_output_stream(f"{base}/{file}") as out:
            for row in iterator:
                out.write((json.dumps({"seq": row["seq"], "frame": row["frame"]}) + "\n").encode())
                n += 1
        return _Written(file, n)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{base}/epochs", recursive=True)
        files = [{"file": m.file, "frames": m.frames} for m in messages if m is not None and m.frames]
        temporary = f"{base}/epochs/.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            out.write(b"".join((json.dumps({"epoch": batchId} | f) + "\n").encode() for f in files))
        store.move(temporary, f"{base}/epochs/{batchId:012d}.json")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{base}/{m.file}")


class Frames(DataSource):
    """Format frames; option path is the URI of the sink's folder."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return _Writer(self.options["path"])


def emit(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes a stream of frames (seq, frame) to the sink, all that is there now; started again with its checkpoint it goes on."""
    frames.sparkSession.dataSource.register(Frames)
    return frames.select("seq", "frame").writeStream.format("frames").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heard(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """What a listener that has heard the epochs up to `after` reads: epoch, seq, frame of later committed epochs, each frame once."""
    epochs = spark.read.schema("epoch long, file string, frames long").json(f"{path}/epochs").where(F.col("epoch") > after)
    lines = spark.read.schema("seq long, frame string").json(f"{path}/frames").withColumn("file", F.concat(F.lit("frames/"), F.element_at(F.split(F.input_file_name(), "/"), -1)))
    return lines.join(F.broadcast(epochs), "file").select("epoch", "seq", "frame")
