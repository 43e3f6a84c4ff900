"""Joins that carry a catalogue's users, sessions, files and lines together."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def user_of_session(sessions: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """Sessions that are still valid, with their active user."""
    live = sessions.where(F.col("expires_at") >= F.lit(now).cast("timestamp"))
    return live.join(users.where("is_active"), "user_id")


def orphans(files: DataFrame, known: DataFrame, key: str = "path") -> DataFrame:
    return files.join(known.select(key), key, "left_anti")


def in_both(first: DataFrame, second: DataFrame, identity: str) -> DataFrame:
    """Rows of the first whose identity the second has too: images of a site, not of a product."""
    return first.join(second.select(identity).distinct(), identity, "left_semi")


def with_followed(follows: DataFrame, brands: DataFrame, counts: DataFrame) -> DataFrame:
    """Followed brands with what is known of them and their products; what is missing is null or 0. Brands are the small side of both joins, and Spark broadcasts them by their size."""
    return follows.join(brands, "brand_id", "left").join(counts, "brand_id", "left").withColumn("products", F.coalesce("products", F.lit(0)))


def _in_order(lines: DataFrame, name: str, step: Callable[[list, int | None, int, str], int | None]) -> DataFrame:
    """lines with a line number that `step` gives for each (opened, indent, line_no, kind). A document's lines are streamed in order, with
    `opened` carried on, so it is sorted once, never joined with itself nor held whole, and any indent may occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, opened = None, []
        for batch in batches:
            found = []
            for of, line, indent, kind in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "line_no", "indent", "kind")), strict=True):
                if of != doc:
                    doc, opened = of, []
                found.append(step(opened, indent, line, kind))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {name: pa.array(found, batch.column("line_no").type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    lines = lines.drop(name)
    number = lines.schema["line_no"].dataType
    return lines.repartition("doc_id").sortWithinPartitions("doc_id", "line_no").mapInArrow(run, StructType([*lines.schema.fields, StructField(name, number)]))


def expandable_above(lines: DataFrame, kinds: tuple[str, ...] = ("button", "tab", "menuitem")) -> DataFrame:
    """For each line (doc_id, line_no, indent, kind), its parent in a menu: of the lines that can be opened, the latest one at the greatest
    indent below its own; null if there is none. A line that can be opened ends those before it that are as deep or deeper; others end none."""

    def step(opened: list, indent: int | None, line: int, kind: str) -> int | None:
        if indent is None:
            return None
        at = bisect_left(opened, indent, key=lambda x: x[0])
        above = opened[at - 1][1] if at else None
        if kind in kinds:
            del opened[at:]
            opened.append((indent, line))
        return above

    return _in_order(lines, "parent_line", step)


def nearest_above(lines: DataFrame) -> DataFrame:
    """For each line (doc_id, line_no, indent, kind), the nearest earlier one of smaller indent: parent_line; null at the top. A line without
    an indent has no parent and is none."""

    def step(opened: list, indent: int | None, line: int, kind: str) -> int | None:
        if indent is None:
            return None
        while opened and opened[-1][0] >= indent:
            opened.pop()
        above = opened[-1][1] if opened else None
        opened.append((indent, line))
        return above

    return _in_order(lines, "parent_line", step)


def nearby_links(lines: DataFrame) -> DataFrame:
    """For each line (doc_id, line_no, indent, kind), the latest earlier link of the same or a smaller indent: link_line; null if there is none.
    Links that a later one of no greater indent hides are never the latest again, so those that are kept have rising indents."""

    def step(opened: list, indent: int | None, line: int, kind: str) -> int | None:
        if indent is None:
            return None
        at = bisect_right(opened, indent, key=lambda x: x[0])
        found = opened[at - 1][1] if at else None
        if kind == "link":
            del opened[bisect_left(opened, indent, key=lambda x: x[0]) :]
            opened.append((indent, line))
        return found

    return _in_order(lines, "link_line", step)


def carried_headings(lines: DataFrame) -> DataFrame:
    """Links with the last heading or button of fewer than 30 characters before them in their document, until a line that is no such one
    returns to its indent or a smaller one; then null."""
    in_order = Window.partitionBy("doc_id").orderBy("line_no")
    opens = F.col("kind").isin("heading", "button") & (F.length("text") < 30)
    rows = lines.withColumn("_at", F.last(F.when(opens, F.struct(F.col("line_no").alias("line"), F.col("indent").alias("indent"), F.col("text").alias("text"))), ignorenulls=True).over(in_order))
    closed = F.max(~opens & (F.col("indent") <= F.col("_at.indent"))).over(Window.partitionBy("doc_id", "_at.line").orderBy("line_no"))
    rows = rows.withColumn("_closed", F.coalesce(closed, F.lit(False)))
    return rows.withColumn("heading", F.when(~F.col("_closed"), F.col("_at.text"))).where("kind = 'link'").drop("_at", "_closed")


def near_offsets(left: DataFrame, right: DataFrame, before: int = 100, after: int = 200) -> DataFrame:
    """Pairs of one document whose right position lies within [-before, +after] of the left one. Both sides are cut into bins of the window's width,
    so the join is an equality on document and bin."""
    width = before + after
    bins = left.withColumn("bin", F.explode(F.sequence(F.floor((F.col("at") - before) / width), F.floor((F.col("at") + after) / width))))
    other = right.withColumnRenamed("at", "other_at").withColumn("bin", F.floor(F.col("other_at") / width))
    return bins.join(other, ["doc_id", "bin"]).where((F.col("other_at") >= F.col("at") - before) & (F.col("other_at") <= F.col("at") + after)).drop("bin")


def fanned_out(categories: DataFrame, work: DataFrame) -> DataFrame:
    """The result of each distinct URL, for all categories that share it."""
    return categories.join(work, "url", "left")


def line_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document of (doc_id, text), the lines that went and came, and whether three or more did both."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    both = before.select("doc_id", lines(F.col("text")).alias("old")).join(after.select("doc_id", lines(F.col("text")).alias("new")), "doc_id")
    both = both.withColumn("removed", F.size(F.array_except("old", "new"))).withColumn("added", F.size(F.array_except("new", "old")))
    return both.select("doc_id", "removed", "added", ((F.col("removed") >= 3) & (F.col("added") >= 3)).alias("replaced"))


def stratified(links: DataFrame, size: int = 50) -> DataFrame:
    """At most `size` links (pos, lineage): one of each lineage first, then the rest in order."""
    ranked = links.withColumn("again", (F.row_number().over(Window.partitionBy("lineage").orderBy("pos")) > 1).cast("int"))
    return ranked.orderBy("again", "pos").limit(size).withColumn("position", F.row_number().over(Window.orderBy("again", "pos"))).drop("again")
