"""Hard-negative mining by a Voronoi-partitioned distributed nearest-neighbour join.

Rows are vectors of integers. To search by inner product, vectors get one more component, sqrt(M^2 - |x|^2), with M the largest norm, and
anchors a 0 there: all augmented vectors then lie on one sphere, and the nearest of an anchor is the one of the highest inner product.
Each vector goes to the cell of its nearest pivot; a cell is known by the range of its angles to the pivot. Anchors are dealt into groups
of neighbouring cells. By the triangle inequality on angles, a cell has a highest score for an anchor, so it is replicated only to groups
with an anchor that it might still serve, and there an exact local join finds the best rows.

There are two searches, each of two passes: the first joins a group with the cells of its own anchors and so finds thresholds that are
actual scores, the second brings in the cells whose bound reaches a threshold. The first search finds the positives, the second, within
the range of scores that each positive allows, the negatives. Results are exact: bounds only leave out what can't change them.

A group has about GROUP anchors at most, and what is replicated to it is dealt over tiles of about TILE rows, so a cell, a label or a group
of equal vectors may hold any share of all rows; lists of a few best rows for each tile are merged. Only pivots and the table of cells, at
most PIVOTS rows each, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.common import join_checked, read, staged

#: Cells; pivots are so many rows, chosen by a hash.
PIVOTS = 128
#: Anchors of a group, and rows of a tile, about.
GROUP, TILE = 8192, 16384
#: Anchors that are scored against a tile at once.
SLAB = 64
#: Scores stay below 2^56, so that they can be multiplied by percentages in 64 bits: a row with a component above 2^28 / sqrt(length) takes no part.
_COMPONENT_BITS = 28
_LOW = np.int64(-(1 << 62))


@dataclass
class Vectors:
    """Integer vectors, by length: (places, matrix) for each length that occurs."""

    n: int
    parts: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, column: pa.Array) -> Vectors:
        """From binary values of little-endian 32-bit integers."""
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        places = [np.flatnonzero(size == s) for s in np.unique(size)]
        return cls(len(column), [(at, np.stack([data[offsets[i] : offsets[i + 1]] for i in at]).view("<i4").reshape(len(at), -1)) for at in places])

    def norms2(self) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for at, m in self.parts:
            out[at] = (m.astype(np.int64) ** 2).sum(axis=1)
        return out

    def slab(self, start: int, end: int) -> Vectors:
        return Vectors(end - start, [(at[keep] - start, m[keep]) for at, m in self.parts if (keep := (at >= start) & (at < end)).any()])

    def products(self, other: Vectors, largest: float) -> np.ndarray:
        """Exact inner products over the components that both have. largest: a bound of all products of norms, which bounds partial sums too."""
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
        out = np.zeros((self.n, other.n), kind)
        for at, m in self.parts:
            for to, o in other.parts:
                k = min(m.shape[1], o.shape[1])
                out[np.ix_(at, to)] = m[:, :k].astype(kind) @ o[:, :k].T.astype(kind)
        return out


def usable(rows: DataFrame, vec_id: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """vec_id, label and v (the vector as 32-bit integers) of the rows that take part: those with an id, a label and a vector of numbers that
    fit. vector: an array of long."""
    named = (F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").alias("vector"))
    rows = rows.select(*named).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat, size = lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64)
            row, value = np.repeat(np.arange(len(batch)), size), np.asarray(flat.fill_null(0))
            good = np.asarray(flat.is_valid()) & (np.abs(value.astype(float)) <= (1 << _COMPONENT_BITS) / np.sqrt(np.maximum(size, 1))[row])
            fits = np.bincount(row[~good], minlength=len(batch)) == 0
            ends = np.concatenate([[0], np.cumsum(size[fits])]) * 4
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), int(fits.sum()), [None, pa.py_buffer(ends), pa.py_buffer(value[fits[row]].astype("<i4").tobytes())]).cast(pa.binary())
            kept = batch.filter(pa.array(fits))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), packed, pa.array(Vectors.of(packed).norms2())], ["vec_id", "label", "v", "norm2"])

    return rows.mapInArrow(run, "vec_id long, label long, v binary, norm2 long")


@dataclass
class Cells:
    """Pivots (augmented vectors) and what is known of their cells: rows, and the least and the largest angle to the pivot."""

    pivots: pa.Array
    norm: float
    rows: np.ndarray
    least: np.ndarray
    largest: np.ndarray

    def angles(self, v: Vectors, anchors: bool) -> np.ndarray:
        """From vectors (anchors have a 0 for their last component) to pivots; an anchor of norm 0 is at a right angle to everything."""
        pivots = Vectors.of(self.pivots)
        own, n2, top = v.norms2().astype(float), pivots.norms2().astype(float), self.norm**2
        dot = v.products(pivots, self.norm * self.norm).astype(float)
        if not anchors:
            dot = dot + np.sqrt(np.maximum(0, top - own))[:, None] * np.sqrt(np.maximum(0, top - n2))[None, :]
        length = (np.sqrt(own) if anchors else np.full(v.n, self.norm))[:, None] * self.norm
        return np.arccos(np.clip(np.divide(dot, length, out=np.zeros_like(dot), where=length > 0), -1, 1))

    def bounds(self, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the highest score of any row of each cell, for anchors at the given angles to the pivots; with room for rounding."""
        nearest = np.maximum(0, np.maximum(angles - self.largest, self.least - angles))
        furthest = np.minimum(np.pi, angles + self.largest)
        scale = (norms * self.norm)[:, None]
        slack = 1 + scale * 1e-6
        return scale * np.cos(furthest) - slack, scale * np.cos(nearest) + slack


def _in_cells(rows: DataFrame, pivots: pa.Array, norm: float) -> tuple[DataFrame, Cells]:
    """rows with cell, and the table of cells."""
    blank = np.zeros(len(pivots))
    cells = Cells(pivots, norm, blank, blank, blank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), TILE):
                part = batch.slice(start, TILE)
                angles = cells.angles(Vectors.of(part.column("v")), anchors=False)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], [*part.schema.names, "cell", "angle"])

    placed = staged(rows.mapInArrow(run, "vec_id long, label long, v binary, norm2 long, cell int, angle double"), "cells")
    table = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("least"), F.max("angle").alias("largest")).collect()}
    of = lambda name: np.array([float(table[i][name]) if i in table else 0.0 for i in range(len(pivots))])
    return placed, Cells(pivots, norm, of("rows"), of("least"), of("largest"))


def _grouped(anchors: DataFrame, cells: Cells) -> DataFrame:
    """anchors (vec_id, label, v, norm2) with key, a number of their own, home (the nearest pivot's cell) and grp. Cells go to the nearest of
    as many pivots as it takes groups, and a group of too many anchors is cut by a hash."""
    groups = max(1, min(len(cells.pivots), -(-anchors.count() // GROUP)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = cells.angles(Vectors.of(cells.pivots), anchors=False)[:, :groups].argmin(axis=1).astype(np.int32)
        for batch in batches:
            home = cells.angles(Vectors.of(batch.column("v")), anchors=True).argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(near[home])], [*batch.schema.names, "home", "region"])

    placed = staged(anchors.select("vec_id", "label", "v", "norm2").mapInArrow(run, "vec_id long, label long, v binary, norm2 long, home int, region int").withColumn("key", F.monotonically_increasing_id()), "anchors")
    parts = placed.groupBy("region").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    return staged(placed.join(F.broadcast(parts), "region").withColumn("grp", F.hash("region", F.pmod(F.hash("key"), "parts"))).drop("region", "parts"), "anchor-groups")


def _serving(anchors: DataFrame, cells: Cells) -> DataFrame:
    """(grp, cell) where the cell may have a row that scores between `from` and `to` for an anchor of the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = np.sqrt(np.asarray(batch.column("norm2")).astype(float))
            low, high = cells.bounds(cells.angles(Vectors.of(batch.column("v")), anchors=True), norms)
            may = (high >= np.asarray(batch.column("from"))[:, None]) & (low <= np.asarray(batch.column("to"))[:, None]) & (cells.rows > 0)
            i, cell = np.nonzero(may)
            pairs = np.unique(np.stack([np.asarray(batch.column("grp"))[i], cell]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1].astype(np.int32))], ["grp", "cell"])

    return anchors.select("grp", "v", "norm2", "from", "to").mapInArrow(run, "grp int, cell int").distinct()


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k best allowed places of each row, best first: (rows, places). Of equal scores the first place wins."""
    rows, left = np.arange(len(scores)), np.where(allowed, scores, -np.inf if scores.dtype.kind == "f" else _LOW)
    for _ in range(min(k, scores.shape[1])):
        at = left.argmax(axis=1)
        found = left[rows, at] > (-np.inf if scores.dtype.kind == "f" else _LOW)
        if not found.any():
            return
        yield rows[found], at[found]
        left[rows, at] = -np.inf if scores.dtype.kind == "f" else _LOW


@dataclass
class Search:
    """What is searched for: rows of the anchor's label, or of others, `best` of them for each wanted range of scores."""

    same_label: bool
    best: int


def _join(anchors: DataFrame, rows: DataFrame, served: DataFrame, cells: Cells, search: Search) -> DataFrame:
    """key, nth (of the anchor's ranges), vec_id and score of the best rows of each tile. anchors: key, grp, vec_id, label, v, norm2 and ranges,
    an array of (least, most) scores. served: the written pairs (grp, cell)."""
    sizes = rows.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(cells.rows)], "cell int, rows long")
    tiles = served.join(F.broadcast(sizes), "cell").groupBy("grp").agg(F.ceil(F.sum("rows") / TILE).cast("int").alias("tiles"))
    served = staged(join_checked(served, tiles, ["grp"], "inner"), "served")
    tile = F.pmod(F.xxhash64("vec_id", "v"), F.col("tiles")).cast("int").alias("tile")
    given = join_checked(rows.select("cell", "vec_id", "label", "v"), served, ["cell"], "inner").select("grp", tile, "vec_id", "label", "v")
    dealt = join_checked(anchors, served.select("grp", "tiles").distinct(), ["grp"], "inner").select("grp", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "key", "vec_id", "label", "v", "norm2", "ranges")
    names, norm, same, best = ["key", "nth", "vec_id", "score"], cells.norm, search.same_label, search.best

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(left) and len(right):
            right = right.take(pa.array(np.argsort(np.asarray(right["vec_id"]), kind="stable")))
            own, others = Vectors.of(left["v"].combine_chunks()), Vectors.of(right["v"].combine_chunks())
            key, ids, other_ids = (np.asarray(t[c]) for t, c in ((left, "key"), (left, "vec_id"), (right, "vec_id")))
            label, other_label = np.asarray(left["label"]), np.asarray(right["label"])
            ranges = left["ranges"].combine_chunks()
            ends = np.concatenate([[0], np.cumsum(np.asarray(ranges.value_lengths()))])
            least, most = (np.asarray(ranges.flatten().field(c)) for c in ("least", "most"))
            largest = norm * float(np.sqrt(np.asarray(left["norm2"]).max()))
            for start in range(0, len(left), SLAB):
                end = min(len(left), start + SLAB)
                scores = own.slab(start, end).products(others, largest)
                fit = ((label[start:end, None] == other_label[None, :]) == same) & (ids[start:end, None] != other_ids[None, :])
                for nth in range(int(np.diff(ends[start : end + 1]).max())):
                    at = ends[start:end] + nth
                    has = at < ends[start + 1 : end + 1]
                    at = np.where(has, at, 0)
                    allowed = fit & has[:, None] & (scores >= least[at][:, None]) & (scores <= most[at][:, None])
                    for i, j in _best(scores, allowed, best):
                        for x, values in zip(out, (key[start + i], np.full(len(i), nth, np.int32), other_ids[j], scores[i, j].astype(np.int64)), strict=True):
                            x.append(values)
        kinds = (np.int64, np.int32, np.int64, np.int64)
        return pa.table([pa.array(np.concatenate(x) if x else np.zeros(0, t)) for x, t in zip(out, kinds, strict=True)], names=names)

    return dealt.groupBy("grp", "tile").cogroup(given.groupBy("grp", "tile")).applyInArrow(run, "key long, nth int, vec_id long, score long")


def _merged(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("key", "nth").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _search(anchors: DataFrame, rows: DataFrame, cells: Cells, search: Search) -> DataFrame:
    """key, nth, rank, vec_id, score: for each range of each anchor its best rows, exactly. anchors: as for _join, with home."""
    own = staged(anchors.select("grp", F.col("home").alias("cell")).distinct(), "own-cells")
    first = staged(_merged(_join(anchors, rows, own, cells, search), search.best), "first-pass")
    #: A range that has all of its rows needs only what scores as much as the last of them; a tie may still have a smaller id.
    last = first.where(F.col("rank") == search.best).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("nth", "score"))).alias("last"))
    reached = F.transform("ranges", lambda r, i: F.struct(F.greatest(r["least"], F.coalesce(F.try_element_at("last", i), r["least"])).alias("least"), r["most"].alias("most")))
    left = anchors.join(last, "key", "left").withColumn("last", F.coalesce("last", F.create_map().cast("map<int,bigint>"))).withColumn("ranges", reached).drop("last")
    left = staged(left.withColumns({"from": F.array_min(F.transform("ranges", lambda r: r["least"])), "to": F.array_max(F.transform("ranges", lambda r: r["most"]))}), "second-pass")
    rest = staged(_serving(left, cells).join(own, ["grp", "cell"], "left_anti"), "rest")
    if rest.isEmpty():
        return first
    found = _join(left.drop("from", "to"), rows, rest, cells, search)
    return staged(_merged(first.drop("rank").unionByName(found), search.best), "found")


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best `positives` other rows of
    its label, the best `negatives` rows of other labels that score between low and high percent of that positive.

    rows: vec_id, label, vector (array of long); anchors: a condition on vec_id and label. Higher inner products are better, ties go to the
    smaller id. Rows without id, label or vector, with a null component, or with components of which a score might not fit (`usable`) take
    no part. Rows of an anchor's vec_id aren't other rows; apart from that, repeated rows each count, as do repeated anchors. Vectors of
    different lengths are compared over the components that both have. A positive with a negative score has no negatives (the range is
    empty). Other columns are ignored. Without anchors, or rows that serve them: no rows.
    """
    spark = rows.sparkSession
    numbered = staged(usable(rows), "vectors")
    anchor_rows = numbered.where(anchors)
    top = numbered.agg(F.max("norm2")).first()[0]
    if top is None or anchor_rows.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    pivots = pa.array([bytes(r["v"]) for r in numbered.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(PIVOTS).collect()], pa.binary())
    placed, cells = _in_cells(numbered, pivots, float(np.sqrt(float(top))))
    grouped = _grouped(anchor_rows, cells)
    lowest, highest = F.lit(int(_LOW)), F.lit(int(-_LOW))
    wanted = grouped.withColumn("ranges", F.array(F.struct(lowest.alias("least"), highest.alias("most"))))
    positive = _search(wanted, placed, cells, Search(True, positives)).select("key", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    positive = staged(positive, "positives")
    #: ceil(low * score / 100) and floor(high * score / 100), of scores that aren't negative.
    ranges = F.struct(F.expr(f"({low} * positive_score + 99) DIV 100").alias("least"), F.expr(f"({high} * positive_score) DIV 100").alias("most"), F.col("nth").alias("of"))
    allowed = positive.where("positive_score >= 0").groupBy("key").agg(F.array_sort(F.collect_list(ranges)).alias("r")).select("key", F.transform("r", lambda r: F.struct(r["least"].alias("least"), r["most"].alias("most"))).alias("ranges"), F.transform("r", lambda r: r["of"]).alias("of"))
    asked = staged(grouped.join(allowed, "key"), "ranges")
    negative = _search(asked.drop("of"), placed, cells, Search(False, negatives))
    named = negative.join(asked.select("key", F.col("vec_id").alias("anchor_id"), "of"), "key").withColumn("nth", F.get("of", F.col("nth")))
    out = named.select("key", "anchor_id", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(positive, ["key", "nth"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 50, among all; components are taken in 256ths, and the labels of ids
    divisible by 7 are moved by one. A component that isn't finite (or is beyond all bounds) is null, so its row takes no part."""
    rows = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.when(F.abs(x) < float(1 << 40), F.floor(256 * x.cast("double")))).alias("vector"),
    )
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
