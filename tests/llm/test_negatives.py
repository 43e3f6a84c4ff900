"""Hard negatives against brute force: odd rows, ties, clusters, cells and tiles of any size."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrine.llm import negatives

SCHEMA = "vec_id long, label int, vector array<long>, v string, norm2 string, cell string"


def brute(rows: list[tuple], positives: int = 5, best: int = 3) -> list[tuple]:
    most = lambda v: 2**28 / math.sqrt(max(1, len(v)))
    rows = [r for r in rows if None not in r[:3] and all(x is not None and abs(x) <= most(r[2]) for x in r[2])]
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2], strict=False))
    out = []
    for a in rows:
        if a[0] % 50:
            continue
        others = sorted(((-score(a, b), b[0], b[1]) for b in rows if b[0] != a[0]))
        for s, i, _ in [x for x in others if x[2] == a[1]][:positives]:
            fit = [x for x in others if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:best]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def found(spark, rows: list[tuple]) -> list[tuple]:
    df = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def clusters(rng: random.Random, n: int, dims: int, spread: int = 6) -> list[tuple]:
    centres = [[rng.randint(-60, 60) for _ in range(dims)] for _ in range(8)]
    rows = []
    for i in range(n):
        k = rng.randrange(8)
        rows.append((i, k if rng.random() < 0.6 else rng.randrange(4), [x + rng.randint(-spread, spread) for x in centres[k]]))
    return rows


def test_odd_rows(spark) -> None:
    rng = random.Random(13)
    rows = [(i, rng.randrange(3), [rng.randint(-9, 9) for _ in range(4)]) for i in range(160)]
    rows += [(200, None, [1, 2, 3, 4]), (250, 1, None), (300, 1, [1, None, 3, 4]), (None, 1, [1, 2, 3, 4]), (350, 1, []), (400, 2, [0, 0, 0, 0]), (450, 0, [3, 4]), (500, 1, [5, 5, 5, 5, 5, 5])]
    rows += [(550, 1, [2**40, 0, 0, 0]), (551, 2, [2**28 // 2, 1, 0, 0]), (600, 1, [7, 7, 7, 7]), (600, 1, [7, 7, 7, 7]), (7000, 1, [7, 7, 7, 7]), (601, 0, [6, 6, 6, 6]), (601, 0, [6, 6, 6, 6]), (-50, 1, [1, 1, 1, 1])]
    assert found(spark, rows) == brute(rows)
    for few in ([], rows[:1], rows[1:40], [(0, 1, [1]), (1, 1, [1])], [(50, 1, [0]), (1, 1, [0]), (2, 2, [0])]):
        assert found(spark, few) == brute(few)


@pytest.mark.parametrize("dims", [3, 16])
def test_passes_and_tiles(spark, monkeypatch, dims: int) -> None:
    """Many groups and tiles, ties by the hundred, a label and a vector with a third of all rows: both passes find what brute force finds."""
    for name, value in (("PIVOTS", 24), ("GROUP", 3), ("TILE", 120), ("SLAB", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = random.Random(dims)
    rows = [(i, 0 if i % 3 == 0 else label, [9] * dims if i % 3 == 1 else v) for i, label, v in clusters(rng, 700, dims)]
    assert found(spark, rows) == brute(rows)


def test_bounds_leave_cells_out(spark, monkeypatch) -> None:
    """Where vectors cluster, the second pass replicates few cells to few groups, and results stay whole."""
    monkeypatch.setattr(negatives, "PIVOTS", 32)
    monkeypatch.setattr(negatives, "GROUP", 8)
    served = []
    join = negatives._join
    monkeypatch.setattr(negatives, "_join", lambda anchors, rows, pairs, cells, search: served.append((pairs.count(), anchors.select("grp").distinct().count() * int((cells.rows > 0).sum()))) or join(anchors, rows, pairs, cells, search))
    rows = [(i, label % 2, v) for i, label, v in clusters(random.Random(5), 3000, 12, spread=3)]
    assert found(spark, rows) == brute(rows)
    assert sum(n for n, _ in served) < 0.5 * sum(most for _, most in served)


def test_products_are_exact() -> None:
    rng = np.random.default_rng(1)
    for top, dims in ((100, 64), (10**6, 64), (2**24, 64), (5, 3)):
        m = rng.integers(-top, top + 1, (20, dims))
        v = negatives.Vectors.of(pa.array([r.astype("<i4").tobytes() for r in m], pa.binary()))
        largest = float(np.sqrt((m.astype(object) ** 2).sum(axis=1).max())) ** 2
        assert (v.products(v, largest).astype(np.int64) == np.array(m.astype(object) @ m.T.astype(object), np.int64)).all()


def test_query_takes_no_odd_embedding(spark, tmp_path) -> None:
    """Nulls, NaN and infinities in rows, quantised and relabelled as the contract says."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(10), [rng.uniform(-1, 1) for _ in range(5)]) for i in range(300)]
    rows += [(350, 1, [math.nan] * 5), (400, 1, [math.inf, 0.0, 0.0, 0.0, 0.0]), (450, None, [0.0] * 5), (500, 2, None), (550, 2, [None, 1.0, 0.0, 0.0, 0.0]), (600, 3, [1e30, 0.0, 0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    f32 = lambda v: None if v is None or any(x is None or not math.isfinite(x) or abs(x) > 1e9 for x in v) else [math.floor(256 * float(np.float32(x))) for x in v]
    want = brute([(i, label if label is None or i % 7 else (label + 1) % 10, f32(v)) for i, label, v in rows])
    got = negatives.op13_hard_negatives(spark, str(tmp_path)).collect()
    assert sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got) == want
