"""Every query that has SQL gives its rows; the others give some."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from vitrine import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    out = duckdb.connect()
    out.sql("SET timezone='UTC'")
    for t in TABLES:
        if Path(f"{SF}/{t}.parquet").exists():
            out.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return out


def shown(value: object) -> object:
    return "" if value is None or isinstance(value, float) and math.isnan(value) else round(value, 6) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name: str) -> None:
    df = plans.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in plans.oracle_sql():
        assert rows
        return
    want = con.sql(plans.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    expected = sorted((tuple(shown(r[i]) for i in order) for r in want.fetchall()), key=str)
    assert sorted((tuple(shown(r[c]) for c in columns) for r in rows), key=str) == expected
