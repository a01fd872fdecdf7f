"""Every registered reference query against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from veilspark.plans import catalog


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 5) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else str(v) if not isinstance(v, (int, str)) else v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE:
        assert df.columns
        return
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = con.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, got) == _rows(names, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries())
