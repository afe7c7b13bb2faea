"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from covenant.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    expected = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=key)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == expected


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 1000
