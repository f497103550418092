"""Every query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from accordance.plans import written as driver

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_query(spark, con, name):
    found = driver.QUERIES[name](spark, str(SF))
    want = con.execute(driver.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert _rows([tuple(r) for r in found.collect()], found.columns) == _rows(want.fetchall(), columns)
