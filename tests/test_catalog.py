"""Every query of the catalog against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.plans.every import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(float(value), 4) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in names]).collect()), key=key)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)
