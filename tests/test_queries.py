"""Every registered query of the engine against its SQL, on the small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from graphloom import plans

SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else (v.date() if type(v).__name__ == "Timestamp" else v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(name, spark, sf, db):
    df = plans.queries()[name](spark, sf)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got
    if name in SQL:
        result = db.execute(SQL[name])
        names = [d[0] for d in result.description]
        order = sorted(range(len(names)), key=lambda k: names[k])
        assert sorted(names) == sorted(df.columns)
        want = sorted((tuple(plain(r[k]) for k in order) for r in result.fetchall()), key=repr)
        assert got == want
