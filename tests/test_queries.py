"""Every query with SQL gives what its SQL gives on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from tidewire.plans import QUERIES, SQL


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if not isinstance(v, (int, str, bool, type(None))) else v


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(([norm(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    r = db.execute(SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(([norm(x[i]) for i in at] for x in r.fetchall()), key=repr)
