"""Every query against its SQL on the smallest tables."""

import os
from pathlib import Path

import pandas as pd
import pytest

from weftline.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}" if v != int(v) else str(int(v))
    return str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        first, again = (sorted(map(str, df.collect())) for df in (got, QUERIES[name](spark, SF)))
        assert first and first == again  # chance is a hash: every run gives the same rows
        return
    want = con.execute(ORACLES[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if str(got[c].dtype).startswith("datetime"):
            got[c], want[c] = (x[c].astype("datetime64[us]").astype(str) for x in (got, want))
    assert rows_of(got) == rows_of(want)
