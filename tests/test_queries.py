"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from colligo import plans

SF = "/root/testdata/sf0.001"


def tidy(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d.columns:
        numbers = pd.to_numeric(d[c], errors="coerce") if d[c].dtype != object or d[c].map(lambda v: isinstance(v, int | float)).any() else None
        d[c] = numbers.astype(float).round(6) if numbers is not None and not str(d[c].dtype).startswith("datetime") else d[c].astype(str)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name not in plans.ORACLES:
        assert len(got)
        return
    want = duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"app_id", "status", "message"}
    assert set(plans.QUERIES) <= set(e.queries())
