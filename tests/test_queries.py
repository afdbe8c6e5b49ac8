"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SF)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = result.toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    same(plain(got), plain(want))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    """Floats are compared with a tolerance, all else exactly."""
    assert len(got) == len(want)
    for c in got.columns:
        if "f" in (got[c].dtype.kind, want[c].dtype.kind):
            pd.testing.assert_series_equal(got[c], want[c], check_dtype=False, rtol=1e-9, atol=1e-9)
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_integers_are_compared_exactly(spark, duck):
    got = plain(QUERIES["panel_newest_trades"](spark, SF).toPandas())
    rounds = plain(duck.sql(ORACLES["panel_newest_trades"].replace("epoch_us(ts) // 1000", "epoch_ms(ts)")).df())
    with pytest.raises(AssertionError):
        same(got, rounds)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
