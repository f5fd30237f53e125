"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lumenspan import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def value(x):
    x = x.tolist() if hasattr(x, "tolist") else x
    if isinstance(x, (list, tuple)):
        return [value(y) for y in x]
    if x is None or (not isinstance(x, str) and pd.isna(x)):
        return None
    return int(x) if isinstance(x, float) and abs(x) < 1e15 and x == int(x) else x


def rows(pdf, columns):
    return sorted(repr([value(x) for x in r]) for r in pdf[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_frames_grow_in_number_and_stay_mixed(spark):
    from pyspark.sql import functions as F

    from lumenspan.plans import kernels

    size = kernels.H * kernels.W_
    for sf, frames in (("sf0.001", 2), ("sf0.01", 20), ("sf0.1", 196)):
        got = kernels.rasters(spark, f"/root/testdata/{sf}").groupBy("frame").agg(F.count("*").alias("known"), F.count_if("set").alias("on")).toPandas()
        assert len(got) == frames
        whole = got[got["frame"] < frames - 2] if frames > 2 else got
        assert whole["known"].between(0.6 * size, 0.9 * size).all() and whole["on"].between(0.4 * size, 0.75 * size).all()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
