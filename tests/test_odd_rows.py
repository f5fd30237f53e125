"""Queries against their SQL on rows that the supplied tables seldom hold."""

import duckdb
import pytest

from lumenspan import catalog
from tests.test_queries import rows


@pytest.fixture
def agree(spark, tmp_path):
    """Does a query give its SQL's rows on tables given as SQL by name?"""

    def check(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.sql(f"copy ({sql}) to '{tmp_path}/{t}.parquet'")
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
        got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.ORACLES[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns and len(want) > 0
        assert rows(got, columns) == rows(want, columns)

    return check


def events(values):
    """Events of one user with the given values and kinds in order."""
    listed = ", ".join(f"({i}, {v}, '{k}')" for i, (v, k) in enumerate(values))
    return f"select i::bigint as event_id, 1::bigint as user_id, timestamp '2024-01-01' + to_seconds(i) as ts, v::double as value, k as event_type from (values {listed}) t(i, v, k)"


def test_tracking_guard_after_zero_and_missing(agree):
    agree("flt24_tracking_guard", events=events([(5, "view"), (0, "view"), (0, "view"), (4, "purchase"), ("null", "view"), (3, "view"), (-2, "view"), (0, "view"), ("null", "view"), (2, "view"), (2.2, "purchase"), (3, "purchase")]))


@pytest.mark.parametrize("name", ["join06_same_plane", "set06_plane_groups", "join07_group_representative"])
def test_planes_of_small_and_large_runs(agree, name):
    """A run of 150 planes is met by cells, those of three are compared whole."""
    agree(name, orders="select i::bigint as o_orderkey, (case when i < 150 then 0 else i // 3 end)::bigint as o_custkey from range(300) t(i)")


def test_plane_pairs_are_never_broadcast(spark):
    from pyspark.sql import functions as F

    from lumenspan.operators.planes import same_plane

    k = F.col("id")
    p = spark.range(90).select((k % 2).alias("run"), k.alias("idx"), F.array(k % 3 * 0.02, k % 5 * 0.01, F.lit(-1.0)).alias("normal"), F.array(k % 5 * 10.0, k % 7 * 10.0, 500 + k % 4 * 3.0).alias("centre"))
    by_cells, whole = same_plane(p, few=1), same_plane(p, few=100)
    assert "Broadcast" not in by_cells._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, by_cells.collect()))
    assert len(found) > 100 and found == sorted(map(tuple, whole.collect()))


def test_stable_zeros_are_depths(agree):
    agree("agg16_nan_median", events=events([(0, "view"), (5, "view"), (7, "error"), (0, "click"), (9, "view")]))


def test_halves_of_commands(agree):
    """Every half of a hundredth up to 100, and what lies beside it."""
    agree("str03_pose_command", orders="select i::bigint as o_orderkey, (i * 50 + case i % 5 when 3 then 0.01 when 4 then -0.01 else 0 end)::double as o_totalprice from range(-20000, 20000) t(i)")


def test_more_than_a_hundred_runs_of_a_day(agree):
    agree("str15_run_name", orders="select i::bigint as o_orderkey, timestamp '2000-01-01' as o_orderdate from range(1203) t(i)")


def test_patches_beyond_four_digits(agree):
    agree("snk18_patch_names", embeddings="select i::bigint as vec_id from range(9990, 123456, 7) t(i)")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_golden_search_is_one_of_a_size(agree, spark, tmp_path):
    agree("mth14_golden_minimum", part="select i::bigint as p_partkey, case when i % 9 < 8 then i % 9 * 10 end::int as p_size from range(100) t(i)")
    assert "HashAggregate(keys=[size" in plan(catalog.QUERIES["mth14_golden_minimum"](spark, str(tmp_path)))


@pytest.mark.parametrize("states", ["F", "O", "FO"])
def test_heatmap_limits_are_counted(agree, spark, tmp_path, states):
    agree("mth34_heatmap_normalise", lineitem=f"select i::bigint as l_orderkey, 1 as l_linenumber, i::bigint as l_partkey, i::bigint as l_suppkey, substr('O{states}', 1 + (i % {1 + len(states)})::int, 1) as l_linestatus, case when i % 50 > 0 then i * 1.25 end::double as l_extendedprice from range(700) t(i)")
    assert "percentile(" not in plan(catalog.QUERIES["mth34_heatmap_normalise"](spark, str(tmp_path)))


def test_plane_documents_are_written_small(spark, tmp_path):
    import glob
    import os

    from lumenspan.session import shared_dir

    folders = f"{shared_dir(spark)}/lumenspan/planes-*"
    known = set(glob.glob(folders))
    n = catalog.QUERIES["snk12_plane_result"](spark, "/root/testdata/sf0.001").count()
    (folder,) = set(glob.glob(folders)) - known
    assert n > 1000 and sum(os.path.getsize(f) for f in glob.glob(f"{folder}/part-*")) < 100 * n


def test_heights_twice_and_missing(agree):
    agree("flt11_z_config", lineitem="select (i // 5)::bigint as l_orderkey, (i % 7 * case when i % 11 = 0 then null else 1 end)::int as l_linenumber, i::bigint as l_partkey, 1::bigint as l_suppkey, 5.0::double as l_quantity, 0.0::double as l_discount, 0.0::double as l_tax, 1.0::double as l_extendedprice, 'A' as l_returnflag from range(400) t(i)")
