"""Every query that SQL can express, against DuckDB on the smallest tables; the others run and keep their promises."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from geoloom.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got.select(*(f"`{c}`" for c in columns)).collect()) == plain([[r[i] for i in order] for r in want.fetchall()])


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_no_nested_loops(spark):
    """Spatial and range joins meet by cell: none of them compares all with all."""
    for name in ("spatial_join_box", "neighbours_30m", "ring_points", "nearest_k", "line_shadow_share", "seam_join", "vertex_junctions", "line_coverage", "snap_tracks", "row_crossings", "bilinear_samples"):
        plan = catalogue.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_bounds_reach_the_scan(spark, tmp_path):
    from geoloom.operators.features import Bounds, scan

    rows = spark.range(100).selectExpr("id", "struct(cast(id as double) as xmin, cast(id + 1 as double) as xmax, 0D as ymin, 1D as ymax) as bbox", "'x' as unused")
    rows.write.parquet(str(tmp_path / "f"))
    found = scan(spark.read.parquet(str(tmp_path / "f")), Bounds(10, 0, 12, 1), ["id"], box="bbox").select("id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "bbox.xmin" in plan and "unused" not in plan
    assert sorted(r.id for r in found.collect()) == [10, 11]


def test_first_of_a_part_is_the_sql_s(spark, tmp_path):
    """A y may weigh more than a step of x in the SQL's order: 20.125, 136.125 comes after 20.25, 10.25."""
    from geoloom.plans import feature_queries

    part = next(p for p in range(200) if p * 37 % 200 == 20)
    sql = f"""SELECT * FROM (VALUES (96, {part}, 1), (110, {part}, 2)) t(l_orderkey, l_partkey, l_linenumber)"""
    duckdb.sql(f"COPY (SELECT l_orderkey::BIGINT AS l_orderkey, l_partkey::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, l_linenumber::INT AS l_linenumber, 7.0::DOUBLE AS l_quantity, 'A' AS l_returnflag, 'O' AS l_linestatus FROM ({sql})) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.execute(catalogue.oracle_sql()["scan_first_wins"]).fetchall()
    assert [tuple(r) for r in feature_queries.scan_first_wins(spark, str(tmp_path)).collect()] == want == [(part, 7.0, 20.25)]
