"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os
from collections import Counter

import duckdb
import pytest

from halocline import queries, queries_more  # noqa: F401
from halocline.functions import scalars
from halocline.operators import metrics

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f"{float(value):.5g}" if value else "0"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = Counter(tuple(plain(r[k]) for k in order) for r in cursor.fetchall())
    got = Counter(tuple(plain(x) for x in r) for r in found.select(*columns).collect())
    assert sum(got.values()) == sum(expected.values())
    assert got == expected


def test_density_ratio_weighs_points_in_bands(spark):
    rows = [(1, 2.0, 1.0, 0.0, 10, "data"), (2, 4.0, -1.0, 0.1, 30, "data"), (3, 3.0, 1.0, 0.05, 50, "noise"), (4, 9.0, 1.0, 3.0, 70, "noise"), (5, 9.0, 0.1, 0.0, 90, "noise"), (6, 1.0, None, 0.0, 5, "data")]
    ridges = spark.createDataFrame(rows, "id int, l double, xi_bar double, omega_bar double, npoints int, kind string")
    found = {r.id: r.rho for r in metrics.density_ratio_significance(ridges, 2, 4).collect()}
    assert found == {1: pytest.approx((50 / 4) / (40 / 2)), 2: 0.0, 6: None}
    assert metrics.density_ratio_significance(ridges.where("kind = 'noise'"), 2, 4).count() == 0


def test_direction_is_below_360(spark):
    rows = [(0.0, 1.0, 0.0), (1.0, 0.0, 90.0), (0.0, -1.0, 180.0), (-1.0, 0.0, 270.0), (-1e-17, 1.0, 0.0), (1e-17, 1.0, 0.0)]
    currents = spark.createDataFrame(rows, "u double, v double, towards double")
    found = currents.select(scalars.direction_towards(currents.u, currents.v).alias("got"), "towards").collect()
    assert all(0 <= r.got < 360 and r.got == pytest.approx(r.towards, abs=1e-9) for r in found)


def test_direction_of_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert queries.QUERIES["p9_direction"](spark, SF).count() == events


def test_direction_of_currents_without_speed(spark, tmp_path):
    rows = [(1000 * i + k, k, value) for i, value in enumerate([0.0, -0.0, 5e-324, 1e-300, 2.11, -2.11, 1e300, None]) for k in range(100)]
    events = spark.createDataFrame([(n, n, value, f'{{"k": {k}}}') for n, k, value in rows], "event_id long, user_id long, value double, props string")
    events.selectExpr("*", "TIMESTAMP_NTZ '2024-01-01' AS ts").write.parquet(str(tmp_path / "events.parquet"))
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        expected = dict(connection.execute(queries.ORACLE_SQL["p9_direction"]).fetchall())
    found = {r.event_id: r.towards for r in queries.QUERIES["p9_direction"](spark, str(tmp_path)).collect()}
    assert len(found) == len(rows) and found == expected
    assert [found[k] for k in (12, 35, 70, 98)] == [0, 0, 180, 180]
    zeros = spark.createDataFrame([(u, v) for u in (0.0, -0.0) for v in (0.0, -0.0)], "u double, v double")
    assert [r[0] for r in zeros.select(scalars.direction_from(zeros.u, zeros.v)).collect()] == [180, 0, 180, 0]


def test_depth_at_a_latitude(spark):
    depths = spark.sql("SELECT 10000 AS p, 30 AS lat UNION ALL SELECT 10000, 0")
    found = [r[0] for r in depths.select(scalars.pressure_to_depth(depths.p, depths.lat)).collect()]
    assert found == [pytest.approx(9712.653, abs=1e-3), pytest.approx(9725.47, abs=0.1)]  # the first is UNESCO's check value


def test_all_keys_of_current_ellipses(spark):
    assert len(queries.QUERIES["a5_current_ellipse_metrics_all"](spark, SF).columns) == 1 + 19
