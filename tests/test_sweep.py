"""The derived sweep against its SQL, to the last bit: depths lie on the ends of bands."""

import duckdb
from cloudloom.plans import catalogue
from cloudloom.sources.fixtures import SCAN_SQL, scan


def orders(folder):
    """Every azimuth of every ring, with depths on the bands' ends and one key each that the sensor hasn't."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT range AS o_orderkey, CASE WHEN range % 2000 IN (0, 250) THEN 679 * (range // 2000 % 3) ELSE range * 7919 % 100000 END / 100 AS o_totalprice
      FROM range(-3, 128000)) TO '{folder}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{folder}/orders.parquet')")
    return con


def test_sweep_equals_sql_in_every_bit(spark, tmp_path):
    con = orders(tmp_path)
    want = con.execute(f"WITH {SCAN_SQL} SELECT point_id, frame_id, ring, az, x, y, z FROM scan ORDER BY 1").fetchall()
    got = scan(spark, str(tmp_path)).select("point_id", "frame_id", "ring", "az", "x", "y", "z").orderBy("point_id").collect()
    assert [tuple(r) for r in got] == want


def test_depths_on_the_ends_of_bands(spark, tmp_path):
    con = orders(tmp_path)
    for name in ("q_depth_bands", "q_quantise_spherical", "q_line_runs"):
        want = con.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in want.description]
        assert sorted(map(str, map(tuple, catalogue.queries()[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(str, want.fetchall()))
