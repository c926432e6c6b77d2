"""Queries and their SQL on events with keys as large as many copies of the tables have: users from 65536 on, and times after NOW."""

import pytest

import __spark_entry__ as e

NAMES = "fun_10_time prj_17_arrow prj_19_32_packs prj_21_asa prj_29_snort prj_33_normalise udf_02_specs joi_12_asa_pairs joi_12_asa_lines prj_11_roles prj_16_17_infer".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_on_large_keys(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (event_id + i * 100000 AS event_id, user_id + i * 1500 AS user_id) FROM '/root/testdata/sf0.001/events.parquet', unnest([0, 43, 59]) t(i) WHERE event_id < 60 ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)".replace("SELECT * REPLACE", "SELECT * EXCLUDE (i) REPLACE"))
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = e.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and want
