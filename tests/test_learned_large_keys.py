"""Layouts learned where a third of the addresses are none: the addresses that are there are read, and no other column is taken for them."""

import pytest

import __spark_entry__ as e


@pytest.mark.parametrize("name", ["prj_39_delimited", "prj_39_text"])
def test_learned_layouts_equal_their_sql_on_large_keys(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT * EXCLUDE (i) REPLACE (event_id + i * 100000 AS event_id, user_id + i * 1500 AS user_id) FROM '/root/testdata/sf0.001/events.parquet', unnest([0, 43, 59]) t(i) WHERE event_id < 100 ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = e.queries()[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {r[1] is None for r in want} == {True, False}
