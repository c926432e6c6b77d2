"""The stream of windows over a folder of files: equal to its SQL, and its rows are files."""


def test_windows_of_many_files_equal_their_sql_and_stay_out_of_the_driver(spark, tmp_path):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    (tmp_path / "events.parquet").mkdir()
    for i in (1, 0):
        con.execute(f"COPY (SELECT * REPLACE (event_id + {i} * 1000000 AS event_id, user_id + {i} * 90000 AS user_id, ts + INTERVAL {i * 30} DAY AS ts) FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet/part-{1 - i}.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = e.queries()["str_04_windows"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({e.oracle_sql()['str_04_windows']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 1000
    assert got.inputFiles()


def test_windows_do_not_depend_on_the_zone_of_the_session(spark):
    import __spark_entry__ as e

    run = lambda: sorted(map(tuple, e.queries()["str_04_windows"](spark, "/root/testdata/sf0.001").collect()))
    want = run()
    spark.conf.set("spark.sql.session.timeZone", "America/St_Johns")
    try:
        assert run() == want and len(want) > 500
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
