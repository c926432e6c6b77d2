from sentrylake.streaming.dead_letters import DeadLetters


def test_entries_of_many_waves_are_one_read(spark, tmp_path):
    made = spark.range(40).selectExpr("id AS event_id", "'undeliverable' AS kind", "'down' AS reason", "6 AS attempts", "id AS at")
    s = DeadLetters(spark, f"file://{tmp_path}/dead", wave=4)
    assert s.append(made.repartition(2), "a") and s.append(made.selectExpr("*", "1 AS more"), "b")
    rows = s.entries()
    assert rows.count() == 80 and rows.filter("more = 1").count() == 40
    assert "Union" not in rows._jdf.queryExecution().toString()
