import random

from sentrylake.operators import features
from sentrylake.streaming.connections import rocksdb
from sentrylake.streaming.features import feature_stream

EVENT = (
    "time long, class_uid int, status_id int, action_id int, disposition_id int, src_ip string, dst_ip string, dst_hostname string, dst_port int, bytes_in long, bytes_out long, user_name string, "
    "device_hostname string, sender_ip string, fields_verified boolean, time_source string, sequence_num long"
)


def events(n):
    rng = random.Random(4)
    for i in range(n):
        yield (
            i * 7_000 + rng.randint(-5_000, 5_000) + 1_000_000, rng.choice([4001, 3002, 2004]), rng.choice([1, 2, None]), rng.choice([None, 2]), rng.choice([1, 2, 6, None]), rng.choice(["a", "b", "c", None]),
            rng.choice([f"d{rng.randint(0, 9)}", None]), rng.choice([None, "h1", "h2"]), rng.choice([None, 22, 80, 443]), rng.choice([None, 5]), rng.choice([None, 7]), "u", None, "s", rng.choice([True, False, None]),
            rng.choice(["device", "received", None]), i,
        )


def test_the_stream_says_what_the_table_says(spark, tmp_path):
    rows = list(events(600))
    for i in range(0, 600, 150):
        spark.createDataFrame(rows[i : i + 150], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{i:04d}")
    late = (1_000_000, *rows[0][1:5], "a", *rows[0][6:])  # of a window that is closed by then
    spark.createDataFrame([late], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/9999")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    writer = feature_stream(stream).writeStream.format("memory").queryName("features").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True)
    with rocksdb(spark):
        query = writer.start()
    query.awaitTermination()
    table = features.window_features(spark.createDataFrame(rows, EVENT))
    end = max(r[0] for r in rows) - 30_000
    want = sorted(map(tuple, table.filter(f"window_start_ms + {features.WINDOW_MS} <= {end}").collect()))
    got = spark.table("features")
    assert got.columns == table.columns and len(want) > 20
    assert sorted(map(tuple, got.collect())) == want
