import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.sources import inbound
from sentrylake.sources.frames import Frames
from sentrylake.streaming import frames as streamed
from sentrylake.streaming.connections import rocksdb

PARTS = st.lists(st.sampled_from([b"5 hello", b"3 a\nb", b"<1>one\n", b"two\r\n", b"three\x00", b"\r\n", b"\x00", b"12", b" ", b"40 ", b"99999 x", b"0 ", b"long" * 9, b"7", b"\n", "2 é".encode(), b"   \n"]), max_size=25)


@settings(max_examples=500, deadline=None)
@given(parts=PARTS, cuts=st.lists(st.integers(0, 400), max_size=8))
def test_any_cut_gives_the_same_frames(parts, cuts):
    data = b"".join(parts)
    once, pieces = Frames(limit=30), Frames(limit=30)
    want = once.feed(data) + once.flush()
    at = [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    got = [f for a, b in zip(at, at[1:], strict=False) for f in pieces.feed(data[a:b])] + pieces.flush()
    assert got == want


def test_kinds_of_frames():
    f = Frames(limit=20)
    assert f.feed(b"5 a b c3 xyz<1>x\r\n\r\n\x00last\x00tail") == [b"a b c", b"xyz", b"<1>x\r\n", b"last"]
    assert f.rest == b"tail" and f.flush() == [b"tail"] and f.rest == b""
    assert Frames(limit=20).feed(b"1234 not a count\n") == [b"not a count\n"]
    assert Frames(limit=4).feed(b"abcdefghij") == [b"abcd", b"efgh"]


def test_a_buffer_of_many_frames_is_read_in_one_pass():
    data = b"".join(b"%d %s" % (len(x), x) for x in (b"line %d" % i for i in range(120_000)))
    began = time.process_time()
    assert len(Frames().feed(data)) == 120_000
    assert time.process_time() - began < 3


def test_columns_count_bytes(spark):
    df = spark.createDataFrame([("3 éa3 xyz",), ("one\ntwo\r\n",), (None,)], "p string")
    assert [r[0] for r in df.select(inbound.tcp_frames(F.col("p"))).collect()] == [["éa", "xyz"], ["one", "two"], None]


def test_pieces_of_connections_across_batches(spark, tmp_path):
    pieces = [("a", 0, b"5 he", False), ("b", 1, b"one\ntw", False), ("a", 2, b"llo1", False), ("a", 3, b"0 0123456789", False), ("b", 4, b"o\nthree", True), ("a", 5, None, True)]
    for i, row in enumerate(pieces):
        spark.createDataFrame([row], "connection string, pos long, payload binary, closed boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("connection string, pos long, payload binary, closed boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    writer = streamed.frame_stream(stream).writeStream.format("memory").queryName("frames").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True)
    with rocksdb(spark):
        query = writer.start()
    query.awaitTermination()
    got = sorted((r.connection, r.pos, r.n, bytes(r.frame)) for r in spark.table("frames").collect())
    assert got == [("a", 2, 0, b"hello"), ("a", 3, 0, b"0123456789"), ("b", 1, 0, b"one\n"), ("b", 4, 0, b"two\n"), ("b", 4, 1, b"three")]


def test_frames_of_the_query_are_files_and_no_rows_of_the_driver(spark):
    import __spark_entry__ as e

    got = e.queries()["src_02_pieces"](spark, "/root/testdata/sf0.001")
    assert got.inputFiles() and got.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_many_pieces_are_sorted_on_disk_and_frames_given_out_in_parts():
    import random
    import tracemalloc

    import pandas as pd
    import pyarrow as pa

    places = list(range(60_000))
    random.Random(2).shuffle(places)
    parts = [places[i : i + 500] for i in range(0, len(places), 500)]
    batches = lambda: (pa.RecordBatch.from_pydict({"pos": [p // 2 for p in x], "payload": [b"%05d" % p for p in x]}) for x in parts)
    got = list(streamed.ordered(batches(), "pos", most=50_000))
    assert got == list(streamed.ordered(batches(), "pos")) and [p for p, _ in got] == [i // 2 for i in range(60_000)] and len({x for _, x in got}) == 60_000
    assert list(streamed.ordered(iter(()), "pos")) == []

    class Waiting:
        def exists(self):
            return False

    reader = streamed.OpenFrames(100)
    reader.waiting = Waiting()
    pieces = (pd.DataFrame({"pos": range(i, i + 5000), "payload": [b"x" * 20 + b"\n"] * 5000, "closed": False}) for i in range(0, 400_000, 5000))
    tracemalloc.start()
    sizes = [len(x) for x in reader.handleInputRows(("a",), pieces, None)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 400_000 and max(sizes) <= 10_000 and most < 40_000_000
