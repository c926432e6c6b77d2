import os
import random

import pytest
from pyspark.sql import functions as F

from sentrylake.sources import inbound, tail


def drain(spark, pattern, place, **options):
    """One run of the stream until it has read what there is; the rows of all runs so far."""
    tail.register(spark)
    reader = spark.readStream.format("tail").option("path", pattern)
    for k, v in options.items():
        reader = reader.option(k, v)
    running = reader.load().writeStream.format("parquet").option("checkpointLocation", f"{place}/at").trigger(availableNow=True).start(f"{place}/out")
    running.awaitTermination()
    return sorted(bytes(r.raw) for r in spark.read.schema(tail.SCHEMA).parquet(f"{place}/out").collect())


def test_a_stream_resumes_at_its_offsets(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\r\n\n  \ntwo\nthr")
    pattern, place = f"{tmp_path}/*.log", tmp_path / "s"
    assert drain(spark, pattern, place) == [b"one\r\n", b"two\n"]
    with log.open("ab") as f:
        f.write(b"ee\nfour\nopen")
    (tmp_path / "b.log").write_bytes(b"other\n")
    assert drain(spark, pattern, place) == sorted([b"one\r\n", b"two\n", b"three\n", b"four\n", b"other\n"])
    os.rename(log, tmp_path / "a.log.1")
    log.write_bytes(b"new file, longer than the one that was there before it\n")
    (tmp_path / "b.log").write_bytes(b"cut\n")
    got = drain(spark, pattern, place)
    assert got == sorted([b"one\r\n", b"two\n", b"three\n", b"four\n", b"other\n", b"cut\n", log.read_bytes()])
    assert drain(spark, pattern, place) == got


def test_a_stream_that_begins_at_the_end(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"old\nhal")
    place = tmp_path / "s"
    assert drain(spark, str(log), place, startAt="end") == []
    with log.open("ab") as f:
        f.write(b"f\nnew\n")
    assert drain(spark, str(log), place, startAt="end") == [b"half\n", b"new\n"]
    os.remove(log)
    log.write_bytes(b"again\n")
    assert drain(spark, str(log), place, startAt="end") == sorted([b"half\n", b"new\n", b"again\n"])


def test_pieces_of_any_size_give_the_lines_of_the_whole(tmp_path):
    rng = random.Random(5)
    for case in range(60):
        data = b"".join(rng.choice([b"", b"a", b"xy" * rng.randint(0, 40), b" ", b"q\r"]) + rng.choice([b"\n", b"\n\n", b""]) for _ in range(rng.randint(0, 40)))
        path = tmp_path / f"{case}.log"
        path.write_bytes(data)
        whole = data[: data.rfind(b"\n") + 1]
        want, at = [], 0
        for line in whole.split(b"\n")[:-1]:
            if line.strip():
                want.append((at, line + b"\n", len(line) + 1))
            at += len(line) + 1
        for chunk in (1, 2, 3, 7, 1000):
            reader = tail._Tail({"path": str(path), "chunkbytes": str(chunk)})
            ((_, (inode, end)),) = reader.ends({}).items()
            assert end == len(whole)
            assert [x for p in tail.pieces(str(path), inode, 0, end, chunk) for x in reader.lines(p)] == want
            cut = tail._Tail({"path": str(path), "chunkbytes": str(chunk), "maxlinebytes": "5"})
            assert [x for p in tail.pieces(str(path), inode, 0, end, chunk) for x in cut.lines(p)] == [(a, r[:5], n) for a, r, n in want if r[:5].strip()]


def test_a_batch_of_a_rotated_file_is_read_by_its_inode_or_refused(tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\n")
    reader = tail.TailStreamReader({"path": str(log)})
    (piece,) = reader.partitions(reader.initialOffset(), reader.latestOffset())
    os.rename(log, tmp_path / "kept")
    log.write_bytes(b"later\n")
    assert [r for _, r, _ in reader.tail.lines(piece)] == [b"one\n", b"two\n"]
    (tmp_path / "kept").write_bytes(b"one\n")
    with pytest.raises(EOFError):
        list(reader.tail.lines(piece))
    os.rename(tmp_path / "kept", tmp_path / "away")
    os.rename(tmp_path / "away", tmp_path.parent / f"{tmp_path.name}-away")
    with pytest.raises(FileNotFoundError):
        list(reader.tail.lines(piece))
    lossy = tail._Tail({"path": str(log), "failondataloss": "false"})
    assert list(lossy.lines(piece)) == []


def test_options_and_empty_folders(spark, tmp_path):
    tail.register(spark)
    assert spark.read.format("tail").option("path", f"{tmp_path}/none*").load().count() == 0
    for bad in ({}, {"path": "s3://bucket/x"}, {"path": "x", "startat": "middle"}, {"path": "x", "chunkbytes": "0"}):
        with pytest.raises(ValueError):
            tail._Tail(bad)


def test_datagrams(spark):
    cases = [(b"<1>a\n<2>b\n", ["<1>a", "<2>b"]), (b"<1>a\nb\n", ["<1>a\nb\n"]), (b"<1>only\n", ["<1>only\n"]), (b"<1>a\r\n\n<2>b", ["<1>a", "<2>b"]), (b"<1>" + b"x" * 90 + b"\n<2>b", ["<1>" + "x" * 37])]
    df = spark.createDataFrame([(i, bytearray(p)) for i, (p, _) in enumerate(cases)], "i int, payload binary")
    got = {r.i: [bytes(x).decode() for x in r.p] for r in df.select("i", inbound.datagrams(F.col("payload"), 40).alias("p")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    assert [bytes(x) for x in df.limit(1).select(inbound.datagrams(F.lit(b"\xff\n\xfe").cast("binary")).alias("p")).first().p] == [b"\xff\n\xfe"]
