import datetime as dt

from pyspark.sql import functions as F

from sentrylake.operators import connections, packs
from sentrylake.streaming import connections as streamed

HEAD = "<166>Oct 10 2018 12:34:56 {host} : %ASA-6-"
DNS = ("302015: Built outbound UDP connection 11758 for outside:192.0.2.32/53 (192.0.2.32/53) to inside:10.31.98.44/56132 (10.31.98.44/56132)", "302016: Teardown UDP connection 11758 for outside:192.0.2.32/53 to inside:10.31.98.44/56132 duration 0:00:00 bytes 148")
WEB = ("302013: Built inbound TCP connection 900 for outside:198.51.100.22/51200 (198.51.100.22/51200) to dmz:10.0.1.15/443 (203.0.113.15/443)", "302014: Teardown TCP connection 900 for outside:198.51.100.22/51200 to dmz:10.0.1.15/443 duration 0:00:05 bytes 5120 TCP FINs")
PING = ("302020: Built outbound ICMP connection for faddr 198.51.100.8/0 gaddr 203.0.113.4/7 laddr 10.0.0.4/7", "302021: Teardown ICMP connection for faddr 198.51.100.8/0 gaddr 203.0.113.4/7 laddr 10.0.0.4/7")
NAMED = ("302013: Built outbound TCP connection 447236 for outside:192.0.2.222/1234 (192.0.2.222/1234) to dmz:OCSP_Server/5678 (OCSP_Server/5678)", "302014: Teardown TCP connection 447236 for outside:192.0.2.222/1234 to dmz:OCSP_Server/5678 duration 0:00:01 bytes 1")
#: (lines of a host each, source and destination of every teardown)
STORIES = [
    ([("a", DNS[0]), ("a", DNS[1])], [("10.31.98.44", 56132, "192.0.2.32", 53)]),
    ([("a", WEB[0]), ("a", WEB[1])], [("198.51.100.22", 51200, "10.0.1.15", 443)]),
    ([("a", DNS[1])], [(None,) * 4]),
    ([("a", DNS[0]), ("b", DNS[1])], [(None,) * 4]),
    ([("a", DNS[0]), ("a", DNS[1]), ("a", DNS[1])], [("10.31.98.44", 56132, "192.0.2.32", 53), (None,) * 4]),
    ([("a", PING[0]), ("a", PING[1])], [("10.0.0.4", 7, "198.51.100.8", 0)]),
    ([("a", PING[1])], [(None,) * 4]),
    # a number used again with other ends lends nothing, and the one that is open stays open
    ([("a", DNS[0]), ("a", WEB[1].replace("connection 900", "connection 11758")), ("a", DNS[1])], [(None,) * 4, ("10.31.98.44", 56132, "192.0.2.32", 53)]),
    ([("a", NAMED[0]), ("a", NAMED[1])], [(None, 5678, "192.0.2.222", 1234)]),
]


def _lines():
    at = 0
    for story, (lines, _) in enumerate(STORIES):
        for host, text in lines:
            yield story, at, HEAD.format(host=f"{host}{story}") + text
            at += 1


def _records(lines):
    parsed = lines.select("story", "pos", F.timestamp_seconds(F.col("pos") + 1_000_000).alias("time"), packs.parse_column("line").alias("p")).select("story", "pos", "time", "p.*")
    return connections.records(parsed, "pos", "story", "time")


def _told(rows):
    got = rows.select("story", "pos", connections.sides(F.col("ends"), F.col("direction")).alias("s")).orderBy("pos").collect()
    return [(r.story, (r.s.src_ip, r.s.src_port, r.s.dst_ip, r.s.dst_port)) for r in got]


WANT = [(story, ends) for story, (_, wanted) in enumerate(STORIES) for ends in wanted]


def test_teardowns_take_the_direction_of_their_built_line(spark):
    lines = spark.createDataFrame(list(_lines()), "story int, pos long, line string")
    assert _told(connections.directed(_records(lines))) == WANT
    named = _records(lines).filter("verb = 'built' AND ends LIKE '%OCSP%'").select(connections.sides(F.col("ends"), F.col("direction")).alias("s")).first().s
    assert (named.src_hostname, named.src_ip, named.dst_hostname) == ("OCSP_Server", None, None)


def _run(stream, name, at):
    return stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", at).trigger(availableNow=True).start()


def test_the_stream_says_what_the_table_says_across_batches(spark, tmp_path):
    for i, row in enumerate(_lines()):  # a file, and so a batch, for each line
        spark.createDataFrame([row], "story int, pos long, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    stream = spark.readStream.schema("story int, pos long, line string").option("maxFilesPerTrigger", 5).parquet(f"{tmp_path}/in/*")
    with streamed.rocksdb(spark):
        query = _run(streamed.directed_stream(_records(stream)), "stories", f"{tmp_path}/at")
    query.awaitTermination()
    assert len(query.recentProgress) > 3
    assert _told(spark.table("stories")) == WANT


def test_open_connections_are_forgotten_and_survive_a_restart(spark, tmp_path):
    schema = "host string, connection string, pos long, verb string, ends string, direction string, time timestamp"
    start = dt.datetime(2026, 1, 1)

    def batch(i, *rows):
        made = [(h, c, p, v, "o/1 i/2", d, start + dt.timedelta(seconds=p)) for h, c, p, v, d in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        writer = streamed.directed_stream(stream, late="0 seconds", ttl_ms=60_000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at")
        with streamed.rocksdb(spark):
            query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r.connection, r.direction) for r in spark.read.parquet(f"{tmp_path}/out").filter(F.col("pos").isin([x[2] for x in rows])).collect())

    batch(0, ("h", "#1", 0, "built", "inbound"), ("h", "#2", 0, "built", "outbound"), ("h", "#3", 30, "built", "inbound"))
    got = batch(1, ("h", "#1", 50, "teardown", None), ("h", "x", 70, "built", "inbound"))  # #2 is 70 seconds old by now
    assert got == [("#1", "inbound")]
    got = batch(2, ("h", "#2", 80, "teardown", None), ("h", "#3", 85, "teardown", None), ("h", "#1", 86, "teardown", None))
    assert got == [("#1", None), ("#2", None), ("#3", "inbound")]


SNORT = [
    (
        '09/04-21:45:37.536335 ,1,1000006,0,"TCP connection",TCP,10.100.20.59,57263,10.100.10.190,22,00:25:90:3A:05:13,00:50:56:9D:A5:BE,0x72,***AP***,0x688F0DFC,0xBC763516,,0x80C,127,0,55665,100,102400,,,,',
        ("1:1000006:0", "TCP connection", "10.100.20.59", 57263, "10.100.10.190", 22, "TCP", "medium"),
    ),
    (
        '09/04-21:49:55.900215 ,1,1000004,0,"Pinging...",ICMP,10.100.10.190,,175.16.199.1,,00:50:56:9D:A5:BE,00:25:90:3A:05:13,0x62,,,,,,64,0,37607,84,86016,8,0,83,1',
        ("1:1000004:0", "Pinging...", "10.100.10.190", None, "175.16.199.1", None, "ICMP", "medium"),
    ),
    (
        '09/03/21-12:37:16.428952 ,1,2403488,68499,"Poor Reputation, group 95",TCP,203.0.113.7,36847,198.51.100.22,91,54321,Misc Attack,2,alert,Allow',
        ("1:2403488:68499", "Poor Reputation, group 95", "203.0.113.7", 36847, "198.51.100.22", 91, "TCP", "medium"),
    ),
    (
        '{"seconds":1608147213,"action":"allow","b64_data":"AAAA","dst_addr":"10.11.21.11","dst_port":445,"gid":1,"msg":"raw WriteAndX -> attempt","pkt_num":61571,"priority":1,"proto":"TCP","rev":1,"rule":"1:50626:1","sid":50626,"src_addr":"10.11.21.101","src_port":50084}',
        ("1:50626:1", "raw WriteAndX -> attempt", "10.11.21.101", 50084, "10.11.21.11", 445, "TCP", "high"),
    ),
    ("[**] [1:1000006:0] TCP connection [**]", ("1:1000006:0", "TCP connection", None, None, None, None, None, None)),
    (
        "05/30-19:09:28.472094  [**] [1:2012811:2] ET DNS Query - Likely Hostile [**] [Classification: Potentially Bad Traffic] [Priority: 2] {UDP} 192.168.88.10:1029 -> 203.0.113.53:53",
        ("1:2012811:2", "ET DNS Query - Likely Hostile", "192.168.88.10", 1029, "203.0.113.53", 53, "UDP", "medium"),
    ),
    ("<33>Sep  5 16:05:26 dev snort: [1:1000017:0] UDP Connection [Classification: Misc activity] [Priority: 3] {UDP} 10.150.10.44:55776 -> 10.25.10.22:32414", ("1:1000017:0", "UDP Connection", "10.150.10.44", 55776, "10.25.10.22", 32414, "UDP", "low")),
]


def test_alerts_in_every_shape(spark):
    lines = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(SNORT)], "i int, line string")
    got = {r.i: r.p for r in lines.select("i", packs.parse_column("line").alias("p")).collect()}
    for i, (_, want) in enumerate(SNORT):
        p = got[i]
        assert p.pack == "snort_alert" and p.class_uid == 2004
        assert (p.rule, p.signature, p.src_ip, p.src_port, p.dst_ip, p.dst_port, p.protocol, p.severity) == want


def test_no_line_is_late_whatever_the_order_of_the_files_and_rows_stay_out_of_the_driver(spark, tmp_path):
    import os

    from sentrylake.plans import connected

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter("event_id < 60")
    for i, part in enumerate(("event_id >= 30", "event_id < 30")):  # the later events first; only the second batch would be late
        at = f"{tmp_path}/made{i}"
        events.filter(part).withColumn("event_id", F.col("event_id") * 100).coalesce(1).write.parquet(at)
        [made] = [f for f in os.listdir(at) if f.endswith(".parquet")]
        os.makedirs(f"{tmp_path}/events.parquet", exist_ok=True)
        os.link(f"{at}/{made}", f"{tmp_path}/events.parquet/part-{i}.parquet")
        os.utime(f"{tmp_path}/events.parquet/part-{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got = connected.str_06(spark, str(tmp_path))
    want = connected.joi_12_lines(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)
    assert got.count() == 60 + 6 and got.inputFiles()


def test_lines_of_connections_are_parsed_in_one_place_of_the_plan(spark):
    from sentrylake.plans import connected
    from sentrylake.plans.fixtures import events, spread

    rows = connected._records(connected.connection_lines(spread(events(spark, "/root/testdata/sf0.001"))))
    assert "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()
