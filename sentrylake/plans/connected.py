"""Registered queries over lines of devices: connections whose teardown takes the direction of the line that built them, and alerts in every
shape that a sensor writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.operators import connections, packs
from sentrylake.streaming import connections as streamed
from sentrylake.streaming.pipeline import drain

from .fixtures import EVENTS, READ_IP, events, spread
from .queries import query

#: Of every event a line that builds a connection, unless its number divides by 5, and one that ends it: with other ends where it divides by
#: 7, twice where by 11. Numbers come again on a host after 997 events; even ones are outbound, every third is ICMP without a number.
_SQL = f"""
WITH e AS (SELECT * FROM ({EVENTS})), d AS (
  SELECT event_id, 0 AS copy, * EXCLUDE (event_id) FROM e UNION ALL SELECT event_id, 1, * EXCLUDE (event_id) FROM e WHERE event_id % 11 = 0
), k AS (
  SELECT event_id, copy, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND copy = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'outbound' ELSE 'inbound' END END AS direction, src_ip, src_port, dst_ip, dst_port, event_id % 3 = 0 AS icmp FROM d
)
SELECT event_id, CAST(copy AS INT) AS copy, direction, CASE direction WHEN 'outbound' THEN src_ip WHEN 'inbound' THEN dst_ip END AS src_ip,
  CAST(CASE direction WHEN 'outbound' THEN src_port WHEN 'inbound' THEN dst_port END AS INT) AS src_port,
  CASE direction WHEN 'outbound' THEN dst_ip WHEN 'inbound' THEN src_ip END AS dst_ip, CAST(CASE direction WHEN 'outbound' THEN dst_port WHEN 'inbound' THEN src_port END AS INT) AS dst_port
FROM k
"""


def connection_lines(e: DataFrame) -> DataFrame:
    """(event_id, pos, time, copy, line) of the lines above; ``dst`` is the outer end."""
    ident, icmp = F.col("event_id"), F.col("event_id") % 3 == 0
    head = F.concat(F.lit("<166>Oct 10 2018 12:34:56 "), F.col("device_hostname"), F.lit(" : %ASA-6-"))
    way = F.when(ident % 2 == 0, "outbound").otherwise("inbound")
    number = F.concat(F.lit(" connection "), (ident % 997).cast("string"), F.lit(" for "))
    port = lambda c: F.concat(F.lit("/"), c.cast("string"))
    inner = lambda other: F.when(F.lit(other) & (ident % 7 == 0), F.lit("192.0.2.250")).otherwise(F.col("src_ip"))

    def line(verb: str, tcp: str, ping: str, other: bool, tail: str):
        word = F.concat(F.lit("Built "), way, F.lit(" ")) if verb == "Built" else F.lit("Teardown ")
        plain = F.concat(head, F.lit(f"{tcp}: "), word, F.lit("TCP"), number, F.lit("outside:"), "dst_ip", port(F.col("dst_port")), F.lit(" to inside:"), inner(other), port(F.col("src_port")), F.lit(tail))
        echo = F.concat(head, F.lit(f"{ping}: "), word, F.lit("ICMP connection for faddr "), "dst_ip", port(F.col("dst_port")), F.lit(" gaddr 203.0.113.4/7 laddr "), inner(other), port(F.col("src_port")))
        return F.when(icmp, echo).otherwise(plain)

    one = lambda copy, text: F.struct((ident * 10 + copy + 1).alias("pos"), F.lit(copy).alias("copy"), text.alias("line"))
    built, down = line("Built", "302013", "302020", False, ""), line("Teardown", "302014", "302021", True, " duration 0:00:05 bytes 5120 TCP FINs")
    made = F.array(F.when(ident % 5 != 0, one(-1, built)), one(0, down), F.when(ident % 11 == 0, one(1, down)))
    return e.select("event_id", "time", F.inline(F.array_compact(made)))  # no union: a parser above it would be planned once for each side


def _records(lines: DataFrame) -> DataFrame:
    found = F.filter(F.array(packs.parse_column("line")), connections.told)  # within the expression, since a filter above it would parse again
    parsed = lines.select("event_id", "pos", "copy", F.timestamp_millis("time").alias("time"), F.inline(found))
    return connections.records(parsed, "pos", "event_id", "copy", "time")


def _sided(rows: DataFrame) -> DataFrame:
    out = rows.select("event_id", "copy", "direction", connections.sides(F.col("ends"), F.col("direction")).alias("s"))
    return out.select("event_id", "copy", "direction", "s.src_ip", "s.src_port", "s.dst_ip", "s.dst_port")


@query("joi_12_asa_lines", _SQL.replace("THEN src_ip ", f"THEN {READ_IP} "))
def joi_12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sided(connections.directed(_records(connection_lines(spread(events(spark, sf_dir))))))


@query("str_06_connections", _SQL)
def str_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as a file stream through the stateful map, run to its end. All files that are there are one micro-batch, so none of
    their lines is late whatever the order of the files."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/events.parquet*").repartition(spark.sparkContext.defaultParallelism)
    head, tail = EVENTS.rsplit("FROM events", 1)
    rows = _records(connection_lines(spark.sql(f"{head} FROM {{stream}} {tail}", stream=stream)))
    with streamed.rocksdb(spark):
        return _sided(drain(streamed.directed_stream(rows), "connections"))


@query("prj_29_snort", f"""SELECT event_id, {READ_IP} AS src_ip, CASE WHEN event_id % 5 < 4 THEN src_port END AS src_port, dst_ip, CASE WHEN event_id % 5 < 4 THEN dst_port END AS dst_port, CASE WHEN event_id % 5 < 4 THEN protocol ELSE 'ICMP' END AS protocol,
  concat('1:', event_id, ':2') AS rule, concat('say "', user_name, '", twice') AS signature, CASE event_id % 5 WHEN 4 THEN 'medium' WHEN 3 THEN 'medium' ELSE CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END END AS severity
FROM ({EVENTS})""")
def prj_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda n: F.col(n).cast("string")
    kind, level = F.col("event_id") % 5, (F.col("event_id") % 3 + 1).cast("string")
    said = F.concat(F.lit('say "'), "user_name", F.lit('", twice'))
    quoted = F.concat(F.lit('"'), F.replace(said, F.lit('"'), F.lit('\\"')), F.lit('"'))
    ends = lambda proto, sp, dp: F.concat_ws(",", proto, "src_ip", sp, "dst_ip", dp)
    head = F.concat_ws(",", F.lit("09/04/26-21:45:37.536335 "), F.lit("1"), c("event_id"), F.lit("2"), quoted)
    fast = F.concat(F.lit("05/30-19:09:28.472094  [**] [1:"), c("event_id"), F.lit(":2] "), said, F.lit(" [**] [Classification: Misc] [Priority: "), level, F.lit("] {"), "protocol", F.lit("} "), "src_ip", F.lit(":"), c("src_port"), F.lit(" -> "), "dst_ip", F.lit(":"), c("dst_port"))
    told = F.to_json(F.struct(F.col("event_id").alias("sid"), F.lit(1).alias("gid"), F.lit(2).alias("rev"), said.alias("msg"), F.lit(5).alias("pkt_num"), (F.col("event_id") % 3 + 1).alias("priority"), F.col("protocol").alias("proto"), F.col("src_ip").alias("src_addr"), "src_port", F.col("dst_ip").alias("dst_addr"), "dst_port", F.lit("AA").alias("b64_data")))
    other = F.concat_ws(",", head, ends(F.col("protocol"), c("src_port"), c("dst_port")), F.lit("54321"), F.lit("Misc Attack"), level, F.lit("alert"), F.lit("Allow"))
    mac = F.lit("00:25:90:3A:05:13")
    own = F.concat_ws(",", head, ends(F.col("protocol"), c("src_port"), c("dst_port")), mac, mac, F.lit("0x72,***AP***,0x688F0DFC,0xBC763516,,0x80C,127,0,55665,100,102400,,,,"))
    ping = F.concat_ws(",", head, ends(F.lit("ICMP"), F.lit(""), F.lit("")), mac, mac, F.lit("0x62,,,,,,64,0,37607,84,86016,8,0,83,1"))
    line = F.when(kind == 0, fast).when(kind == 1, told).when(kind == 2, other).when(kind == 3, own).otherwise(ping)
    got = spread(events(spark, sf_dir)).select("event_id", line.alias("line")).select("event_id", packs.parse_column("line").alias("p"))
    return got.select("event_id", *[f"p.{n}" for n in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "rule", "signature", "severity")])
