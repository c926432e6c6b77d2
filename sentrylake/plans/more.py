"""Further registered queries: sources, sinks, inference, learned parsers, connections, ledgers, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import text as tx
from sentrylake.operators import accounts, connections, infer, integrity, learned, ocsf, packs
from sentrylake.sources import inbound, sinks

from .fixtures import EVENTS, READ_IP, events, spread, table
from .queries import query

_FIELDS = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "user_name")


@query("src_05_hec_events", f"SELECT event_id, concat(raw_text, ' }} {{') AS raw, device_hostname AS host FROM ({EVENTS}) WHERE event_id % 10 <> 0")
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.to_json(F.struct(F.concat("raw_text", F.lit(" } {")).alias("event"), F.col("device_hostname").alias("host")))
    bodies = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 10 == 0, F.concat(one, F.lit(' {"noevent":1}'))).otherwise(one).alias("body"))
    return inbound.hec_events(bodies).select("event_id", "raw", "host")


@query("src_06_hec_raw", f"SELECT event_id, count(*) AS lines FROM (SELECT event_id FROM ({EVENTS}) UNION ALL SELECT event_id FROM ({EVENTS})) GROUP BY 1")
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = events(spark, sf_dir).select("event_id", F.concat("raw_text", F.lit("\r\n\r\n  \n#"), "raw_text").alias("body"))
    return inbound.hec_raw(bodies).groupBy("event_id").agg(F.count("*").alias("lines"))


@query("src_07_otlp", f"SELECT event_id, device_hostname AS host, raw_text AS raw, severity, time AS time_ms FROM ({EVENTS})")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.struct(c.alias("stringValue"))
    record = F.struct((F.col("time") * 1000000).cast("string").alias("timeUnixNano"), F.col("severity").alias("severityText"), text(F.col("raw_text")).alias("body"))
    host = F.struct(F.array(F.struct(F.lit("host.name").alias("key"), text(F.col("device_hostname")).alias("value"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(host.alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs")))
    return inbound.otlp_logs(events(spark, sf_dir).select("event_id", body.alias("body"))).select("event_id", "host", "raw", "severity", "time_ms")


@query("src_08_http_stream", f"SELECT event_id, raw_text AS raw, CASE WHEN event_id % 3 = 2 THEN NULL ELSE device_hostname END AS host FROM ({EVENTS})")
def src_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.to_json(F.struct(F.col("raw_text").alias("message"), F.struct(F.col("device_hostname").alias("name")).alias("host")))
    kind = F.col("event_id") % 3
    body = F.when(kind == 0, one).when(kind == 1, F.concat(F.lit(" ["), one, F.lit("]"))).otherwise(F.col("raw_text"))
    return inbound.http_stream(events(spark, sf_dir).select("event_id", body.alias("body"))).select("event_id", "raw", "host")


@query("src_14_framing", f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'CRLF' WHEN 1 THEN 'LF' ELSE '' END AS framing, sha256(raw_text) AS body_sha256 FROM ({EVENTS})")
def src_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("event_id") % 3 == 0, "\r\n").when(F.col("event_id") % 3 == 1, "\n").otherwise("")
    f = tx.framing(F.encode(F.concat("raw_text", end), "UTF-8"))
    return events(spark, sf_dir).select("event_id", f["framing"].alias("framing"), F.sha2(f["body"], 256).alias("body_sha256"))


@query("src_15_decode", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'latin-1' ELSE 'utf-8' END AS encoding, concat('é ', raw_text) AS text FROM ({EVENTS})")
def src_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("é "), "raw_text")
    raw = F.when(F.col("event_id") % 2 == 0, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    d = tx.decode(raw)
    return events(spark, sf_dir).select("event_id", d["encoding"].alias("encoding"), d["text"].alias("text"))


@query("src_02_tcp_frames", f"SELECT event_id, raw_text AS first, concat('x ', raw_text) AS second FROM ({EVENTS})")
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.concat(F.lit("x "), "raw_text")
    frame = lambda c: F.concat(F.length(c).cast("string"), F.lit(" "), c)
    buffer = F.when(F.col("event_id") % 2 == 0, F.concat(frame(F.col("raw_text")), frame(second))).otherwise(F.concat("raw_text", F.lit("\n"), second, F.lit("\x00")))
    rows = events(spark, sf_dir).select("event_id", inbound.tcp_frames(buffer).alias("f"))
    return rows.select("event_id", F.get("f", F.lit(0)).alias("first"), F.get("f", F.lit(1)).alias("second"))


@query("src_13_named_sources", f"SELECT event_id, CASE WHEN src_ip = '10.0.0.1' THEN 'by address' WHEN device_hostname = 'fw2' THEN 'by host' END AS source_name FROM ({EVENTS})")
def src_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    static = spark.createDataFrame([("10.0.0.1", None, "by address"), (None, "FW2", "by host")], "match_ip string, match_hostname string, name string")
    rows = events(spark, sf_dir).select("event_id", F.col("src_ip").alias("peer_ip"), F.col("device_hostname").alias("hostname"))
    return inbound.named_sources(rows, static).select("event_id", "source_name")


@query("snk_05_encoders", f"SELECT event_id, concat('CEF:0|A|B|1|', class_uid, '|n\\|m|', severity_id, '|src=', src_ip, ' msg=a\\=b') AS cef, concat('LEEF:1.0|A|B|1|9|src=', src_ip, chr(9), 'user=', user_name) AS leef, concat('<134>1 ', strftime(make_timestamp(time * 1000), '%Y-%m-%dT%H:%M:%S.%g'), 'Z ', device_hostname, ' app - - - ', raw_text) AS syslog FROM ({EVENTS})")
def snk_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    cef = fm.to_cef(F.lit("A"), F.lit("B"), F.lit("1"), F.col("class_uid"), F.lit("n|m"), F.col("severity_id"), {"src": F.col("src_ip"), "msg": F.lit("a=b")})
    leef = fm.to_leef(F.lit("A"), F.lit("B"), F.lit("1"), F.lit("9"), {"src": F.col("src_ip"), "user": F.col("user_name")})
    return events(spark, sf_dir).select("event_id", cef.alias("cef"), leef.alias("leef"), fm.to_rfc5424(F.lit(134), F.col("time"), F.col("device_hostname"), F.lit("app"), F.col("raw_text")).alias("syslog"))


@query("snk_12_route", f"SELECT output, outcome, count(*) AS n FROM (SELECT 'findings' AS output, CASE WHEN class_uid = 2004 THEN 'queued' ELSE 'filtered' END AS outcome FROM ({EVENTS}) UNION ALL SELECT 'all', 'queued' FROM ({EVENTS})) GROUP BY 1, 2")
def snk_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.route(events(spark, sf_dir), {"findings": {"classes": (2004,)}, "all": {}}).groupBy("output", "outcome").agg(F.count("*").alias("n"))


@query("snk_09_export", f"SELECT event_id, sequence_num, time FROM ({EVENTS}) ORDER BY sequence_num LIMIT 1000")
def snk_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.export_oldest(events(spark, sf_dir), 1000).select("event_id", "sequence_num", "time")


def _kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"sourceAddress": "src_ip", "srcport": "src_port", "dest_ip": "dst_ip", "destPort": "dst_port", "proto": "protocol", "username": "user_name", "fw_action": "action", "nat_src_ip": "dst_ip"}
    line = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.col(c).cast("string")) for k, c in names.items()])
    return events(spark, sf_dir).select("event_id", line.alias("line"), line.alias("raw_text"), "superseded_by")


@query("prj_16_17_infer", f"""WITH e AS (SELECT * FROM ({EVENTS}))
SELECT event_id, 'src_ip' AS role, src_ip AS value FROM e WHERE {READ_IP} IS NOT NULL UNION ALL SELECT event_id, 'dst_ip', dst_ip FROM e UNION ALL SELECT event_id, 'src_port', CAST(src_port AS STRING) FROM e
UNION ALL SELECT event_id, 'dst_port', CAST(dst_port AS STRING) FROM e UNION ALL SELECT event_id, 'protocol', protocol FROM e UNION ALL SELECT event_id, 'user', user_name FROM e
UNION ALL SELECT event_id, 'action', CASE action WHEN 'allow' THEN 'allowed' ELSE 'denied' END FROM e""")
def prj_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.from_pairs(_kv_lines(spark, sf_dir).withColumn("m", fm.kv(F.col("line")))).select("event_id", "role", "value")


@query("prj_17_arrow", f"SELECT event_id, " + ", ".join(f"CASE WHEN {READ_IP} IS NOT NULL THEN {c} END AS {c}" for c in ("src_ip", "src_port", "dst_ip", "dst_port")) + f" FROM ({EVENTS})")
def prj_17_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = lambda a, b, sep: F.concat(F.lit("conn "), f"{a}_ip", F.lit(":"), F.col(f"{a}_port").cast("string"), F.lit(sep), f"{b}_ip", F.lit(":"), F.col(f"{b}_port").cast("string"))
    line = F.when(F.col("event_id") % 2 == 0, ends("src", "dst", " -> ")).otherwise(F.replace(ends("src", "dst", " to "), F.lit("conn "), F.lit("seen from ")))
    got = events(spark, sf_dir).select("event_id", infer.arrow(line).alias("a"))
    return got.select("event_id", "a.src_ip", F.col("a.src_port").cast("int").alias("src_port"), "a.dst_ip", F.col("a.dst_port").cast("int").alias("dst_port"))


@query("prj_38_39_learned", f"SELECT event_id, src_ip, dst_ip, CAST(dst_port AS STRING) AS dst_port, CASE action WHEN 'allow' THEN 'allowed' ELSE 'denied' END AS action, user_name AS user FROM ({EVENTS}) WHERE superseded_by IS NULL")
def prj_38(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _kv_lines(spark, sf_dir)
    spec = learned.learn(lines.orderBy("event_id").limit(100), "acme")
    spec.status = "approved"
    new = learned.reparse(lines, spark.createDataFrame([], "event_id long, spec string"), [spec])
    f = F.from_json("fields", "src_ip string, dst_ip string, dst_port string, action string, user string")
    return new.select("event_id", f.alias("f")).select("event_id", "f.*")


@query("joi_12_asa_pairs", f"SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN {READ_IP} END AS src, CASE WHEN event_id % 3 <> 0 THEN dst_ip END AS dst FROM ({EVENTS})")
def joi_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "src_ip", "dst_ip", F.col("device_hostname").alias("host"), (F.col("event_id") % 997).cast("string").alias("connection"))
    ends = F.concat_ws(" ", "dst_ip", "src_ip")
    built = e.select("host", "connection", (F.col("event_id") * 2).alias("pos"), F.lit("built").alias("verb"), ends.alias("ends"), F.lit("outbound").alias("direction")).filter("(pos / 2) % 3 <> 0")
    down = e.select("host", "connection", (F.col("event_id") * 2 + 1).alias("pos"), F.lit("teardown").alias("verb"), ends.alias("ends"), F.lit(None).cast("string").alias("direction"))
    got = connections.directed(built.unionByName(down)).select(((F.col("pos") - 1) / 2).cast("long").alias("event_id"), connections.sides(F.col("ends"), F.col("direction")).alias("s"))
    return got.select("event_id", F.col("s.src_ip").alias("src"), F.col("s.dst_ip").alias("dst"))


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A delivery ledger of one batch per 50 events."""
    rows = events(spark, sf_dir).select((F.floor(F.col("event_id") / 50) + 1).cast("long").alias("batch_id"), "sequence_num", F.col("event_id").cast("string").alias("event_uid"), F.lit("delivered").alias("outcome"))
    sent = rows.select("*", F.lit("siem").alias("output"), F.lit("live").alias("trigger"), (F.col("batch_id") * 10).alias("at"))
    return accounts.delivery_batches(sent), rows


@query("led_06_verify_deliveries", "SELECT CAST(b AS BIGINT) AS batch, problem FROM (VALUES (2, 'event rows changed'), (3, 'outcome edited'), (5, 'chain broken'), (4, 'rows of a missing batch'), (6, 'batch edited')) v(b, problem)")
def led_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, rows = _ledger(spark, sf_dir)
    batches = batches.filter("id <> 4").withColumn("at", F.when(F.col("id") == 6, F.lit(1)).otherwise(F.col("at")))
    edited = F.when((F.col("batch_id") == 3) & (F.col("sequence_num") == 110), "filtered").otherwise(F.col("outcome"))
    rows = rows.filter("sequence_num <> 60").withColumn("outcome", edited)
    return integrity.verify_deliveries(batches, rows)


@query("led_03_verify_checkpoints", f"SELECT source_id AS shard, CAST(floor((n - 1) / 100) AS BIGINT) AS idx, NOT (source_id = 2 AND n BETWEEN 101 AND 200) AS ok FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS n FROM ({EVENTS})) WHERE n % 100 = 1")
def led_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("event_id")
    rows = events(spark, sf_dir).select(F.col("source_id").alias("shard"), F.row_number().over(order).cast("long").alias("sequence_num"), F.sha2("raw_text", 256).alias("raw_hash"), F.col("raw_text").alias("body"))
    ledger = integrity.chain(rows)
    sealed = integrity.checkpoints(ledger, size=100)
    changed = ledger.withColumn("record_hash", F.when((F.col("shard") == 2) & (F.col("sequence_num") == 150), F.lit("0")).otherwise(F.col("record_hash")))
    return integrity.verify_checkpoints(sealed, changed, size=100).select("shard", "idx", "ok")


@query("fun_21_raw_hash", f"SELECT event_id, sha256(raw_text) AS raw_hash FROM ({EVENTS})")
def fun_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.when(F.col("event_id") % 2 == 0, "bytes")
    return events(spark, sf_dir).select("event_id", integrity.stored_raw_hash(F.col("raw_text"), F.lit("utf-8"), of).alias("raw_hash"))


@query("fun_17_ist", f"SELECT event_id, strftime(make_timestamp((time + 19800000) * 1000), '%Y-%m-%dT%H:%M:%S+05:30') AS at FROM ({EVENTS})")
def fun_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", tx.ist(F.col("time")).alias("at"))


@query("fun_16_shape", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[0-9]', '9', 'g'), '[A-Zb-z]', 'a', 'g')) AS shape FROM documents")
def fun_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.shape(F.coalesce("text", F.lit(""))), 256).alias("shape"))


@query("fun_08_template_merge")
def fun_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sentrylake.operators.registry import merge_table

    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    rows = lines.select(F.array_join(tx.mask_words(F.col("line"), 24), " ").alias("t"), "doc_id")
    few = rows.groupBy("t").agg(F.min("doc_id").alias("first")).select(F.substring(F.sha1("t"), 1, 12).alias("id"), F.lit("").alias("app"), "t", "first")
    return merge_table(few)


@query("prj_19_32_packs", f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'fortinet_fortigate' WHEN 1 THEN 'suricata_eve' WHEN 2 THEN 'sonicwall_sonicos' ELSE 'checkpoint_log_exporter' END AS pack, {READ_IP} AS src_ip, src_port, dst_ip, dst_port, protocol FROM ({EVENTS})")
def prj_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda n: F.col(n).cast("string")
    forti = F.concat(F.lit('date=2026-01-02 time=03:04:05 devname="f" logid="1" type="traffic" action="accept" srcip='), c("src_ip"), F.lit(" srcport="), c("src_port"), F.lit(" dstip="), c("dst_ip"), F.lit(" dstport="), c("dst_port"), F.lit(" proto="), F.when(F.col("protocol") == "TCP", "6").otherwise("17"))
    eve = F.to_json(F.struct(F.lit("flow").alias("event_type"), F.lit(1).alias("flow_id"), F.col("src_ip"), F.col("src_port"), F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), F.col("protocol").alias("proto")))
    sonic = F.concat(F.lit('id=firewall sn=1 m=98 msg="Connection Opened" src='), c("src_ip"), F.lit(":"), c("src_port"), F.lit(":X0 dst="), c("dst_ip"), F.lit(":"), c("dst_port"), F.lit(":X1 proto="), F.lower("protocol"), F.lit("/x"))
    check = F.concat(F.lit('[action:"Accept"; origin:"192.0.2.9"; src:"'), c("src_ip"), F.lit('"; s_port:"'), c("src_port"), F.lit('"; dst:"'), c("dst_ip"), F.lit('"; service:"'), c("dst_port"), F.lit('"; proto:"'), F.lower("protocol"), F.lit('"]'))
    kind = F.col("event_id") % 4
    line = F.when(kind == 0, forti).when(kind == 1, eve).when(kind == 2, sonic).otherwise(check)
    got = spread(events(spark, sf_dir)).select("event_id", line.alias("line")).select("event_id", packs.parse_column("line").alias("p"))
    return got.select("event_id", "p.pack", "p.src_ip", "p.src_port", "p.dst_ip", "p.dst_port", "p.protocol")


@query("prj_35_export", f"SELECT event_id, CAST(class_uid * 100 + CASE class_uid WHEN 4001 THEN 6 ELSE 1 END AS INT) AS type_uid, CAST(3 AS INT) AS observables, user_name AS user FROM ({EVENTS})")
def prj_35(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ocsf.export(events(spark, sf_dir).withColumn("bytes_in", F.lit(None).cast("long")))
    return rows.select("event_id", "type_uid", F.size("observables").alias("observables"), "user")


@query("str_04_windows", """WITH e AS (SELECT epoch_ms(ts) AS ms, '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS src_ip, event_id FROM events)
SELECT src_ip, CAST(floor(ms / 300000) AS BIGINT) * 300000 AS window_start_ms, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS bytes_out, CAST(1 AS INT) AS dst_ips FROM e
WHERE (floor(ms / 300000) + 1) * 300000 <= (SELECT max(ms) FROM e) - 30000 GROUP BY 1, 2""")
def str_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream of the events through watermarked windows, run to its end; rows, state and offsets are in the shared folder."""
    from sentrylake.streaming import pipeline

    raw = table(spark, sf_dir, "events")
    lines = spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/events.parquet*")
    zoneless = dict(raw.dtypes)["ts"] == "timestamp_ntz"  # UTC, as its SQL has it, whatever the zone of the session
    ts = F.concat(F.col("ts").cast("string"), F.lit("Z")) if zoneless else F.col("ts")
    rows = lines.select(ts.cast("timestamp").alias("ts"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")).alias("src_ip"), F.lit("198.51.100.1").alias("dst_ip"), F.col("event_id").alias("bytes_out"))
    return pipeline.drain(pipeline.windows(rows), "windows")


@query("win_05_newest", f"SELECT event_id, sequence_num FROM (SELECT * FROM ({EVENTS}) ORDER BY time DESC, sequence_num DESC LIMIT 200)")
def win_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = events(spark, sf_dir).orderBy(F.col("time").desc(), F.col("sequence_num").desc()).limit(200)
    return top.select("event_id", "sequence_num")


@query("flt_09_membership", f"SELECT event_id, coalesce(disposition IN ('denied', 'dropped'), false) AS hit FROM ({EVENTS})")
def flt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.coalesce(F.col("disposition").isin("denied", "dropped"), F.lit(False)).alias("hit"))


@query("joi_03_event_ledger", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 10 END AS ledger_seq FROM ({EVENTS})")
def joi_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id")
    ledger = e.filter("event_id % 2 = 0").select("event_id", (F.col("event_id") * 10).alias("ledger_seq"))
    return e.join(ledger, "event_id", "left")


@query("agg_07_distinct", f"SELECT source_id, count(DISTINCT src_ip) AS addresses, count(DISTINCT user_name) AS users FROM ({EVENTS}) GROUP BY 1")
def agg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("source_id").agg(F.count_distinct("src_ip").alias("addresses"), F.count_distinct("user_name").alias("users"))


@query("det_06_unwritten", f"SELECT DISTINCT user_name AS finding_uid FROM ({EVENTS}) WHERE CAST(substr(user_name, 5) AS BIGINT) % 3 <> 0")
def det_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a flag of its user, found again and again; those of every third user are stored."""
    from sentrylake.operators.baseline import unwritten

    found = events(spark, sf_dir).select(F.col("user_name").alias("finding_uid"))
    return unwritten(found, found.filter(F.substring("finding_uid", 5, 20).cast("long") % 3 == 0).distinct())
