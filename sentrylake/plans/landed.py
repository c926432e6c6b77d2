"""Registered queries over landed files and datagrams, the catalogue of sources, the archive, candidate parsers and advice on incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import text as tx
from sentrylake.operators import archive, candidates, correlate, features
from sentrylake.session import scratch_dir
from sentrylake.sources import catalogue, inbound, tail

from .fixtures import EVENTS, FLOWS, events, flows
from .queries import _CONTRACT, _as_cef, _exported, query


@query("src_03_tail", f"SELECT device_hostname AS device, raw_text AS line, CAST(length(raw_text) + 1 AS BIGINT) AS n_bytes, 'LF' AS framing FROM ({EVENTS})")
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each device's lines in files of its own, followed as a stream that keeps its offsets, in pieces of 64 KiB."""
    place, out = scratch_dir(spark, "landed"), scratch_dir(spark, "tailed")
    events(spark, sf_dir).select("raw_text", "device_hostname").write.partitionBy("device_hostname").text(place)
    tail.register(spark)
    stream = spark.readStream.format("tail").option("path", f"{place}/*/*.txt").option("chunkBytes", 65_536).load()
    stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/at").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    rows = spark.read.schema(tail.SCHEMA).parquet(f"{out}/rows").withColumn("f", tx.framing(F.col("raw")))
    return rows.select(F.regexp_extract("path", "device_hostname=([^/]+)/", 1).alias("device"), F.decode("f.body", "UTF-8").alias("line"), "n_bytes", F.col("f.framing").alias("framing"))


@query("src_01_datagrams", f"""WITH e AS (SELECT * FROM ({EVENTS})) SELECT event_id, CAST(0 AS INT) AS pos, concat('<13>', device_hostname) AS message FROM e WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 1, concat('<14>', user_name) FROM e WHERE event_id % 2 = 0
UNION ALL SELECT event_id, 0, substr(concat('<13>', raw_text, chr(10), 'and more'), 1, 40) FROM e WHERE event_id % 2 = 1""")
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two messages in a datagram, or one of two lines that is cut at its limit."""
    two = F.concat(F.lit("<13>"), "device_hostname", F.lit("\r\n\n<14>"), "user_name", F.lit("\n"))
    payload = F.when(F.col("event_id") % 2 == 0, two).otherwise(F.concat(F.lit("<13>"), "raw_text", F.lit("\nand more")))
    parts = events(spark, sf_dir).select("event_id", F.posexplode(inbound.datagrams(payload.cast("binary"), 40)))
    return parts.select("event_id", "pos", F.decode("col", "UTF-8").alias("message"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendor = F.when(F.col("event_id") % 3 == 0, "Cisco").when(F.col("event_id") % 3 == 1, "Juniper")
    product = F.when(F.col("event_id") % 3 == 0, "Cisco ASA").when(F.col("event_id") % 3 == 1, "SRX")
    rows = events(spark, sf_dir).select(
        "event_id", "time", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 13 == 0, "office").alias("static_name"), F.lit(None).cast("string").alias("hint_name"), vendor.alias("vendor"), product.alias("product"),
        F.when(F.col("event_id") % 4 != 0, F.col("device_hostname")).alias("device"), F.concat(F.lit("192.0.2."), (F.col("event_id") % 2).cast("string")).alias("peer_ip"), F.lit("udp").alias("input_name"),
        F.lit("syslog").alias("transport"), F.when(F.col("event_id") % 3 == 0, "cisco_asa").alias("format_type"), F.lit(None).cast("string").alias("category"),
    )
    return catalogue.named(rows)


_NAMED = f"""SELECT event_id, time, CASE event_id % 3 WHEN 0 THEN 'Cisco' WHEN 1 THEN 'Juniper' ELSE 'Unknown' END AS vendor, CASE event_id % 3 WHEN 0 THEN 'Cisco ASA' WHEN 1 THEN 'SRX' ELSE 'Syslog device' END AS product,
CASE WHEN event_id % 13 = 0 THEN 'office' ELSE concat(CASE event_id % 3 WHEN 0 THEN 'Cisco ASA' WHEN 1 THEN 'Juniper SRX' ELSE 'Unknown Syslog device' END, ' (', CASE WHEN event_id % 4 <> 0 THEN device_hostname ELSE concat('192.0.2.', event_id % 2) END, ')') END AS name,
CASE event_id % 3 WHEN 0 THEN 'cisco_asa' ELSE 'unknown' END AS fmt, concat('Auto-registered from syslog input ''udp'' sender 192.0.2.', event_id % 2) AS about FROM ({EVENTS})"""


def _filled(spark: SparkSession, sf_dir: str) -> tuple[catalogue.Catalogue, DataFrame]:
    """A catalogue that two batches of lines have filled, and all of the lines."""
    made, records = catalogue.Catalogue(spark, scratch_dir(spark, "sources")), _records(spark, sf_dir)
    for part in (0, 1):
        made.register(records.filter(F.col("event_id") % 5 % 2 == part), part)
    return made, records


@query("joi_14_register", f"SELECT event_id, name AS source_name, substr(sha256(name), 1, 32) AS source_id FROM ({_NAMED})")
def joi_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, records = _filled(spark, sf_dir)
    return made.resolve(records).select("event_id", "source_name", "source_id")


@query("src_20_catalogue", f"""WITH n AS (SELECT *, event_id % 5 % 2 AS batch, row_number() OVER (PARTITION BY name ORDER BY event_id % 5 % 2, event_id) AS r FROM ({_NAMED})), c AS (SELECT name, count(*) AS event_count, max(time) AS last_event_at FROM n GROUP BY 1)
SELECT substr(sha256(name), 1, 32) AS id, name, vendor, product, fmt AS format_type, CASE fmt WHEN 'cisco_asa' THEN 'firewall' ELSE 'network' END AS category, about AS description, true AS is_active, batch AS created_at, event_count, last_event_at
FROM n JOIN c USING (name) WHERE r = 1 AND vendor <> 'Juniper' ORDER BY created_at DESC, id""")
def src_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue with its counts, after one vendor's sources were taken out."""
    made, records = _filled(spark, sf_dir)
    resolved = made.resolve(records).select("source_id", "time")
    made.remove(made.current().filter("vendor = 'Juniper'"))
    return made.listed(resolved)


@query("prj_40_archive", f"""SELECT c.event_uid AS id, c.sequence_num, CAST(NULL AS VARCHAR) AS raw_id, c.class_uid, c.class_name, CAST(c.class_uid // 1000 AS INT) AS category_uid, e.category_name, c.activity_id, c.activity_name, c.severity_id, c.severity, c.event_time AS time, c.time AS time_epoch_ms, c.src_ip, c.src_port,
c.dst_ip, c.dst_port, c.protocol, c.action, c.disposition, c.user_name, c.finding_title, CASE WHEN e.event_id % 2 = 0 THEN '{{"parse":{{"parser_pack":"own"}}}}' ELSE '{{}}' END AS unmapped_json, CASE WHEN e.event_id % 2 = 0 THEN 'own' ELSE e.parser_pack END AS parser_pack FROM ({_CONTRACT}) c JOIN ({EVENTS}) e ON c.sequence_num = e.sequence_num""")
def prj_40(spark: SparkSession, sf_dir: str) -> DataFrame:
    unmapped = F.when(F.col("event_id") % 2 == 0, '{"parse":{"parser_pack":"own"}}')
    return archive.archive_rows(_exported(spark, sf_dir).withColumn("unmapped", unmapped)).drop("normalized_json")  # JSON text differs between engines; tests read it


@query("prj_42_canonical", f"SELECT event_id, concat(CASE WHEN event_id % 5 NOT IN (0, 3) THEN 'action,' ELSE '' END, 'src_ip', CASE WHEN event_id % 2 = 0 THEN ',user' ELSE '' END) AS fields, CASE WHEN event_id % 5 IN (0, 3) THEN '' ELSE 'deny' END AS action, concat('policy=', severity_id) AS own FROM ({EVENTS})")
def prj_42(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = {"src_ip": F.col("src_ip"), "user": F.when(F.col("event_id") % 2 == 0, F.col("user_name")), "action": F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 5 != 3, "deny")}
    extra = F.create_map(F.lit("policy"), F.col("severity_id").cast("string"), F.lit("note"), F.lit(""), F.lit("zone"), F.lit(None).cast("string"))
    e = events(spark, sf_dir).select("event_id", archive.canonical_event("Acme", "Wall", 4001, said, extra, (6, "Traffic")).alias("c"))
    own = F.array_join(F.transform(F.map_entries("c.vendor_fields"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys("c.fields")), ",").alias("fields"), F.coalesce(F.col("c.fields")["action"], F.lit("")).alias("action"), own.alias("own"))


@query("srt_06_ledger", f"SELECT sequence_num, CASE WHEN event_id % 11 <> 0 THEN event_id END AS event_id, CASE WHEN event_id % 11 <> 0 THEN severity END AS severity, CASE WHEN event_id % 11 <> 0 THEN class_name END AS class_name, CASE WHEN event_id % 11 <> 0 THEN action END AS action FROM ({EVENTS}) ORDER BY sequence_num DESC LIMIT 200")
def srt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ledger = e.select("sequence_num", F.when(F.col("event_id") % 11 != 0, F.col("event_id")).alias("event_id"))
    return archive.newest_ledger(ledger, e, 200).select("sequence_num", "event_id", "severity", "class_name", "action")


@query("srt_06_incidents", f"SELECT concat('i', event_id % 40) AS incident_id, arg_max(severity, time) AS severity, max(time) AS created_at FROM ({EVENTS}) GROUP BY 1 ORDER BY 3 DESC, 1")
def srt_06_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = events(spark, sf_dir).select(F.concat(F.lit("i"), (F.col("event_id") % 40).cast("string")).alias("incident_id"), "severity", F.col("time").alias("created_at"))
    return archive.newest_incidents(stored)


@query("det_10_export", f"SELECT * FROM ({features.features_sql(FLOWS, 'user_name', 'user')}) ORDER BY window_start_ms, entity LIMIT 1000")
def det_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest windows as a CSV file, read back."""
    table, out = features.window_features(flows(spark, sf_dir), "user"), scratch_dir(spark, "exported")
    archive.write_features(table, out, "csv", 1000)
    return spark.read.option("header", "true").schema(table.schema).csv(out)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five formats; ``kind`` is what they are."""
    e = _as_cef(events(spark, sf_dir))
    n = F.col("event_id") % 5
    pairs = F.concat(F.lit("SRC="), "src_ip", F.lit(" dst="), "dst_ip", F.lit(" dport="), F.col("dst_port").cast("string"), F.lit(" zone=inside"))
    line = F.when(n == 0, F.to_json(F.struct("src_ip", F.col("dst_ip").alias("dest_ip"), "severity"))).when(n == 1, pairs).when(n == 2, F.col("line"))
    return e.select("event_id", line.when(n == 3, F.concat(F.lit("<13>Jan  2 03:04:05 fw1 app: "), pairs)).otherwise(F.concat(F.lit(" went from "), "src_ip", F.lit(" to "), "dst_ip", F.lit("\n"))).alias("line"))


@query("prj_37_detect", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'kv' WHEN 2 THEN 'cef' WHEN 3 THEN 'syslog_kv' ELSE 'text' END AS kind, CASE event_id % 5 WHEN 0 THEN src_ip WHEN 1 THEN src_ip WHEN 3 THEN src_ip END AS src_ip FROM ({EVENTS})")
def prj_37(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _lines(spark, sf_dir).select("event_id", candidates.detect(F.col("line")).alias("d"))
    found = F.when(F.col("d.kind") != "cef", F.coalesce(F.col("d.fields")["src_ip"], F.col("d.fields")["SRC"]))
    return got.select("event_id", "d.kind", found.alias("src_ip"))


def _tested(spark: SparkSession, sf_dir: str, n: int) -> tuple[candidates.Candidate, DataFrame]:
    """The candidate that the first line of one format proposes, tried on the lines of all formats."""
    lines = _lines(spark, sf_dir)
    sample = lines.filter(F.col("event_id") % 5 == n).orderBy("event_id").first().line
    made = candidates.propose(spark, sample, "acme", "Acme", "Wall")
    return made, candidates.tested(made, lines)


@query("prj_41_validation", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS total, count(*) FILTER (WHERE event_id % 5 IN ({at})) AS passed, count(*) FILTER (WHERE event_id % 5 NOT IN ({at})) AS failed, round(count(*) FILTER (WHERE event_id % 5 IN ({at})) * 100.0 / count(*), 1) AS accuracy FROM ({EVENTS})" for k, at in (("json", "0"), ("kv", "1, 2, 3"), ("regex", "0, 1, 2, 3, 4"))))
def prj_41(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = None
    for n in (0, 1, 4):
        made, tried = _tested(spark, sf_dir, n)
        one = candidates.validation(tried).select(F.lit(made.kind).alias("kind"), "*")
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("prj_41_unmapped", f"SELECT 'zone' AS field, count(*) AS n FROM ({EVENTS}) WHERE event_id % 5 IN (1, 3)")
def prj_41_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, tried = _tested(spark, sf_dir, 1)
    return candidates.unmapped(made, tried.filter(F.col("event_id") % 5 != 2))


# All events between few addresses, so that what is allowed, what alerts and what sweeps meet
_NEAR = f"SELECT * REPLACE (concat('10.0.0.', event_id % 3) AS src_ip, '198.51.100.7' AS dst_ip) FROM ({EVENTS})"
_ALERTS = "SELECT b.event_id AS alert_id, arg_max(a.event_id, a.pos) AS allowed_id, arg_max(b.time - a.time, a.pos) AS gap_ms, array_to_string(any_value(b.addresses), ',') AS shared FROM s a JOIN s b ON a.addresses = b.addresses AND a.source_id <> b.source_id AND a.pos < b.pos AND b.time - a.time BETWEEN 0 AND 600000 WHERE a.class_uid = 4001 AND a.disposition = 'allowed' AND b.class_uid = 2004 GROUP BY b.event_id"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = events(spark, sf_dir).withColumn("src_ip", F.concat(F.lit("10.0.0."), (F.col("event_id") % 3).cast("string"))).withColumn("dst_ip", F.lit("198.51.100.7"))
    return correlate.scope(near)


def _alerts(rows: DataFrame) -> DataFrame:
    shared = rows.select(F.col("event_id").alias("alert_id"), F.array_join("addresses", ",").alias("shared"))
    return correlate.allowed_then_alert(rows).join(shared, "alert_id")


@query("joi_09_alerts", f"WITH {correlate.scope_sql(_NEAR)} {_ALERTS}")
def joi_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alerts(_near(spark, sf_dir))


@query("agg_26_recommendations", f"""WITH {correlate.scope_sql(_NEAR)}, p AS (SELECT a.event_id AS seen, array_to_string(list_sort(list_intersect(a.addresses, b.addresses)), ', ') AS shared, row_number() OVER (PARTITION BY a.event_id ORDER BY b.pos) AS r FROM s a JOIN s b ON b.pos > a.pos AND a.source_id <> b.source_id
  AND b.time - a.time BETWEEN 0 AND 1800000 AND len(list_intersect(a.addresses, b.addresses)) > 0 WHERE a.class_uid = 3002 AND a.status = 'success' AND b.class_uid IN (4001, 2004)),
w AS (SELECT b.src_ip, b.pos, any_value(b.event_id) AS seen, count(DISTINCT a.dst_port) AS ports FROM s a JOIN s b ON a.src_ip = b.src_ip AND a.pos <= b.pos AND b.time - a.time BETWEEN 0 AND 60000 GROUP BY 1, 2),
t AS (SELECT 0 AS rank, seen, 'Confirm with the account owner that the session behind ' || shared || ' was theirs; revoke it if not.' AS text FROM p WHERE r = 1
  UNION ALL SELECT 1, alert_id, 'Pull the sensor''s payload for the alert between ' || replace(shared, ',', ' and ') || ' and review the rule that allowed the connection.' FROM ({_ALERTS})
  UNION ALL SELECT 2, arg_min(seen, pos), 'Check whether ' || src_ip || ' is a known scanner; block it at the perimeter if not.' FROM w WHERE ports >= 10 GROUP BY src_ip),
o AS (SELECT text, min({{'rank': rank, 'seen': seen}}) AS first FROM t GROUP BY 1)
SELECT row_number() OVER (ORDER BY first) AS pos, text FROM o UNION ALL SELECT count(*) + 1, 'Verify the integrity chain before these events are used as evidence.' FROM o""")
def agg_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _near(spark, sf_dir)
    return correlate.recommendations(correlate.login_then_activity(rows), _alerts(rows), correlate.port_sweeps(rows))
