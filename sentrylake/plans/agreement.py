"""Further registered queries: do the stores agree, payloads of outputs, detector lines, files with headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.operators import accounts, baseline, features, integrity, ocsf
from sentrylake.sources import inbound, payloads

from .fixtures import EVENTS, FLOWS, T0, events, flows, table
from .queries import query

# Events as contract rows: their JSON and the columns beside it, alike in both engines.
ROWS = f"""SELECT *, CAST(NULL AS STRING) AS sender_ip, 'Cisco' AS vendor, 'ASA' AS product, 'Traffic' AS activity_name, concat('uid-', CAST(event_id AS STRING)) AS event_uid,
  CASE WHEN class_uid = 2004 THEN concat('alert ', CAST(event_id % 9 AS STRING)) END AS finding_title,
  concat('{{"class_uid":', CAST(class_uid AS STRING), ',"severity":"', severity, '","src_endpoint":{{"ip":"', src_ip, '","port":', CAST(src_port AS STRING), '}},"metadata":{{"product":{{"name":"ASA"}},"labels":["a","b"]}},"user":{{}}}}') AS ocsf
FROM ({EVENTS})"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = ROWS.split("\nFROM (")[0].replace("{", "{{").replace("}", "}}")
    return spark.sql(f"{head} FROM {{e}}", e=events(spark, sf_dir))


_AT = "concat(strftime(make_timestamp(time * 1000), '%Y-%m-%dT%H:%M:%S.%g'), 'Z')"
_SUMMARY = "concat_ws(' | ', concat(class_name, ': Traffic'), finding_title, concat(src_ip, ' -> ', dst_ip), action)"


@query("snk_06_payloads", f"""SELECT event_id,
  concat('{{"time":', CAST(CAST(floor(time / 1000) AS BIGINT) AS VARCHAR), '.000,"host":"', device_hostname, '","source":"sentrylake","sourcetype":"ocsf:sentrylake","event":', ocsf, '}}') AS splunk_hec,
  concat('{{"create":{{"_index":"sentrylake-ocsf-', strftime(make_timestamp(time * 1000), '%Y.%m.%d'), '","_id":"', event_uid, '"}}}}', chr(10), '{{"@timestamp":"', {_AT}, '",', substr(ocsf, 2)) AS elasticsearch,
  concat('{{"TimeGenerated":"', {_AT}, '","ClassUid":', class_uid, ',"ClassName":"', class_name, '","ActivityName":"Traffic","SeverityId":', severity_id, ',"Severity":"', severity, '","SrcIp":"', src_ip, '","SrcPort":', src_port, ',"DstIp":"', dst_ip,
    '","DstPort":', dst_port, ',"UserName":"', user_name, '","Action":"', action, '","Vendor":"Cisco","Product":"ASA","Message":"', {_SUMMARY}, '","Ocsf":', ocsf, '}}') AS sentinel,
  concat('{{"ddsource":"sentrylake","service":"sentrylake","hostname":"', device_hostname, '","ddtags":"ocsf_class:', class_uid, ',severity:', lower(severity), '","message":"', replace(ocsf, '"', '\\"'), '"}}') AS datadog
FROM ({ROWS})""")
def snk_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", *[payloads.OUTPUTS[k]().alias(k) for k in ("splunk_hec", "elasticsearch", "sentinel", "datadog")])


@query("snk_06_loki", f"""SELECT event_id, 'sentrylake' AS job, replace(lower(class_name), ' ', '_') AS class, lower(severity) AS severity, CAST(time * 1000000 AS VARCHAR) AS at, ocsf AS line FROM ({ROWS})""")
def snk_06_loki(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"
    one = rows(spark, sf_dir).select("event_id", F.from_json(payloads.loki(), shape)["streams"][0].alias("s"))
    label = lambda k, name: F.col("s.stream")[k].alias(name)
    return one.select("event_id", label("job", "job"), label("ocsf_class", "class"), label("severity", "severity"), F.col("s.values")[0][0].alias("at"), F.col("s.values")[0][1].alias("line"))


@query("snk_07_keyed", f"SELECT sequence_num, src_ip AS key, ocsf AS value FROM ({ROWS})")
def snk_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads.shaped(rows(spark, sf_dir), "kafka")


@query("fun_26_key_attributes", f"""WITH r AS (SELECT * FROM ({ROWS})) SELECT event_id, {_SUMMARY} AS summary, device_hostname AS host, key, value FROM r, LATERAL (SELECT * FROM (VALUES
  ('class_uid', CAST(class_uid AS VARCHAR)), ('severity', severity), ('src_endpoint.ip', src_ip), ('src_endpoint.port', CAST(src_port AS VARCHAR)), ('metadata.product.name', 'ASA')) v(key, value)) x""")
def fun_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", payloads.summary().alias("summary"), payloads.host_of().alias("host"), F.explode(payloads.key_attributes(F.col("ocsf"))))


@query("fun_13_flatten", f"""WITH r AS (SELECT * FROM ({ROWS})) SELECT event_id, key, value FROM r, LATERAL (SELECT * FROM (VALUES
  ('class_uid', CAST(class_uid AS VARCHAR)), ('severity', severity), ('src_endpoint.ip', src_ip), ('src_endpoint.port', CAST(src_port AS VARCHAR)), ('metadata.product.name', 'ASA'), ('metadata.labels', 'a, b')) v(key, value)) x""")
def fun_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", F.inline(payloads.flatten_json(F.col("ocsf"))))


@query("fun_25_prune", f"SELECT event_id, replace(ocsf, ',\"user\":{{}}', '') AS pruned FROM ({ROWS})")
def fun_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("event_id", payloads.prune_json(F.col("ocsf")).alias("pruned"))


@query("fun_23_label", f"SELECT event_id, nullif(CAST(event_id % 3 AS VARCHAR), '0') AS parser FROM ({EVENTS})")
def fun_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 3 == 0, "").otherwise((F.col("event_id") % 3).cast("string"))
    labels = F.array(F.lit("other=1"), F.concat(F.lit("lake.parser="), value))
    return events(spark, sf_dir).select("event_id", ocsf.label(labels, "parser", "lake").alias("parser"))


# Stores: raw lines lack every 13th, the ledger every 17th event; revisions are the events named by superseded_by.


def _raw(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_id") % 4 == 0, "generic_inferred").otherwise("cisco_asa")
    transport = F.when(F.col("event_id") % 6 == 0, "api").when(F.col("event_id") % 6 > 1, "udp")
    return e.filter("event_id % 13 <> 0").select(F.concat(F.lit("r"), "event_id").alias("raw_id"), "raw_text", kind.alias("format_detected"), F.concat(F.lit("f"), F.col("event_id") % 8).alias("format_id"), transport.alias("transport"))


def _ledger(e: DataFrame) -> DataFrame:
    return e.select("sequence_num", "event_id", F.concat(F.lit("r"), "event_id").alias("raw_id"))


@query("joi_04_evidence", f"SELECT sequence_num, event_id, severity, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'raw' END, CASE WHEN event_id % 17 = 0 THEN 'event' END) AS missing FROM (SELECT sequence_num, event_id, CASE WHEN event_id % 17 <> 0 THEN severity END AS severity FROM ({EVENTS}))")
def joi_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return accounts.evidence_records(_ledger(e), _raw(e), e.filter("event_id % 17 <> 0")).select("sequence_num", "event_id", "severity", "missing")


def _revised(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """String ids; each superseded event has a new one. Every 5th link names another event, every 7th new event is gone."""
    ids = e.select(F.col("event_id").cast("string").alias("event_id"), "superseded_by", F.lit(None).cast("string").alias("revises"))
    old = e.filter("superseded_by IS NOT NULL")
    named = F.when(F.col("event_id") % 5 == 0, "0").otherwise(F.col("event_id").cast("string"))
    new = old.filter("event_id % 7 <> 0").select(F.col("superseded_by").alias("event_id"), F.lit(None).cast("string").alias("superseded_by"), F.col("event_id").cast("string").alias("revises"))
    return ids.unionByName(new), old.select(F.col("superseded_by").alias("event_id"), named.alias("supersedes"))


@query("joi_13_revisions", f"SELECT count(*) AS revisions, count(*) AS superseded, count(*) FILTER (WHERE (event_id % 5 = 0 AND event_id <> 0) OR event_id % 7 = 0) AS broken_links, count(*) FILTER (WHERE (event_id % 5 = 0 AND event_id <> 0) OR event_id % 7 = 0) = 0 AS consistent FROM ({EVENTS}) WHERE superseded_by IS NOT NULL")
def joi_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.revision_check(*_revised(events(spark, sf_dir)))


_COUNTS = f"""SELECT count(*) FILTER (WHERE event_id % 13 <> 0) AS raw_archived, count(*) AS events, count(superseded_by) AS revisions, count(*) AS hash_chained,
  count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 6 > 1) AS streamed, count(*) - count(superseded_by) AS current_events,
  count(*) FILTER (WHERE event_id % 13 <> 0) = count(*) - count(superseded_by) AS consistent FROM ({EVENTS})"""


@query("agg_18_counts", _COUNTS)
def agg_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return accounts.pipeline_counts(_raw(e), e, _ledger(e), e.filter("superseded_by IS NOT NULL"))


@query("led_12_fingerprint", f"""SELECT raw_archived, events, sha256(concat('{{"consistent":', consistent, ',"current_events":', current_events, ',"events":', events, ',"hash_chained":', hash_chained, ',"raw_archived":', raw_archived, ',"revisions":', revisions, ',"streamed":', streamed, '}}')) AS report_sha256 FROM ({_COUNTS})""")
def led_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.report_fingerprint(agg_18(spark, sf_dir)).select("raw_archived", "events", "report_sha256")


@query("joi_19_candidates", f"SELECT concat('f', event_id % 8) AS format_id, count(*) AS lines FROM ({EVENTS}) WHERE superseded_by IS NULL AND event_id % 13 <> 0 AND event_id % 4 = 0 AND event_id % 8 = 4 GROUP BY 1")
def joi_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    formats = spark.createDataFrame([("f4",), ("f5",)], "format_id string")
    return accounts.reparse_candidates(_raw(e), e.withColumn("raw_id", F.concat(F.lit("r"), "event_id")), formats)


@query("joi_20_incidents", f"SELECT concat('i', event_id % 50) AS incident_id, concat('case ', event_id % 50) AS title, sequence_num, event_id, severity FROM ({EVENTS})")
def joi_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    facts = e.groupBy((F.col("event_id") % 50).alias("i")).agg(F.collect_list(F.struct("sequence_num")).alias("observed_facts"))
    incidents = facts.select(F.concat(F.lit("i"), "i").alias("incident_id"), F.to_json(F.struct(F.concat(F.lit("case "), "i").alias("title"), "observed_facts")).alias("data_json"))
    return accounts.incident_events(incidents, e).select("incident_id", "title", "sequence_num", "event_id", "severity")


@query("joi_15_aliases", f"SELECT event_id, CASE WHEN event_id % 8 IN (1, 3) THEN 'f0' ELSE concat('f', event_id % 8) END AS canonical_id FROM ({EVENTS})")
def joi_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("f1", "f0"), ("f3", "f0")], "alias string, format_id string")
    lines = events(spark, sf_dir).select("event_id", F.concat(F.lit("f"), F.col("event_id") % 8).alias("format_id"))
    return accounts.resolve_formats(lines, aliases).select("event_id", "canonical_id")


@query("agg_25_formats", f"SELECT concat('f', event_id % 8) AS format_id, count(*) AS count, round(sum(event_id % 10) / 10.0 / count(*), 2) AS avg_confidence, CAST(CASE WHEN event_id % 8 = 0 THEN 2 ELSE 0 END AS BIGINT) AS aliases FROM ({EVENTS}) WHERE event_id % 8 < 6 GROUP BY event_id % 8")
def agg_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = events(spark, sf_dir).groupBy((F.col("event_id") % 8).alias("f")).agg(F.count("*").alias("count"), (F.sum(F.col("event_id") % 10) / 10.0).alias("confidence_sum"))
    formats = seen.select(F.concat(F.lit("f"), "f").alias("format_id"), "count", "confidence_sum", F.when(F.col("f") < 6, "new").otherwise("approved").alias("status"))
    aliases = spark.createDataFrame([("a1", "f0"), ("a2", "f0"), ("a2", "f0")], "alias string, format_id string")
    return accounts.list_formats(formats, aliases, "new").select("format_id", "count", "avg_confidence", "aliases")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with faults: each 9th has another type number, each 10th no time."""
    end = lambda s: F.when(F.col("event_id") % 21 != 0, F.struct(F.col(f"{s}_ip").alias("ip")))
    return events(spark, sf_dir).select(
        "event_id", "sequence_num", "class_uid", F.lit(6).alias("activity_id"), (F.col("class_uid") * 100 + F.when(F.col("event_id") % 9 == 0, 7).otherwise(6)).alias("type_uid"), "severity_id",
        F.when(F.col("event_id") % 10 != 0, F.col("time")).alias("time"), F.col("user_name").alias("user"), end("src").alias("src_endpoint"), end("dst").alias("dst_endpoint"),
    )


_VALID = "event_id % 9 <> 0 AND event_id % 10 <> 0 AND (event_id % 21 <> 0 OR class_uid <> 4001)"


@query("agg_17_conformance", f"SELECT count(*) AS checked, count(*) FILTER (WHERE {_VALID}) AS valid, max(sequence_num) AS after, round_even(100.0 * count(*) FILTER (WHERE {_VALID}) / count(*), 1) AS valid_pct FROM ({EVENTS}) WHERE sequence_num > 100")
def agg_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.conformance(_exported(spark, sf_dir), 100)


@query("agg_17_failures", f"SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN event_id % 9 = 0 THEN 'type_uid' END, CASE WHEN event_id % 10 = 0 THEN 'time' END, CASE WHEN event_id % 21 = 0 AND class_uid = 4001 THEN 'endpoints' END], lambda x: x IS NOT NULL)) AS violation FROM ({EVENTS})) GROUP BY 1")
def agg_17_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.conformance_failures(_exported(spark, sf_dir))


# A witness: nation keys are logs, regions and their order checkpoints.


@query("agg_27_logs", "SELECT n_nationkey AS log_id, n_name AS node_key_id, count(c_custkey) AS checkpoints, coalesce(max(c_custkey), 0) AS last_index FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 3 <> 0 GROUP BY 1, 2")
def agg_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("log_id"), F.col("n_name").alias("node_key_id"))
    signed = table(spark, sf_dir, "customer").filter("c_nationkey % 3 <> 0").select(F.col("c_nationkey").alias("log_id"), F.col("c_custkey").alias("idx"))
    return accounts.log_counts(nodes, signed)


@query("led_08_cosign", """SELECT log_id, CAST(idx AS BIGINT) AS idx, variant, CASE WHEN idx <= 3 THEN CASE WHEN variant = 'a' THEN 'signed before' ELSE 'another digest is signed' END WHEN variant = 'b' THEN 'another digest is signed'
  WHEN log_id % 4 = 1 AND idx = 6 THEN 'does not extend' WHEN log_id % 4 = 1 AND idx > 6 THEN 'not the next index' WHEN log_id % 4 = 2 AND idx > 4 THEN 'not the next index' ELSE 'signed' END AS verdict
FROM (SELECT n_nationkey AS log_id, i AS idx, v AS variant FROM nation, unnest([2, 3, 4, 5, 6, 7, 8]) t(i), unnest(['a', 'b']) w(v)) WHERE NOT (log_id % 4 = 2 AND idx = 5)""")
def led_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda idx, v: F.concat_ws("-", F.col("log_id").cast("string"), idx.cast("string"), v)
    logs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("log_id"))
    held = logs.select("log_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("idx")).withColumn("digest", name(F.col("idx"), F.lit("a")))
    asked = logs.select("log_id", F.explode(F.sequence(F.lit(2), F.lit(8))).alias("idx")).filter("NOT (log_id % 4 = 2 AND idx = 5)").withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b"))))
    prev = F.when((F.col("log_id") % 4 == 1) & (F.col("idx") == 6), "forged").otherwise(name(F.col("idx") - 1, F.lit("a")))
    got = accounts.cosign(held, asked.select("log_id", "idx", prev.alias("prev"), name(F.col("idx"), F.col("variant")).alias("digest")))
    return got.select("log_id", F.col("idx").cast("long").alias("idx"), F.element_at(F.split("digest", "-"), -1).alias("variant"), "verdict")


@query("led_10_register", f"SELECT 'siem' AS output, CAST(5 AS BIGINT) AS first_sequence UNION ALL SELECT 'lake', max(sequence_num) + 1 FROM ({EVENTS})")
def led_10_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("siem", 5)], "output string, first_sequence long")
    return accounts.register_outputs(known, spark.createDataFrame([("siem",), ("lake",)], "output string"), events(spark, sf_dir))


@query("led_10_batches", f"""WITH RECURSIVE b AS (SELECT event_id // 500 + 1 AS id, count(*) AS n, sha256(string_agg(concat(sequence_num, ':u', event_id), chr(10) ORDER BY sequence_num)) AS events_hash FROM ({EVENTS}) GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY id) AS r FROM b),
c AS (SELECT id, r, n, events_hash, '{integrity.GENESIS}' AS prev_hash, sha256(concat('{integrity.GENESIS}:siem:delivered:live:', id * 10, ':', n, ':', events_hash)) AS batch_hash FROM o WHERE r = 1
  UNION ALL SELECT o.id, o.r, o.n, o.events_hash, c.batch_hash, sha256(concat(c.batch_hash, ':siem:delivered:live:', o.id * 10, ':', o.n, ':', o.events_hash)) FROM c JOIN o ON o.r = c.r + 1)
SELECT id, n AS count, events_hash, prev_hash, batch_hash FROM c""")
def led_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = events(spark, sf_dir).select((F.floor(F.col("event_id") / 500) + 1).cast("long").alias("batch_id"), F.lit("siem").alias("output"), F.lit("delivered").alias("outcome"), F.lit("live").alias("trigger"), "sequence_num", F.concat(F.lit("u"), "event_id").alias("event_uid"))
    return accounts.delivery_batches(sent.withColumn("at", F.col("batch_id") * 10)).select("id", "count", "events_hash", "prev_hash", "batch_hash")


@query("srt_02_findings", f"SELECT event_id, time, severity FROM ({EVENTS}) WHERE superseded_by IS NULL AND class_uid = 2004 ORDER BY time DESC, sequence_num DESC LIMIT 200")
def srt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.newest_findings(events(spark, sf_dir)).select("event_id", "time", "severity")


@query("srt_04_by_count", f"SELECT dst_port, count(*) AS n FROM ({EVENTS}) GROUP BY 1 ORDER BY 2 DESC, 1")
def srt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts.by_count(events(spark, sf_dir), "dst_port")


_HOSTED = f"SELECT event_id, src_ip AS peer_ip, CASE event_id % 3 WHEN 0 THEN 'Unknown' ELSE 'Cisco' END AS vendor, 'p' AS product, CASE event_id % 5 WHEN 0 THEN device_hostname WHEN 1 THEN 'bad name' END AS hostname FROM ({EVENTS})"


@query("str_07_sender_hosts", f"""WITH h AS (SELECT *, CASE WHEN hostname = 'bad name' THEN NULL ELSE hostname END AS own FROM ({_HOSTED})),
s AS (SELECT *, min(own) OVER w AS low, max(own) OVER w AS high FROM h WINDOW w AS (PARTITION BY peer_ip, vendor, product ORDER BY event_id))
SELECT event_id, coalesce(own, CASE WHEN vendor <> 'Unknown' AND low = high THEN low END) AS device FROM s""")
def str_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    name = F.when(F.col("event_id") % 5 == 0, F.col("device_hostname")).when(F.col("event_id") % 5 == 1, "bad name")
    vendor = F.when(F.col("event_id") % 3 == 0, "Unknown").otherwise("Cisco")
    lines = e.select("event_id", F.col("src_ip").alias("peer_ip"), vendor.alias("vendor"), F.lit("p").alias("product"), F.col("event_id").alias("at"), name.alias("hostname"))
    return accounts.sender_hosts(lines, F.col("hostname")).select("event_id", "device")


# Detector


_FEATURES = features.features_sql(FLOWS, "src_ip", "src_ip")
_UNTIL = T0 + 82_000_000


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.reasons(features.window_features(flows(spark, sf_dir), "src_ip"), "src_ip")


@query("det_08_run", f"SELECT entity, window_start_ms, feature FROM ({baseline.reasons_sql(_FEATURES, 'src_ip')}) WHERE window_start_ms < {_UNTIL // 300000 * 300000} AND window_start_ms >= {_UNTIL // 300000 * 300000 - 12 * 3600000}")
def det_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = baseline.run(features.window_features(flows(spark, sf_dir), "src_ip"), "src_ip", _UNTIL, 12.0)
    return found.select("entity", "window_start_ms", "feature")


_SHOWN = "CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
_BYTES = "CASE WHEN {c} >= 1e9 THEN format('{{:.1f}} GB', {c} / 1e9) WHEN {c} >= 1e6 THEN format('{{:.1f}} MB', {c} / 1e6) WHEN {c} >= 1e3 THEN format('{{:.1f}} kB', {c} / 1e3) ELSE format('{{:.0f}} B', {c}) END"
_AMOUNT = {c: f"CASE WHEN feature = 'bytes_out' THEN {_BYTES.format(c=c)} ELSE {_SHOWN.format(c=c)} END" for c in ("value", "median", "highest")}


@query("det_09_texts", f"""SELECT entity, window_start_ms, feature, {_AMOUNT['value']} || ' ' || noun || ' in 5 min; ' || CASE baseline WHEN 'own history' THEN 'its ' ELSE 'all peers'' ' END || history || ' earlier windows: median ' || {_AMOUNT['median']}
  || ', highest ' || {_AMOUNT['highest']} || CASE WHEN spread_from = 'mad' THEN format(', robust z {{:.1f}}', z) ELSE '' END AS text
FROM ({baseline.reasons_sql(_FEATURES, 'src_ip')}) JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in baseline.NOUNS.items())}) n(feature, noun) USING (feature)""")
def det_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir).select("entity", "window_start_ms", "feature", baseline.reason_text().alias("text"))


@query("prj_31_own_lines", f"SELECT finding_uid, title AS finding_title, entity AS src_ip, 'medium' AS severity, window_start_ms + 300000 AS time FROM ({baseline.flags_sql(_FEATURES, 'src_ip')})")
def prj_31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.read_lines(baseline.flag_lines(_reasons(spark, sf_dir))).select("finding_uid", "finding_title", "src_ip", "severity", "time")


# Files, batches, loose rows


@query("src_17_csv_headers", f"""SELECT event_id, event_id % 20 < 10 AS has_names, CASE WHEN event_id % 20 < 10 THEN src_ip END AS src, CASE WHEN event_id % 20 < 10 THEN user_name END AS user_name FROM ({EVENTS})""")
def src_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("path", F.concat(F.lit("f"), (F.col("event_id") % 20).cast("string")))
    cells = lambda *c: F.concat_ws(",", *c)
    body = e.select("path", (F.col("event_id") + 2).alias("pos"), cells(F.col("event_id").cast("string"), "src_ip", "user_name").alias("line"))
    files = e.select("path").distinct()
    first = F.when(F.substring("path", 2, 2).cast("int") < 10, "id,src ip,user").otherwise("# a,b=c,d")
    heads = files.select("path", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("  ").alias("line")), F.struct(F.lit(1).cast("long").alias("pos"), first.alias("line")))).alias("x")).select("path", "x.*")
    got = inbound.csv_lines(body.unionByName(heads)).filter("pos > 1")
    row = F.map_from_arrays("names", F.split("line", ","))
    return got.select((F.col("pos") - 2).alias("event_id"), F.col("names").isNotNull().alias("has_names"), row["src ip"].alias("src"), row["user"].alias("user_name"))


@query("src_09_batch_counts", f"SELECT event_id % 10 AS upload, count(*) AS total, count(*) FILTER (WHERE event_id % 7 <> 0) AS ingested, count(*) FILTER (WHERE event_id % 7 = 0) AS skipped_blank FROM ({EVENTS}) GROUP BY 1")
def src_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("event_id") % 14 == 0, " \t\r\n").when(F.col("event_id") % 7 != 0, F.concat(F.lit("# "), "raw_text"))
    return inbound.batch_counts(events(spark, sf_dir).select((F.col("event_id") % 10).alias("upload"), line.alias("line")), "upload")


@query("src_16_coerce", f"SELECT sequence_num, CASE WHEN event_id % 3 <> 0 THEN dst_port END AS dst_port, event_id % 4 = 1 AS fields_verified, CASE WHEN event_id % 2 = 0 THEN device_hostname ELSE src_ip END AS device, CAST(NULL AS BIGINT) AS bytes_in FROM (SELECT *, CAST(dst_port AS BIGINT) AS p FROM ({EVENTS}))")
def src_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    port = F.when(F.col("event_id") % 3 == 0, "http").otherwise(F.col("dst_port").cast("string"))
    flag = F.when(F.col("event_id") % 4 == 1, True).when(F.col("event_id") % 4 == 2, False)
    host = F.when(F.col("event_id") % 2 == 0, F.col("device_hostname"))
    loose = events(spark, sf_dir).select("sequence_num", port.alias("dst_port"), flag.alias("fields_verified"), host.alias("device_hostname"), F.col("src_ip").alias("sender_ip"))
    return features.coerce(loose).select("sequence_num", F.col("dst_port").cast("int").alias("dst_port"), "fields_verified", "device", "bytes_in")


@query("prj_10_line_format", f"""SELECT event_id, ['json', 'cef', 'leef', 'cef_syslog', 'syslog', 'syslog_kv', 'kv', 'unstructured', 'empty'][event_id % 9 + 1] AS format FROM ({EVENTS})""")
def prj_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cef = r"CEF:0|a|b\|c|1|2|name|5|src=1.2.3.4"
    lines = ['{"a":1}', cef, "LEEF:1.0|a|b|c|d|src=1", f"<134>{cef}", "<134>Jan  1 00:00:00 host app: no pairs here", "<134>Jan  1 00:00:00 host app: a=1", "a=1 b=2", "just some words", "  "]
    kind = F.get(F.array(*map(F.lit, lines)), (F.col("event_id") % 9).cast("int"))
    return events(spark, sf_dir).select("event_id", fm.line_format(kind).alias("format"))
