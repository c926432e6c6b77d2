"""The registered queries of the analytics engine, each with its DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import text as tx
from sentrylake.operators import analytics, baseline, correlate, features, integrity, ocsf, search
from sentrylake.operators.ordered import numbered

from .fixtures import EVENTS, FLOWS, READ_IP, SOURCES, T0, events, flows, sources, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = T0 + 40 * 86_400_000
CURRENT = f"(SELECT * FROM ({EVENTS}) WHERE superseded_by IS NULL)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


# Features and detector

for _kind, _entity in (("src_ip", "src_ip"), ("user", "user_name"), ("device", "coalesce(device_hostname, sender_ip)")):
    query(f"agg_10_features_{_kind}", features.features_sql(FLOWS, _entity, _kind))(lambda s, d, k=_kind: features.window_features(flows(s, d), k))
    query(f"det_01_04_reasons_{_kind}", baseline.reasons_sql(features.features_sql(FLOWS, _entity, _kind), _kind))(
        lambda s, d, k=_kind: baseline.reasons(features.window_features(flows(s, d), k), k)
    )


@query("det_05_flags", baseline.flags_sql(features.features_sql(FLOWS, "src_ip", "src_ip"), "src_ip"))
def det_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.flags(baseline.reasons(features.window_features(flows(spark, sf_dir), "src_ip"), "src_ip"))


@query("joi_17_evidence", f"""WITH f AS ({baseline.flags_sql(features.features_sql(FLOWS, "src_ip", "src_ip"), "src_ip")}), e AS (
  SELECT finding_uid, sequence_num, row_number() OVER (PARTITION BY finding_uid ORDER BY sequence_num) AS r FROM f JOIN ({FLOWS}) x ON x.src_ip = f.entity AND CAST(floor(x.time / 300000) AS BIGINT) * 300000 = f.window_start_ms)
SELECT finding_uid, count(*) AS n, string_agg(CAST(sequence_num AS VARCHAR), ',' ORDER BY sequence_num) AS sequences FROM e WHERE r <= 50 GROUP BY 1""")
def joi_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flows(spark, sf_dir)
    found = baseline.flags(baseline.reasons(features.window_features(rows, "src_ip"), "src_ip"))
    out = baseline.attach_evidence(found, rows, F.col("src_ip"), features.WINDOW_MS)
    return out.select("finding_uid", F.size("event_sequences").cast("long").alias("n"), F.array_join("event_sequences", ",").alias("sequences"))


@query("win_02_own_history", f"SELECT entity, window_start_ms, count(*) OVER (PARTITION BY entity ORDER BY window_start_ms RANGE BETWEEN 86400000 PRECEDING AND 1 PRECEDING) AS own FROM ({features.features_sql(FLOWS, 'src_ip', 'src_ip')})")
def win_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.scored_windows(features.window_features(flows(spark, sf_dir), "src_ip")).select("entity", "window_start_ms", "own")


@query("agg_13_robust_stats", f"WITH x AS (SELECT src_ip, CAST(bytes_out AS DOUBLE) AS v FROM ({FLOWS}) WHERE bytes_out IS NOT NULL), m AS (SELECT src_ip, quantile_cont(v, 0.5) AS median FROM x GROUP BY 1) SELECT src_ip, any_value(median) AS median, quantile_cont(abs(v - median), 0.5) AS mad, avg(abs(v - median)) AS mean_deviation FROM x JOIN m USING (src_ip) GROUP BY 1")
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = flows(spark, sf_dir).filter("bytes_out IS NOT NULL").select("src_ip", F.col("bytes_out").cast("double").alias("v"))
    m = x.groupBy("src_ip").agg(F.percentile("v", F.lit(0.5)).alias("median"))
    apart = F.abs(F.col("v") - F.col("median"))
    return x.join(m, "src_ip").groupBy("src_ip").agg(F.first("median").alias("median"), F.percentile(apart, F.lit(0.5)).alias("mad"), F.avg(apart).alias("mean_deviation"))


# Dashboard

_DIMS = ("category_name", "severity", "class_name", "parser_pack")


@query("agg_02_breakdowns", " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM {CURRENT} GROUP BY 2" for c in _DIMS))
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.breakdowns(search.current(events(spark, sf_dir)), _DIMS)


@query("agg_01_06_overview", f"SELECT count(*) AS total, count(*) FILTER (WHERE superseded_by IS NULL) AS current, min(time) AS oldest, max(time) AS newest, count(DISTINCT source_id) AS sources, count(DISTINCT parser_pack) AS parsers FROM ({EVENTS})")
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.overview(events(spark, sf_dir))


@query("joi_02_by_source", f"SELECT CAST(s.source_id AS INT) AS source_id, source_name, count(e.event_id) AS events FROM ({SOURCES}) s LEFT JOIN {CURRENT} e ON e.source_id = s.source_id GROUP BY 1, 2")
def joi_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.by_source(sources(spark), events(spark, sf_dir))


@query("joi_01_event_source", f"SELECT e.event_id, e.time, s.source_name FROM {CURRENT} e JOIN ({SOURCES}) s USING (source_id)")
def joi_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.current(events(spark, sf_dir)).join(F.broadcast(sources(spark)), "source_id").select("event_id", "time", "source_name")


@query("agg_03_timeline", f"WITH e AS (SELECT *, CAST(floor(time / 300000) AS BIGINT) * 300000 AS slot FROM ({FLOWS})), g AS (SELECT unnest(generate_series((SELECT min(slot) FROM e), (SELECT max(slot) FROM e), 300000)) AS slot) SELECT g.slot, count(e.slot) AS events, count(*) FILTER (WHERE disposition_id IN (2, 6)) AS denied FROM g LEFT JOIN e USING (slot) GROUP BY 1")
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("disposition_id") == 2, "denied").when(F.col("disposition_id") == 6, "dropped").otherwise("allowed")
    return analytics.timeline(flows(spark, sf_dir).withColumn("disposition", named), 300_000)


@query("agg_04_step", f"SELECT event_id, event_id * event_id AS span_s, CAST(coalesce((SELECT min(x) FROM (VALUES (1), (5), (10), (30), (60), (300), (600), (1800), (3600), (7200), (14400), (43200), (86400), (604800)) t(x) WHERE event_id * event_id / x <= 60), 604800) AS INT) AS step FROM ({EVENTS})")
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = events(spark, sf_dir).select("event_id", (F.col("event_id") * F.col("event_id")).alias("span_s"))
    return spans.select("event_id", "span_s", analytics.step_seconds(F.col("span_s") * 1000).alias("step"))


@query("agg_05_top_denied", f"SELECT src_ip, count(*) AS n FROM ({EVENTS}) WHERE disposition IN ('denied', 'dropped', 'blocked') GROUP BY 1 ORDER BY n DESC, src_ip LIMIT 8")
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_denied(events(spark, sf_dir))


@query("agg_16_parse_breakdown", f"SELECT kind, n, round_even(n * 100.0 / sum(n) OVER (), 1) AS percent FROM (SELECT CASE WHEN parser_pack = 'parse_error' THEN 'error' WHEN parser_pack LIKE 'learned:%' THEN 'learned' WHEN parser_pack LIKE 'generic%' THEN 'generic' ELSE 'vendor' END AS kind, count(*) AS n FROM {CURRENT} GROUP BY 1)")
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.parse_breakdown(search.current(events(spark, sf_dir)))


@query("agg_22_retention", f"SELECT min(time) AS oldest, max(time) AS newest, count(*) AS records, CAST(floor(({NOW} - min(time)) / 86400000) AS BIGINT) AS days_held, floor(({NOW} - min(time)) / 86400000) >= 180 AS reached FROM ({EVENTS})")
def agg_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.retention(events(spark, sf_dir), NOW)


# Search, filters, paging

_SMALL = "event_id, time, src_ip, dst_ip, class_uid"


def _small(df: DataFrame) -> DataFrame:
    return df.select(*_SMALL.split(", "))


@query("flt_01_02_explore", f"SELECT {_SMALL} FROM {CURRENT} WHERE source_id = 1 AND severity = 'High' AND class_uid = 4001")
def flt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(search.explore(events(spark, sf_dir), source_id=1, severity="High", class_uid=4001))


@query("flt_03_either_ip", f"SELECT {_SMALL} FROM {CURRENT} WHERE src_ip = '10.0.0.7' OR dst_ip = '10.0.0.7'")
def flt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(search.explore(events(spark, sf_dir), ip="10.0.0.7"))


@query("flt_04_fulltext", f"SELECT event_id FROM ({EVENTS}) WHERE regexp_matches(lower(raw_text), '(^|[^a-z0-9])error by user1')")
def flt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.match(search.index(events(spark, sf_dir)), "error by user1")


@query("flt_05_like", f"SELECT {_SMALL} FROM ({EVENTS}) WHERE raw_text ILIKE '%USER1_ from%'")
def flt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(search.like(events(spark, sf_dir), "USER1_ from"))


@query("flt_06_range", f"SELECT {_SMALL} FROM ({EVENTS}) WHERE time >= {T0 + 60000} AND time < {T0 + 120000}")
def flt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(search.time_range(events(spark, sf_dir), T0 + 60_000, T0 + 120_000))


@query("flt_07_up_to_newest", f"SELECT {_SMALL} FROM ({EVENTS}) WHERE time >= (SELECT max(time) FROM ({EVENTS})) - 300000")
def flt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(search.up_to_newest(events(spark, sf_dir), 5))


@query("flt_08_not_own", f"SELECT {_SMALL} FROM ({EVENTS}) WHERE parser_pack IS NULL OR parser_pack <> 'baseline'")
def flt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(search.not_own(events(spark, sf_dir)))


@query("flt_10_output_filter", f"SELECT {_SMALL} FROM ({EVENTS}) WHERE class_uid IN (2004, 3002) AND severity_id >= 3 AND source_id IN (0, 2)")
def flt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sentrylake.sources.sinks import accepts

    return _small(events(spark, sf_dir).filter(accepts(classes=(2004, 3002), min_severity=3, sources=(0, 2))))


@query("flt_13_private", f"SELECT event_id, CASE WHEN event_id % 2 = 0 THEN true ELSE false END AS private FROM ({EVENTS})")
def flt_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.when(F.col("event_id") % 2 == 0, F.col("src_ip")).otherwise(F.col("dst_ip"))
    return events(spark, sf_dir).select("event_id", search.is_private(ip).alias("private"))


@query("srt_01_page", f"SELECT {_SMALL} FROM {CURRENT} ORDER BY sequence_num DESC LIMIT 50 OFFSET 20")
def srt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(search.page(search.current(events(spark, sf_dir)), 50, 20))


@query("srt_05_keyset", f"SELECT {_SMALL} FROM ({EVENTS}) WHERE sequence_num > 250 ORDER BY sequence_num LIMIT 500")
def srt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(search.keyset_page(events(spark, sf_dir), 250))


# Correlation

_SCOPE = correlate.scope_sql(EVENTS)


def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.scope(events(spark, sf_dir))


@query("joi_08_login_then_activity", f"WITH {_SCOPE}, p AS (SELECT a.event_id AS login_id, b.event_id AS id, b.time - a.time AS gap, b.pos AS pos, list_sort(list_intersect(a.addresses, b.addresses)) AS shared FROM s a JOIN s b ON b.pos > a.pos AND a.source_id <> b.source_id AND b.time - a.time BETWEEN 0 AND 1800000 AND len(list_intersect(a.addresses, b.addresses)) > 0 WHERE a.class_uid = 3002 AND a.status = 'success' AND b.class_uid IN (4001, 2004)) SELECT login_id, arg_min(id, pos) AS first_id, arg_min(gap, pos) AS gap_ms, array_to_string(arg_min(shared, pos), ',') AS shared, count(*) AS matches FROM p GROUP BY 1")
def joi_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.login_then_activity(_scope(spark, sf_dir))


@query("joi_09_allowed_then_alert", f"WITH {_SCOPE} SELECT b.event_id AS alert_id, arg_max(a.event_id, a.pos) AS allowed_id, arg_max(b.time - a.time, a.pos) AS gap_ms FROM s a JOIN s b ON a.addresses = b.addresses AND a.source_id <> b.source_id AND a.pos < b.pos AND b.time - a.time BETWEEN 0 AND 600000 WHERE a.class_uid = 4001 AND a.disposition = 'allowed' AND b.class_uid = 2004 GROUP BY 1")
def joi_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.allowed_then_alert(_scope(spark, sf_dir))


@query("joi_10_port_sweep", f"WITH s AS (SELECT row_number() OVER (ORDER BY time, sequence_num, dst_ip) AS pos, src_ip, time, dst_port FROM ({FLOWS})), h AS (SELECT b.src_ip, b.pos, count(DISTINCT a.dst_port) AS ports FROM s a JOIN s b ON a.src_ip = b.src_ip AND a.pos <= b.pos AND b.time - a.time BETWEEN 0 AND 60000 GROUP BY 1, 2) SELECT src_ip, min(pos) AS event_id, arg_min(ports, pos) AS ports FROM h WHERE ports >= 10 GROUP BY 1")
def joi_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(flows(spark, sf_dir), F.floor(F.col("time") / 60_000), ["time", "sequence_num", "dst_ip"], "pos")
    return correlate.port_sweeps(rows.withColumn("event_id", F.col("pos")))


@query("agg_21_incident", f"WITH {_SCOPE} SELECT count(*) AS events, (SELECT severity FROM s ORDER BY severity_id DESC LIMIT 1) AS severity, min(time) AS start_time, max(time) AS end_time, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT unnest(addresses) AS x FROM s)) AS ips, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT user_name AS x FROM s)) AS users, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT device_hostname AS x FROM s)) AS devices FROM s")
def agg_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.summary(_scope(spark, sf_dir))


# Integrity


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a shard with its own sequence."""
    rows = events(spark, sf_dir)
    order = Window.partitionBy("source_id").orderBy("event_id")
    return rows.select(
        F.col("source_id").alias("shard"), F.row_number().over(order).cast("long").alias("sequence_num"), "raw_text", F.sha2("raw_text", 256).alias("raw_hash"),
        integrity.canonical_json(["event_id", "time", "class_uid", "src_ip", "dst_ip"]).alias("body"),
    )


_CHAIN = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT source_id AS shard, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS sequence_num, sha256(raw_text) AS raw_hash,
  concat('{{"class_uid":', class_uid, ',"dst_ip":"', dst_ip, '","event_id":', event_id, ',"src_ip":"', src_ip, '","time":', time, '}}') AS body FROM ({EVENTS})),
c AS (SELECT shard, sequence_num, repeat('0', 64) AS prev_hash, sha256(concat(repeat('0', 64), ':', sequence_num, ':', raw_hash, ':', body)) AS record_hash FROM r WHERE sequence_num = 1
  UNION ALL SELECT r.shard, r.sequence_num, c.record_hash, sha256(concat(c.record_hash, ':', r.sequence_num, ':', r.raw_hash, ':', r.body)) FROM c JOIN r ON r.shard = c.shard AND r.sequence_num = c.sequence_num + 1)
"""


@query("led_09_chain", _CHAIN + "SELECT shard, sequence_num, prev_hash, record_hash FROM c")
def led_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.chain(_records(spark, sf_dir)).select("shard", "sequence_num", "prev_hash", "record_hash")


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text changed, one body changed and one record gone in shard 1."""
    rows = integrity.chain(_records(spark, sf_dir)).filter("NOT (shard = 1 AND sequence_num = 30)")
    at = lambda n: (F.col("shard") == 1) & (F.col("sequence_num") == n)
    return rows.withColumn("raw_text", F.when(at(10), "changed").otherwise(F.col("raw_text"))).withColumn("body", F.when(at(20), "{}").otherwise(F.col("body")))


@query("led_01_verify_chain", "SELECT CAST(1 AS BIGINT) AS shard, CAST(n AS BIGINT) AS sequence_num, issue FROM (VALUES (10, 'RAW_HASH_MISMATCH'), (20, 'HASH_MISMATCH'), (31, 'SEQUENCE_GAP_OR_REORDER'), (31, 'BROKEN_CHAIN')) v(n, issue)")
def led_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.verify_chain(_tampered(spark, sf_dir))


@query("led_01_verification", f"SELECT source_id AS shard, count(*) - CAST(source_id = 1 AS BIGINT) AS records, CAST(CASE WHEN source_id = 1 THEN 3 ELSE 0 END AS BIGINT) AS failed, CASE WHEN source_id = 1 THEN CAST(10 AS BIGINT) END AS first_corrupted, source_id <> 1 AS is_valid FROM ({EVENTS}) GROUP BY source_id")
def led_01_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.verification(_tampered(spark, sf_dir))


@query("led_11_checkpoints")
def led_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.checkpoints(integrity.chain(_records(spark, sf_dir)), size=100)


@query("joi_11_covering", f"SELECT shard, CAST(floor((sequence_num - 1) / 100) AS BIGINT) AS idx, count(*) AS n FROM (SELECT source_id AS shard, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS sequence_num FROM ({EVENTS})) GROUP BY 1, 2")
def joi_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = integrity.chain(_records(spark, sf_dir))
    held = integrity.covering(ledger, integrity.checkpoints(ledger, size=100), size=100)
    return held.filter("root IS NOT NULL").groupBy("shard", "idx").agg(F.count("*").alias("n"))


@query("joi_16_witness", "SELECT c_custkey AS idx, CASE c_custkey % 5 WHEN 1 THEN 'differ' WHEN 2 THEN 'pending' WHEN 3 THEN 'missing here' ELSE 'agree' END AS state FROM customer")
def joi_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints are customers: every fifth is known to one side only, or signed with another root."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.sha2("c_name", 256).alias("root"))
    theirs = rows.filter("idx % 5 <> 2").withColumn("root", F.when(F.col("idx") % 5 == 1, F.lit("other")).otherwise(F.col("root")))
    return integrity.witness_compare(rows.filter("idx % 5 <> 3"), theirs)


# Delivery

_DELIVERY = f"""SELECT event_id * 3 + o AS id, output, sequence_num, CASE WHEN (event_id + o) % 9 = 0 THEN 'dead_lettered' WHEN (event_id + o) % 13 = 0 THEN 'filtered' WHEN (event_id + o) % 17 = 0 THEN 'rerouted' ELSE 'delivered' END AS outcome
FROM ({EVENTS}) e CROSS JOIN (SELECT * FROM (VALUES (0, 'siem'), (1, 'lake'), (2, 'siem')) AS v(o, output)) v WHERE (event_id + o) % 5 <> 0 AND (o <> 2 OR event_id % 10 = 1)"""
_OUTPUTS = "SELECT * FROM (VALUES ('siem', 1), ('lake', 101)) AS v(output, first_sequence)"


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.sql("SELECT * FROM (VALUES (0, 'siem'), (1, 'lake'), (2, 'siem')) AS v(o, output)")
    e = events(spark, sf_dir).join(F.broadcast(kinds)).withColumn("m", F.col("event_id") + F.col("o"))
    outcome = F.when(F.col("m") % 9 == 0, "dead_lettered").when(F.col("m") % 13 == 0, "filtered").when(F.col("m") % 17 == 0, "rerouted").otherwise("delivered")
    rows = e.filter("m % 5 <> 0 AND (o <> 2 OR event_id % 10 = 1)")
    return rows.select((F.col("event_id") * 3 + F.col("o")).alias("id"), "output", "sequence_num", outcome.alias("outcome"))


@query("agg_09_latest_outcome", f"SELECT output, outcome, count(*) AS n FROM (SELECT output, sequence_num, arg_max(outcome, id) AS outcome FROM ({_DELIVERY}) GROUP BY 1, 2) GROUP BY 1, 2")
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.latest_outcome(_deliveries(spark, sf_dir))


@query("agg_08_delivered_twice", f"SELECT output, sequence_num, count(*) AS times FROM ({_DELIVERY}) WHERE outcome = 'delivered' GROUP BY 1, 2 HAVING count(*) > 1")
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.delivered_twice(_deliveries(spark, sf_dir))


_OWED = f"SELECT o.output, e.sequence_num FROM ({EVENTS}) e JOIN ({_OUTPUTS}) o ON e.sequence_num >= o.first_sequence WHERE NOT EXISTS (SELECT 1 FROM ({_DELIVERY}) d WHERE d.output = o.output AND d.sequence_num = e.sequence_num)"


@query("joi_07_owed", _OWED)
def joi_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.owed(spark.sql(_OUTPUTS), events(spark, sf_dir), _deliveries(spark, sf_dir))


@query("agg_19_reconcile", f"""WITH l AS (SELECT output, outcome, count(*) AS n FROM (SELECT output, sequence_num, arg_max(outcome, id) AS outcome FROM ({_DELIVERY}) GROUP BY 1, 2) GROUP BY 1, 2),
w AS (SELECT o.output, count(*) AS owed FROM ({EVENTS}) e JOIN ({_OUTPUTS}) o ON e.sequence_num >= o.first_sequence GROUP BY 1), f AS (SELECT output, count(*) AS in_flight FROM ({_OWED}) GROUP BY 1)
SELECT *, owed - delivered - dead_lettered - rerouted - filtered - in_flight AS unaccounted FROM (SELECT w.output, owed, {', '.join(f"CAST(coalesce((SELECT sum(n) FROM l WHERE l.output = w.output AND outcome = '{k}'), 0) AS BIGINT) AS {k}" for k in ('delivered', 'dead_lettered', 'rerouted', 'filtered'))}, coalesce(in_flight, 0) AS in_flight FROM w LEFT JOIN f USING (output))""")
def agg_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.reconcile(spark.sql(_OUTPUTS), events(spark, sf_dir), _deliveries(spark, sf_dir))


_BATCHES = """SELECT conv_id * 100 + turn AS id, CASE WHEN conv_id % 2 = 0 THEN 'siem' ELSE 'lake' END AS output, CASE WHEN turn % 3 = 2 THEN 'dead_lettered' ELSE 'delivered' END AS outcome,
CASE WHEN conv_id % 3 = 0 THEN 'replay' ELSE 'live' END AS trigger, conv_id * 100 + turn AS `at`, turn + 1 AS count, CASE WHEN conv_id % 4 = 0 THEN 'timeout' END AS detail FROM (SELECT DISTINCT conv_id, turn FROM conversations)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_BATCHES.replace("FROM conversations", "FROM {c}"), c=table(spark, sf_dir, "conversations"))


@query("agg_20_episodes", f"""WITH o AS (SELECT *, concat(output, outcome, trigger, coalesce(detail, '')) AS k FROM ({_BATCHES.replace(chr(96), chr(34))}) WHERE NOT (outcome = 'delivered' AND trigger = 'live') AND outcome <> 'filtered'),
m AS (SELECT *, CASE WHEN lag(k) OVER (ORDER BY id) IS NOT DISTINCT FROM k THEN 0 ELSE 1 END AS new FROM o), n AS (SELECT *, sum(new) OVER (ORDER BY id) AS episode FROM m)
SELECT CAST(episode AS BIGINT) AS episode, output, outcome, trigger, coalesce(detail, '') AS detail, min("at") AS since, max("at") AS until, count(*) AS batches, CAST(sum(count) AS BIGINT) AS count FROM n GROUP BY 1, 2, 3, 4, 5""")
def agg_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.episodes(_batches(spark, sf_dir))


# Parsing: lines made of known fields are read back

_FIELDS = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "user_name")
_TRUTH = f"SELECT event_id, src_ip, src_port, dst_ip, dst_port, protocol, user_name FROM ({EVENTS})"


def _back(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.select("event_id", *[(values[f].try_cast("int") if f.endswith("port") else values[f]).alias(f) for f in _FIELDS])


def _at(m: Column, **names: str) -> dict[str, Column]:
    return {f: F.try_element_at(m, F.lit(names.get(f, f))) for f in _FIELDS}


@query("prj_04_kv", _TRUTH)
def prj_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(events(spark, sf_dir))
    pairs = [F.concat(F.lit(f'{f}="'), F.col(f).cast("string"), F.lit('"')) for f in _FIELDS]
    made = e.select("event_id", F.concat_ws(" ", F.lit("src_ip=first"), *pairs).alias("line"))
    return _back(made.withColumn("m", fm.kv(F.col("line"))), _at(F.col("m")))


_CEF_NAMES = {"src_ip": "src", "src_port": "spt", "dst_ip": "dst", "dst_port": "dpt", "protocol": "proto", "user_name": "suser"}


def _as_cef(e: DataFrame) -> DataFrame:
    ext = {_CEF_NAMES[f]: F.col(f).cast("string") for f in _FIELDS} | {"msg": F.concat(F.lit("a=b | c "), "user_name")}
    return e.select("*", fm.to_cef(F.lit("Ac|me"), F.lit("Wall"), F.lit("1"), F.col("class_uid"), F.col("class_name"), F.col("severity_id"), ext).alias("line"))


@query("prj_06_cef", f"SELECT *, 'Ac|me' AS vendor, concat('a=b | c ', user_name) AS msg FROM ({_TRUTH})")
def prj_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _as_cef(spread(events(spark, sf_dir))).select("event_id", fm.cef(F.col("line")).alias("c"))
    values = _at(F.col("c.ext"), **_CEF_NAMES)
    return got.select("event_id", *[(values[f].try_cast("int") if f.endswith("port") else values[f]).alias(f) for f in _FIELDS], F.col("c.vendor").alias("vendor"), F.col("c.ext")["msg"].alias("msg"))


@query("prj_07_leef", _TRUTH)
def prj_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events(spark, sf_dir).select("event_id", fm.to_leef(F.lit("Acme"), F.lit("Wall"), F.lit("1"), F.lit("9"), {f: F.col(f) for f in _FIELDS}).alias("line"))
    return _back(made.withColumn("m", fm.leef(F.col("line"))["ext"]), _at(F.col("m")))


@query("prj_09_json", _TRUTH)
def prj_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = events(spark, sf_dir).select("event_id", F.to_json(F.struct(*_FIELDS)).alias("line"))
    return _back(made.withColumn("m", fm.json_pairs(F.col("line"))), _at(F.col("m")))


@query("prj_01_02_rfc5424", f"SELECT event_id, src_ip, user_name, device_hostname AS hostname, CAST(16 + event_id % 4 AS INT) AS facility, CAST(event_id % 8 AS INT) AS severity, raw_text AS message FROM ({EVENTS})")
def prj_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    pri = (16 + F.col("event_id") % 4) * 8 + F.col("event_id") % 8
    line = fm.to_rfc5424(pri, F.col("time"), F.col("device_hostname"), F.lit("app"), F.col("raw_text"), {"src": F.col("src_ip"), "user": F.concat(F.lit('a"]\\'), "user_name")})
    got = events(spark, sf_dir).select("event_id", fm.envelope(line).alias("e"))
    sd = F.col("e.sd")
    return got.select("event_id", sd["event@32473.src"].alias("src_ip"), F.regexp_replace(sd["event@32473.user"], r'^a"\]\\', "").alias("user_name"), "e.hostname", "e.facility", "e.severity", "e.message")


@query("prj_13_csv", _TRUTH)
def prj_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm.csv_header(",".join(_FIELDS), "10.0.0.1,1,10.0.0.2,2,TCP,bob")
    made = events(spark, sf_dir).select("event_id", F.concat_ws(",", *_FIELDS).alias("line"))
    return _back(made.withColumn("m", fm.csv_pairs(F.col("line"), found[0], found[1])), _at(F.col("m")))


@query("prj_11_xml", f"SELECT event_id, src_ip, user_name FROM ({EVENTS})")
def prj_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("<Event><System><EventID>4624</EventID></System><EventData><Data Name='TargetUserName'>"), "user_name", F.lit("</Data><Data Name='IpAddress'>"), "src_ip", F.lit("</Data></EventData></Event>"))
    m = fm.xml_pairs(F.col("line"))
    return events(spark, sf_dir).select("event_id", line.alias("line")).select("event_id", m["IpAddress"].alias("src_ip"), m["TargetUserName"].alias("user_name"))


@query("prj_11_doctype_refused", "SELECT page_id, CAST(0 AS BIGINT) AS pairs FROM pages WHERE html ILIKE '%<!DOCTYPE%'")
def prj_11_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").filter(F.col("html").ilike("%<!DOCTYPE%"))
    return pages.select("page_id", F.coalesce(F.size(fm.xml_pairs(F.col("html"))), F.lit(0)).cast("long").alias("pairs"))


@query("prj_21_asa", f"SELECT event_id, {READ_IP} AS src_ip, src_port, dst_ip, dst_port, protocol, CAST(5 AS INT) AS activity_id, 'deny' AS action FROM ({EVENTS})")
def prj_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sentrylake.operators import packs

    end = lambda s: F.concat(F.lit(f"{s}:"), f"{s}_ip", F.lit("/"), F.col(f"{s}_port").cast("string"))
    line = F.concat(F.lit("<166>Jan  2 03:04:05 fw1 %ASA-4-106023: Deny "), F.lower("protocol"), F.lit(" src "), end("src"), F.lit(" dst "), end("dst"), F.lit(' by access-group "in" [0x0, 0x0]'))
    got = spread(events(spark, sf_dir)).select("event_id", line.alias("line")).select("event_id", packs.parse_column("line").alias("p"))
    return got.select("event_id", "p.src_ip", "p.src_port", "p.dst_ip", "p.dst_port", "p.protocol", "p.activity_id", "p.action")


@query("prj_14_structure", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'kv' WHEN 2 THEN 'cef' WHEN 3 THEN 'delimited' ELSE 'text' END AS kind FROM ({EVENTS})")
def prj_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _as_cef(events(spark, sf_dir))
    kind = F.col("event_id") % 5
    line = F.when(kind == 0, F.to_json(F.struct("src_ip", "dst_ip"))).when(kind == 1, F.concat_ws(" ", F.concat(F.lit("src="), "src_ip"), F.concat(F.lit("dst="), "dst_ip"))).when(kind == 2, F.col("line"))
    line = line.when(kind == 3, F.concat_ws(",", *_FIELDS)).otherwise(F.lit("link up on port seven"))
    return e.select("event_id", fm.structure(line).alias("kind"))


@query("fun_07_mask", "SELECT doc_id, regexp_replace(text, '[0-9]+', '<N>', 'g') AS masked FROM documents WHERE NOT regexp_matches(text, '[\"''.:@/]|[0-9][a-fA-F]|[a-fA-F][0-9]')")
def fun_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(~F.col("text").rlike(r"[\"'.:@/]|[0-9][a-fA-F]|[a-fA-F][0-9]"))
    return docs.select("doc_id", tx.mask(F.col("text")).alias("masked"))


@query("fun_07_mask_all")
def fun_07_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: fun_07_mask leaves out those that its SQL cannot mask (RE2 has no lookaround), which is nearly all."""
    return table(spark, sf_dir, "documents").select("doc_id", tx.mask(F.col("text")).alias("masked"))


@query("fun_06_fingerprint", f"SELECT class_uid, substr(sha1(concat('kv| |app<N>|', CASE class_uid WHEN 4001 THEN 'src|dst' ELSE 'user|src' END)), 1, 12) AS format_id, count(*) AS lines FROM ({EVENTS}) GROUP BY 1")
def fun_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.when(F.col("class_uid") == 4001, F.array(F.lit("SRC"), F.lit("dst"))).otherwise(F.array(F.lit("User"), F.lit("src")))
    rows = events(spark, sf_dir).select("class_uid", tx.keyed_fingerprint(F.lit("kv"), F.lit(" "), F.concat(F.lit("app"), F.col("event_id").cast("string")), keys).alias("format_id"))
    return rows.groupBy("class_uid", "format_id").agg(F.count("*").alias("lines"))


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sentrylake.operators.registry import summarise

    rows = events(spark, sf_dir).withColumn("format_id", tx.keyed_fingerprint(F.lit("kv"), F.lit(" "), F.lit(""), F.array(F.lower("parser_pack"))))
    return summarise(rows.withColumn("confidence", F.col("severity_id") / 5).withColumn("line", F.col("raw_text")))


@query("agg_14_format_registry", f"SELECT format_id, count(*) AS lines, round(avg(confidence), 2) AS confidence, min(time) AS first_seen, max(time) AS last_seen, count(DISTINCT source_id) AS sources FROM (SELECT *, substr(sha1(concat('kv| ||', parser_pack)), 1, 12) AS format_id, severity_id / 5 AS confidence FROM ({EVENTS})) GROUP BY 1")
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).select("format_id", "lines", "confidence", "first_seen", "last_seen", "sources")


@query("agg_14_format_samples")
def agg_14_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).select("format_id", "samples", "top_sources")


# What is written without a year is of the year of NOW, or the one before where that lies more than two days ahead of it; nothing later is a time.
_LIMIT, _YEAR = NOW + 2 * 86_400_000, datetime.fromtimestamp(NOW / 1000, UTC).year
_IN_YEAR = "epoch_ms(try_strptime(concat('{} ', strftime(make_timestamp(time * 1000), '%b %d %H:%M:%S')), '%Y %b %d %H:%M:%S'))"


@query("fun_10_time", f"""SELECT event_id, CASE WHEN ms BETWEEN 946684800000 AND {_LIMIT} THEN ms END AS time FROM (SELECT event_id, CASE WHEN event_id % 5 <> 2 THEN time
  WHEN {_IN_YEAR.format(_YEAR)} <= {_LIMIT} THEN {_IN_YEAR.format(_YEAR)} ELSE {_IN_YEAR.format(_YEAR - 1)} END AS ms FROM ({EVENTS}))""")
def fun_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_millis("time")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 5 == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 5 == 2, F.date_format(at, "MMM d HH:mm:ss")).when(F.col("event_id") % 5 == 3, F.col("time").cast("string")).otherwise((F.col("time") / 1000).cast("long").cast("string"))
    )
    return events(spark, sf_dir).select("event_id", tx.read_time(text, NOW).alias("time"))


@query("fun_14_severity_action", f"""SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN CASE severity WHEN 'Critical' THEN 5 WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2 ELSE 1 END
  ELSE CASE WHEN event_id % 11 >= 9 THEN 5 WHEN event_id % 11 >= 7 THEN 4 WHEN event_id % 11 >= 5 THEN 3 WHEN event_id % 11 >= 3 THEN 2 ELSE 1 END END AS INT) AS severity_id,
  CASE event_id % 5 WHEN 0 THEN 'denied' WHEN 1 THEN 'dropped' WHEN 2 THEN 'alert' WHEN 3 THEN 'allowed' ELSE lower(user_name) END AS disposition,
  CASE event_id % 5 WHEN 0 THEN 'deny' WHEN 1 THEN 'drop' WHEN 2 THEN 'alert' WHEN 3 THEN 'allow' ELSE lower(user_name) END AS action FROM ({EVENTS})""")
def fun_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("event_id") % 11 / 2).cast("string")
    said = F.when(F.col("event_id") % 3 == 0, F.when(F.col("severity") == "Low", "notice").when(F.col("severity") == "Medium", "WARNING").otherwise(F.col("severity"))).otherwise(number)
    kind = F.col("event_id") % 5
    done = F.when(kind == 0, F.upper("disposition")).when(kind == 1, "Discarded").when(kind == 2, "detected").when(kind == 3, "Accepted").otherwise(F.col("user_name"))
    action = tx.normal_action(done)
    return events(spark, sf_dir).select("event_id", tx.normal_severity(said).cast("int").alias("severity_id"), action["disposition"].alias("disposition"), action["action"].alias("action"))


_CONTRACT = f"""SELECT time, strftime(make_timestamp(time * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS event_time, CAST(NULL AS VARCHAR) AS time_source, class_uid, class_name, CAST(CASE class_uid WHEN 4001 THEN 6 ELSE 1 END AS INT) AS activity_id,
CASE class_uid WHEN 4001 THEN 'Traffic' WHEN 3002 THEN 'Logon' ELSE 'Create' END AS activity_name, severity_id, severity, action, CASE WHEN class_uid <> 3002 THEN upper(disposition[1]) || disposition[2:] END AS disposition_word,
CAST(CASE status WHEN 'success' THEN 1 ELSE 2 END AS INT) AS status_id, CAST(CASE WHEN class_uid IN (4001, 2004) THEN CASE action WHEN 'allow' THEN 1 ELSE 2 END END AS INT) AS action_id,
CAST(CASE WHEN class_uid IN (4001, 2004) THEN CASE disposition WHEN 'allowed' THEN 1 WHEN 'denied' THEN 2 ELSE 6 END END AS INT) AS disposition_id, src_ip, src_port, CAST(NULL AS VARCHAR) AS src_hostname, dst_ip, dst_port,
CAST(NULL AS VARCHAR) AS dst_hostname, lower(protocol) AS protocol, CAST(CASE protocol WHEN 'TCP' THEN 6 ELSE 17 END AS INT) AS protocol_num, CAST(NULL AS INT) AS direction_id, CAST(NULL AS BIGINT) AS bytes_in, bytes_out,
CAST(NULL AS BIGINT) AS packets, user_name, CAST(NULL AS VARCHAR) AS finding_title, CAST(NULL AS VARCHAR) AS finding_uid, CASE parser_pack WHEN 'cisco_asa' THEN 'Cisco' END AS vendor, CASE parser_pack WHEN 'cisco_asa' THEN 'ASA' END AS product,
device_hostname, CAST(NULL AS VARCHAR) AS sender_ip, parser_pack AS parser, parser_pack <> 'parse_error' AS fields_verified, sequence_num, CAST(event_id AS STRING) AS event_uid, CAST(NULL AS VARCHAR) AS raw_id, sha256(raw_text) AS raw_sha256
FROM ({EVENTS})"""
_CONTRACT = f"SELECT * EXCLUDE (disposition_word), CASE disposition_word WHEN 'Denied' THEN 'Blocked' ELSE disposition_word END AS disposition FROM ({_CONTRACT})"


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocsf.export(events(spark, sf_dir).withColumn("bytes_in", F.lit(None).cast("long")))


@query("prj_36_contract", _CONTRACT)
def prj_36(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocsf.contract(_exported(spark, sf_dir)).drop("ocsf")  # JSON text differs between engines; tests read it


@query("flt_12_violations", f"SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'type_uid,severity_id' ELSE '' END AS violations FROM ({EVENTS})")
def flt_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.col("event_id") % 10 == 0
    rows = _exported(spark, sf_dir).withColumn("type_uid", F.when(broken, F.lit(1)).otherwise(F.col("type_uid"))).withColumn("severity_id", F.when(broken, F.lit(9)).otherwise(F.col("severity_id")))
    return ocsf.violations(rows).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("prj_33_normalise", f"SELECT event_id, class_uid, {READ_IP} AS src_ip, CASE WHEN {READ_IP} IS NOT NULL THEN src_port END AS src_port, dst_ip, dst_port, protocol, disposition, user_name, CASE WHEN time <= {_LIMIT} THEN time ELSE {NOW} END AS time FROM ({EVENTS})")
def prj_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(events(spark, sf_dir))
    act = F.when(F.col("disposition") == "dropped", "drop").when(F.col("disposition") == "denied", "deny").otherwise("accept")
    # an authentication says what it is about, and a finding has a signature
    kind = {"op": F.when(F.col("class_uid") == 3002, "login"), "signature": F.when(F.col("class_uid") == 2004, "scan")}
    pairs = F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in kind.items()], *[F.concat(F.lit(f"{k}="), c.cast("string")) for k, c in {"SRC": F.col("src_ip"), "spt": F.col("src_port"), "dst": F.col("dst_ip"), "dpt": F.col("dst_port"), "proto": F.col("protocol"), "act": act, "user": F.col("user_name"), "rt": F.col("time")}.items()])
    rows = e.select("event_id", "sequence_num", pairs.alias("raw_text"), F.lit(NOW).alias("received_at_ms"))
    rows = rows.withColumn("m", fm.kv(F.col("raw_text"))).withColumn("p", ocsf.canonical(F.col("m"), F.col("raw_text")))
    return ocsf.normalise(rows, NOW).select("event_id", "class_uid", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "disposition", "user_name", "time")
