"""Security-event tables derived from the star schema by arithmetic, for queries and their SQL.

``EVENTS`` (from events) is sparse with unique ids; ``FLOWS`` (from lineitem) is dense enough for windows. Both texts are SQL
that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

T0 = 1767225600000

EVENTS = f"""
SELECT event_id, event_id + 1 AS sequence_num, CAST({T0} + event_id * 1000 AS BIGINT) AS time,
  CAST(CASE event_type WHEN 'error' THEN 2004 WHEN 'signup' THEN 3002 ELSE 4001 END AS INT) AS class_uid,
  CASE event_type WHEN 'error' THEN 'Detection Finding' WHEN 'signup' THEN 'Authentication' ELSE 'Network Activity' END AS class_name,
  CASE event_type WHEN 'error' THEN 'Findings' WHEN 'signup' THEN 'Identity & Access Management' ELSE 'Network Activity' END AS category_name,
  CAST(1 + event_id % 5 AS INT) AS severity_id,
  CASE event_id % 5 WHEN 0 THEN 'Informational' WHEN 1 THEN 'Low' WHEN 2 THEN 'Medium' WHEN 3 THEN 'High' ELSE 'Critical' END AS severity,
  concat('10.0.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS STRING), '.', CAST(user_id % 256 AS STRING)) AS src_ip,
  CAST(1024 + event_id % 5000 AS INT) AS src_port,
  concat('198.51.100.', CAST(event_id % 23 AS STRING)) AS dst_ip, CAST(440 + event_id % 17 AS INT) AS dst_port,
  CASE WHEN event_id % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
  CAST(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS INT) AS status_id,
  CASE WHEN event_id % 3 = 0 THEN 'success' ELSE 'failure' END AS status,
  CAST(CASE event_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 1 END AS INT) AS disposition_id,
  CASE event_id % 5 WHEN 0 THEN 'denied' WHEN 1 THEN 'dropped' ELSE 'allowed' END AS disposition,
  CASE WHEN event_id % 5 IN (0, 1) THEN 'deny' ELSE 'allow' END AS action,
  event_id % 4 AS source_id,
  CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value * 1000) AS BIGINT) END AS bytes_out,
  concat('user', CAST(user_id AS STRING)) AS user_name, concat('fw', CAST(event_id % 4 AS STRING)) AS device_hostname,
  CASE WHEN event_id % 11 = 0 THEN concat('rev-', CAST(event_id AS STRING)) END AS superseded_by,
  CASE event_id % 7 WHEN 0 THEN 'generic_kv' WHEN 1 THEN 'learned:0a1b2c3d' WHEN 2 THEN 'parse_error' WHEN 3 THEN 'baseline' ELSE 'cisco_asa' END AS parser_pack,
  concat(event_type, ' by user', CAST(user_id AS STRING), ' from 10.0.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS STRING), '.', CAST(user_id % 256 AS STRING), ' seq=', CAST(event_id + 1 AS STRING)) AS raw_text
FROM events
"""

#: The source address of an event where it is one, for SQL that says what a reader of lines finds: users from 65536 on get a number beyond 255 in it,
#: which is no address, so that readers leave it out.
READ_IP = "CASE WHEN CAST(split_part(src_ip, '.', 3) AS BIGINT) <= 255 THEN src_ip END"

FLOWS = f"""
SELECT CASE WHEN l_orderkey % 50 = 0 THEN '203.0.113.66' ELSE concat('10.0.0.', CAST(l_suppkey % 10 AS STRING)) END AS src_ip,
  CAST({T0} + 1000 * CASE WHEN l_orderkey % 50 = 0 THEN 72000 + l_orderkey % 240 ELSE (l_orderkey * 7919 + l_linenumber * 104729) % 86400 END AS BIGINT) AS time,
  concat('198.51.100.', CAST(l_partkey % 200 AS STRING)) AS dst_ip, CAST(NULL AS STRING) AS dst_hostname,
  CAST(CASE WHEN l_orderkey % 50 = 0 THEN 1000 + CAST(floor(l_orderkey / 50) AS BIGINT) % 200 ELSE 440 + l_linenumber END AS INT) AS dst_port,
  CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END AS bytes_out, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey * 2 END AS bytes_in,
  CAST(CASE l_partkey % 9 WHEN 0 THEN 3002 WHEN 1 THEN 2004 ELSE 4001 END AS INT) AS class_uid,
  CAST(1 + l_partkey % 2 AS INT) AS status_id, CAST(CASE l_partkey % 6 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 1 END AS INT) AS disposition_id,
  CAST(CASE WHEN l_partkey % 10 = 0 THEN 2 END AS INT) AS action_id,
  concat('user', CAST(l_suppkey % 7 AS STRING)) AS user_name,
  CASE WHEN l_suppkey % 3 <> 0 THEN concat('fw', CAST(l_suppkey % 3 AS STRING)) END AS device_hostname, '192.0.2.1' AS sender_ip,
  l_partkey % 8 <> 0 AS fields_verified, CASE WHEN l_partkey % 5 = 0 THEN 'received' ELSE 'device' END AS time_source,
  l_orderkey * 8 + l_linenumber AS sequence_num
FROM lineitem
"""

SOURCES = "SELECT * FROM (VALUES (0, 'edge'), (1, 'core'), (2, 'vpn'), (3, 'ids'), (4, 'spare')) AS s(source_id, source_name)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _derived(spark: SparkSession, sf_dir: str, base: str, sql: str) -> DataFrame:
    head, tail = sql.rsplit(f"FROM {base}", 1)
    return spark.sql(f"{head} FROM {{{base}}} {tail}", **{base: table(spark, sf_dir, base)})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "events", EVENTS)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, "lineitem", FLOWS)


def sources(spark: SparkSession) -> DataFrame:
    return spark.sql(SOURCES)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of files with fewer splits than cores, dealt to all cores: parsing a line costs far more than moving it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
