"""Window features per address, user and device: one shuffle by entity and window.

Null means that the device did not say: sums and shares of nothing stay null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_MS = 300_000
ENTITIES = ("src_ip", "user", "device")


def entity(kind: str) -> Column:
    return {"src_ip": F.col("src_ip"), "user": F.col("user_name"), "device": F.coalesce("device_hostname", "sender_ip")}[kind]


def window_start(time: Column, width: int = WINDOW_MS) -> Column:
    return (F.floor(time / width) * width).cast("long")


def denied() -> Column:
    return F.coalesce(F.col("disposition_id").isin(2, 6), F.lit(False)) | F.coalesce(F.col("action_id") == 2, F.lit(False))


def window_features(events: DataFrame, kind: str = "src_ip", width: int = WINDOW_MS) -> DataFrame:
    """One row per (entity, window). Destinations are summed per window first, so that a window's distinct counts and the
    first window of each (entity, destination) come from one pre-aggregate."""
    rows = events.select("*", entity(kind).alias("entity"), window_start(F.col("time"), width).alias("window_start_ms")).filter("entity IS NOT NULL")
    auth = F.col("class_uid") == 3002
    keys = ["entity", "window_start_ms"]
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.count_if(denied()).alias("denied"),
        F.count_if(auth & (F.col("status_id") == 2)).alias("auth_failures"),
        F.count_if(auth & (F.col("status_id") == 1)).alias("auth_successes"),
        F.count_if(F.col("class_uid") == 2004).alias("findings"),
        F.count_if(~F.coalesce("fields_verified", F.lit(False))).alias("unverified"),
        F.count_if(F.col("time_source") == "received").alias("received"),
        F.sum("bytes_in").cast("long").alias("bytes_in"),
        F.sum("bytes_out").cast("long").alias("bytes_out"),
        F.min("sequence_num").alias("first_sequence"),
        F.max("sequence_num").alias("last_sequence"),
        F.count_distinct("src_ip").alias("distinct_src_ips"),
    )
    pairs = rows.groupBy(*keys, F.coalesce("dst_ip", "dst_hostname").alias("dst"), "dst_port").agg(F.lit(1).alias("one"))
    distinct = pairs.groupBy(*keys).agg(F.count_distinct("dst").alias("distinct_dst_ips"), F.count_distinct("dst_port").alias("distinct_dst_ports"))
    first_seen = pairs.filter("dst IS NOT NULL").groupBy("entity", "dst").agg(F.min("window_start_ms").alias("window_start_ms"))
    new = first_seen.groupBy(*keys).agg(F.count("*").alias("new_dst_ips"))
    out = base.join(distinct, keys, "left").join(new, keys, "left")
    order = Window.partitionBy("entity").orderBy("window_start_ms")
    at = F.timestamp_millis("window_start_ms")
    new_count = F.coalesce("new_dst_ips", F.lit(0)).cast("long")
    return out.select(
        F.lit(kind).alias("entity_type"), "entity", "window_start_ms", "events", "denied", "auth_failures", "auth_successes", "findings", "unverified", "received",
        "bytes_in", "bytes_out", "first_sequence", "last_sequence", "distinct_src_ips", "distinct_dst_ips", "distinct_dst_ports",
        new_count.alias("new_dst_ips"),
        (F.col("denied") / F.col("events")).alias("deny_ratio"),
        F.when(F.col("distinct_dst_ips") > 0, new_count / F.col("distinct_dst_ips")).alias("new_dst_share"),
        F.hour(at).cast("long").alias("hour_of_day"), F.weekday(at).cast("long").alias("day_of_week"),
        (F.row_number().over(order) - 1).cast("long").alias("history_windows"),
    )


def all_features(events: DataFrame, kinds: tuple[str, ...] = ENTITIES, width: int = WINDOW_MS) -> DataFrame:
    out = window_features(events, kinds[0], width)
    for k in kinds[1:]:
        out = out.unionByName(window_features(events, k, width))
    return out


def features_sql(flows: str, entity_sql: str, kind: str) -> str:
    return f"""
WITH e AS (SELECT *, {entity_sql} AS entity, CAST(floor(time / 300000) AS BIGINT) * 300000 AS window_start_ms, coalesce(dst_ip, dst_hostname) AS dst FROM ({flows}) WHERE {entity_sql} IS NOT NULL),
f AS (SELECT entity, window_start_ms, count(*) AS n FROM (SELECT entity, dst, min(window_start_ms) AS window_start_ms FROM e WHERE dst IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2),
w AS (SELECT entity, window_start_ms, count(*) AS events,
  count(*) FILTER (WHERE coalesce(disposition_id IN (2, 6), false) OR coalesce(action_id = 2, false)) AS denied,
  count(*) FILTER (WHERE class_uid = 3002 AND status_id = 2) AS auth_failures, count(*) FILTER (WHERE class_uid = 3002 AND status_id = 1) AS auth_successes,
  count(*) FILTER (WHERE class_uid = 2004) AS findings, count(*) FILTER (WHERE NOT coalesce(fields_verified, false)) AS unverified,
  count(*) FILTER (WHERE time_source = 'received') AS received, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out,
  min(sequence_num) AS first_sequence, max(sequence_num) AS last_sequence, count(DISTINCT src_ip) AS distinct_src_ips, count(DISTINCT dst) AS distinct_dst_ips, count(DISTINCT dst_port) AS distinct_dst_ports
  FROM e GROUP BY 1, 2)
SELECT '{kind}' AS entity_type, w.*, CAST(coalesce(n, 0) AS BIGINT) AS new_dst_ips, denied / events AS deny_ratio,
  CASE WHEN distinct_dst_ips > 0 THEN coalesce(n, 0) / distinct_dst_ips END AS new_dst_share,
  CAST(hour(make_timestamp(window_start_ms * 1000)) AS BIGINT) AS hour_of_day, CAST(isodow(make_timestamp(window_start_ms * 1000)) - 1 AS BIGINT) AS day_of_week,
  row_number() OVER (PARTITION BY entity ORDER BY window_start_ms) - 1 AS history_windows
FROM w LEFT JOIN f USING (entity, window_start_ms)
"""


# Contract columns that features read as numbers.
NUMBERS = ("time", "class_uid", "status_id", "action_id", "disposition_id", "dst_port", "severity_id", "bytes_in", "bytes_out", "sequence_num")
TEXTS = ("time_source", "src_ip", "dst_ip", "dst_hostname", "user_name", "device_hostname", "sender_ip")


def coerce(rows: DataFrame) -> DataFrame:
    """The columns that features read, whatever ``rows`` holds: missing ones are null, numbers that do not read as such too, fields count
    as unverified unless it says otherwise, and a device without a name is the address that it sent from."""
    has = set(rows.columns)
    col = lambda c, t: (F.col(c).try_cast(t) if c in has else F.lit(None).cast(t)).alias(c)
    verified = F.coalesce(F.col("fields_verified").try_cast("boolean"), F.lit(False)) if "fields_verified" in has else F.lit(False)
    out = rows.select(*[col(c, "long") for c in NUMBERS], *[col(c, "string") for c in TEXTS], verified.alias("fields_verified"))
    return out.withColumn("device", F.coalesce("device_hostname", "sender_ip"))
