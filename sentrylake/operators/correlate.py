"""Cross-source correlation by time and shared address over the newest events.

The scope is bounded (the newest NEWEST current events), numbered by time and sequence: ``pos`` decides what is later, so
ties in time keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import current, up_to_newest

NEWEST, LOGIN_MS, ALERT_MS, SWEEP_MS, SWEEP_PORTS = 200, 1_800_000, 600_000, 60_000, 10
# Words for a permitted action, and severities from least to most.
ALLOWED = ("allow", "allowed", "accept", "accepted", "permit", "permitted", "pass", "success")
SEVERITIES = ("Unknown", "Informational", "Low", "Medium", "High", "Critical", "Fatal")


def addresses() -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.array("src_ip", "dst_ip"), lambda a: a.isNotNull() & (a != ""))))


def allowed() -> Column:
    return F.lower(F.coalesce("disposition", "action", F.lit(""))).isin(*ALLOWED)


def login_succeeded() -> Column:
    status = F.lower(F.coalesce("status", F.lit("")))
    return F.when(status != "", status == "success").otherwise(allowed())


def scope(events: DataFrame, pivot_ip: str | None = None, minutes: int = 60) -> DataFrame:
    rows = current(events)
    if pivot_ip is not None:
        rows = rows.filter((F.col("src_ip") == pivot_ip) | (F.col("dst_ip") == pivot_ip))
    top = up_to_newest(rows, minutes).orderBy(F.col("time").desc(), F.col("sequence_num").desc()).limit(NEWEST)
    pos = F.row_number().over(Window.orderBy("time", "sequence_num"))
    return top.withColumn("pos", pos).withColumn("addresses", addresses())


def login_then_activity(rows: DataFrame) -> DataFrame:
    """Per successful login that is followed: the first later event of another source with a shared address, and all of them."""
    a = rows.filter((F.col("class_uid") == 3002) & login_succeeded()).alias("a")
    b = rows.filter(F.col("class_uid").isin(4001, 2004)).alias("b")
    gap = F.col("b.time") - F.col("a.time")
    pairs = a.join(b, (F.col("b.pos") > F.col("a.pos")) & (F.col("a.source_id") != F.col("b.source_id")) & gap.between(0, LOGIN_MS) & F.arrays_overlap("a.addresses", "b.addresses"))
    first = F.min(F.struct(F.col("b.pos").alias("pos"), gap.alias("gap"), F.array_join(F.array_intersect("a.addresses", "b.addresses"), ",").alias("shared"), F.col("b.event_id").alias("id")))
    got = pairs.groupBy(F.col("a.event_id").alias("login_id")).agg(first.alias("f"), F.count("*").alias("matches"))
    return got.select("login_id", F.col("f.id").alias("first_id"), F.col("f.gap").alias("gap_ms"), F.col("f.shared").alias("shared"), "matches")


def allowed_then_alert(rows: DataFrame) -> DataFrame:
    """Per alert: the last earlier allowed connection of another source between the same two addresses, within the time."""
    a = rows.filter((F.col("class_uid") == 4001) & allowed()).alias("a")
    b = rows.filter((F.col("class_uid") == 2004) & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()).alias("b")
    gap = F.col("b.time") - F.col("a.time")
    pairs = a.join(b, (F.col("a.addresses") == F.col("b.addresses")) & (F.col("a.source_id") != F.col("b.source_id")) & (F.col("a.pos") < F.col("b.pos")) & gap.between(0, ALERT_MS))
    last = F.max(F.struct(F.col("a.pos").alias("pos"), F.col("a.event_id").alias("id"), gap.alias("gap")))
    got = pairs.groupBy(F.col("b.event_id").alias("alert_id")).agg(last.alias("l"))
    return got.select("alert_id", F.col("l.id").alias("allowed_id"), F.col("l.gap").alias("gap_ms"))


def port_sweeps(rows: DataFrame, span_ms: int = SWEEP_MS, least: int = SWEEP_PORTS) -> DataFrame:
    """Per source address: the first moment at which the events of the last minute show enough ports.

    A port counts from a row until no row of it is in the last minute. Only the starts and ends of such spans change the number of ports, so
    the running number is made over them: their number does not grow with how often a port is seen.
    """
    seen = rows.filter(F.col("src_ip").isNotNull() & F.col("dst_port").isNotNull()).select("src_ip", "dst_port", "time", "pos", "event_id")
    of_port = Window.partitionBy("src_ip", "dst_port").orderBy("time", "pos")
    seen = seen.withColumn("_since", F.col("time") - F.lag("time").over(of_port)).withColumn("_until", F.lead("time").over(of_port) - F.col("time"))
    alone = lambda gap: F.col(gap).isNull() | (F.col(gap) > span_ms)
    starts = seen.filter(alone("_since")).select("src_ip", "time", "pos", "event_id", F.lit(1).alias("step"))
    # an end is before all rows of the millisecond after the span
    ends = seen.filter(alone("_until")).select("src_ip", (F.col("time") + span_ms + 1).alias("time"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast(dict(rows.dtypes)["event_id"]).alias("event_id"), F.lit(-1).alias("step"))
    order = Window.partitionBy("src_ip").orderBy("time", "step", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = starts.unionByName(ends).withColumn("ports", F.sum("step").over(order))
    hits = steps.filter((F.col("step") == 1) & (F.col("ports") >= least))
    got = hits.groupBy("src_ip").agg(F.min(F.struct("pos", "event_id", "ports")).alias("f"))
    return got.select("src_ip", F.col("f.event_id").alias("event_id"), F.col("f.ports").alias("ports"))


# What a reader of an incident is told to do, by the kind of what was found; {} is what the events share.
ADVICE = {
    "login": "Confirm with the account owner that the session behind {} was theirs; revoke it if not.",
    "alert": "Pull the sensor's payload for the alert between {} and review the rule that allowed the connection.",
    "sweep": "Check whether {} is a known scanner; block it at the perimeter if not.",
}
LAST_ADVICE = "Verify the integrity chain before these events are used as evidence."


def recommendations(logins: DataFrame, alerts: DataFrame, sweeps: DataFrame) -> DataFrame:
    """(pos, text): advice on logins (login_id, shared), alerts (alert_id, shared) and sweeps (src_ip, event_id), in this order and by event within
    each, every text once, and the last one always. ``shared`` are addresses joined by commas. A scope bounds what is found."""

    def of(rows: DataFrame, rank: int, kind: str, at: str, shared: str, between: str) -> DataFrame:
        said = F.replace(F.lit(ADVICE[kind]), F.lit("{}"), F.replace(F.col(shared), F.lit(","), F.lit(between)))
        return rows.select(F.lit(rank).alias("rank"), F.col(at).alias("at"), said.alias("text"))

    said = of(logins, 0, "login", "login_id", "shared", ", ").unionByName(of(alerts, 1, "alert", "alert_id", "shared", " and ")).unionByName(of(sweeps, 2, "sweep", "event_id", "src_ip", ","))
    once = said.groupBy("text").agg(F.min(F.struct("rank", "at")).alias("first"))
    found = once.select("text", F.row_number().over(Window.orderBy("first")).cast("long").alias("pos"))
    last = found.agg((F.count("*") + 1).alias("pos")).select(F.lit(LAST_ADVICE).alias("text"), "pos")
    return found.unionByName(last).select("pos", "text")


def summary(rows: DataFrame) -> DataFrame:
    """One row: number of events, greatest severity, first and last time, and the sorted names involved."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0).cast("long")), F.lit(1))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    ips = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("addresses")))), ",")
    return rows.agg(
        F.count("*").alias("events"), F.max_by("severity", rank).alias("severity"), F.min("time").alias("start_time"), F.max("time").alias("end_time"),
        ips.alias("ips"), joined("user_name").alias("users"), joined("device_hostname").alias("devices"),
    )


def scope_sql(events: str) -> str:
    return f"""s AS (SELECT *, row_number() OVER (ORDER BY time, sequence_num) AS pos,
  list_sort(list_distinct([src_ip, dst_ip])) AS addresses
  FROM (SELECT * FROM ({events}) WHERE superseded_by IS NULL AND time >= (SELECT max(time) - 3600000 FROM ({events}) WHERE superseded_by IS NULL) ORDER BY time DESC, sequence_num DESC LIMIT 200))"""
