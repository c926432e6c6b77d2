"""Robust-statistics detector over window features.

A window's value is compared with the entity's own windows of the last 24 h (OWN of them at least) or else with all
entities' (PEERS at least). Only values that reach the smallest increase worth flagging are looked at, so histories are
joined for few windows; a history is cut into day-wide buckets, which makes the time range an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, OWN, PEERS, LOOKBACK_MS = 3.5, 8, 30, 86_400_000

# The smallest increase over the median worth flagging.
MIN_EXCESS = {
    "src_ip": {"events": 100, "denied": 20, "distinct_dst_ips": 20, "distinct_dst_ports": 15, "bytes_out": 50_000_000, "auth_failures": 5, "findings": 5},
    "user": {"auth_failures": 5, "distinct_src_ips": 5},
    "device": {"events": 1000, "denied": 100, "findings": 20},
}
# How features are named in a flag's title, first match first.
TITLES = {
    "distinct_dst_ports": "number of destination ports", "distinct_dst_ips": "number of destinations", "bytes_out": "data sent",
    "auth_failures": "failed logins", "distinct_src_ips": "number of source addresses", "denied": "denied connections",
    "findings": "IDS/IPS alerts", "events": "event volume",
}
# What a reason's value counts.
NOUNS = {
    "events": "events", "denied": "denied connections", "distinct_dst_ips": "destination addresses", "distinct_dst_ports": "destination ports",
    "distinct_src_ips": "source addresses", "bytes_out": "sent", "auth_failures": "failed logins", "findings": "IDS/IPS alerts",
}
SUBJECTS = {"src_ip": "from", "user": "for user", "device": "at device"}


def _long(features: DataFrame, names: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return features.select("entity", "window_start_ms", F.inline(pairs))


def _history(asked: DataFrame, values: DataFrame, by_entity: bool) -> DataFrame:
    """asked (entity?, t, feature) with n, median, highest, spread and its source, over reported values in [t - 24 h, t).

    Of all entities' values each window keeps how often each one was reported, so a history is as long as its different
    values however many entities there are.
    """
    keys = (["entity"] if by_entity else []) + ["t", "feature"]
    day = F.floor(F.col("t") / LOOKBACK_MS)
    wanted = asked.select(*keys).distinct().withColumn("b", F.explode(F.array(day - 1, day)))
    past = values.filter("value IS NOT NULL").withColumn("b", F.floor(F.col("window_start_ms") / LOOKBACK_MS))
    on = (["entity"] if by_entity else []) + ["feature", "b"]
    past = past.groupBy(*on, "window_start_ms", "value").agg(F.count("*").alias("k"))
    joined = wanted.join(past, on)
    joined = joined.filter((F.col("window_start_ms") < F.col("t")) & (F.col("window_start_ms") >= F.col("t") - LOOKBACK_MS))
    middle = joined.groupBy(*keys).agg(F.sum("k").alias("n"), F.percentile("value", F.lit(0.5), F.col("k")).alias("median"), F.max("value").alias("highest"))
    apart = F.abs(F.col("value") - F.col("median"))
    wide = joined.join(middle, keys).groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("median").alias("median"), F.first("highest").alias("highest"),
        (1.4826 * F.percentile(apart, F.lit(0.5), F.col("k"))).alias("mad"), (1.2533 * (F.sum(apart * F.col("k")) / F.sum("k"))).alias("mean"),
    )
    spread = F.when(F.col("mad") != 0, F.col("mad")).otherwise(F.col("mean"))
    source = F.when(F.col("mad") != 0, "mad").when(F.col("mean") != 0, "mean absolute deviation").otherwise("none")
    return wide.select(*keys, "n", "median", "highest", spread.alias("spread"), source.alias("spread_from"))


def scored_windows(features: DataFrame) -> DataFrame:
    """features with ``own`` and ``peers``, the windows before each one in 24 h, and ``baseline`` (null: not scored)."""
    ordered = Window.partitionBy("entity").orderBy("window_start_ms").rangeBetween(-LOOKBACK_MS, -1)
    own = features.withColumn("own", F.count("*").over(ordered))
    at = features.groupBy("window_start_ms").agg(F.count("*").alias("c")).withColumn("b", F.floor(F.col("window_start_ms") / LOOKBACK_MS))
    day = F.floor(F.col("t") / LOOKBACK_MS)
    ask = at.select(F.col("window_start_ms").alias("t")).withColumn("b", F.explode(F.array(day - 1, day)))
    before = ask.join(at, "b").filter((F.col("window_start_ms") < F.col("t")) & (F.col("window_start_ms") >= F.col("t") - LOOKBACK_MS))
    peers = before.groupBy("t").agg(F.sum("c").alias("peers"))
    out = own.join(peers.withColumnRenamed("t", "window_start_ms"), "window_start_ms", "left")
    baseline = F.when(F.col("own") >= OWN, "own history").when(F.coalesce("peers", F.lit(0)) >= PEERS, "peers")
    return out.withColumn("peers", F.coalesce("peers", F.lit(0))).withColumn("baseline", baseline)


def reasons(features: DataFrame, kind: str, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """One row per (entity, window, feature) that stands out, with its history and z."""
    limits = MIN_EXCESS[kind]
    windows = scored_windows(features).filter("baseline IS NOT NULL").select("entity", "window_start_ms", "baseline")
    if since_ms is not None:
        windows = windows.filter(F.col("window_start_ms") >= since_ms)
    if until_ms is not None:
        windows = windows.filter(F.col("window_start_ms") < until_ms)
    values = _long(features, list(limits))
    least = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, float(v))])[F.col("feature")]
    wanted = values.withColumn("min_excess", least).filter(F.col("value") >= F.col("min_excess")).join(windows, ["entity", "window_start_ms"])
    wanted = wanted.withColumnRenamed("window_start_ms", "t")
    own = wanted.filter("baseline = 'own history'")
    peers = wanted.filter("baseline = 'peers'")
    both = own.join(_history(own, values, True), ["entity", "t", "feature"]).filter(F.col("n") >= OWN).unionByName(
        peers.join(_history(peers, values, False), ["t", "feature"]).filter(F.col("n") >= PEERS)
    )
    z = F.when(F.col("spread") != 0, (F.col("value") - F.col("median")) / F.col("spread"))
    out = both.withColumn("z", z).filter((F.col("value") - F.col("median") >= F.col("min_excess")) & (F.col("z").isNull() | (F.col("z") >= THRESHOLD)))
    return out.select(F.lit(kind).alias("entity_type"), "entity", F.col("t").alias("window_start_ms"), "feature", "value", "median", "highest", "spread", "spread_from", "z", F.col("n").alias("history"), "baseline", "min_excess")


def finding_uid(kind: Column, entity: Column, start: Column) -> Column:
    return F.concat(F.lit("baseline-"), F.substring(F.sha2(F.concat_ws("|", F.lit("baseline"), kind, entity, start.cast("string")), 256), 1, 16))


def amount(value: Column, feature: Column) -> Column:
    """A value as flags print it: bytes in decimal units, counts as whole numbers."""
    def unit(size: float, name: str) -> Column:
        return F.concat(F.format_string("%.1f", value / size), F.lit(f" {name}"))

    size = F.when(value >= 1e9, unit(1e9, "GB")).when(value >= 1e6, unit(1e6, "MB")).when(value >= 1e3, unit(1e3, "kB")).otherwise(F.format_string("%.0f B", value))
    plain = F.when(value == F.floor(value), value.cast("long").cast("string")).otherwise(value.cast("string"))
    return F.when(feature == "bytes_out", size).otherwise(plain)


def flags(found: DataFrame) -> DataFrame:
    """One row per flagged window: id, title (features in their fixed order) and the reasons' number."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(TITLES) for x in (k, i)])[F.col("feature")]
    title = F.create_map(*[F.lit(x) for k, v in TITLES.items() for x in (k, v)])
    subject = F.create_map(*[F.lit(x) for k, v in SUBJECTS.items() for x in (k, v)])
    rows = found.groupBy("entity_type", "entity", "window_start_ms").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "feature"))).alias("r"))
    names = F.array_join(F.transform("r", lambda x: title[x["feature"]]), " and ")
    return rows.select(
        "entity_type", "entity", "window_start_ms", F.size("r").cast("long").alias("reasons"),
        finding_uid(F.col("entity_type"), F.col("entity"), F.col("window_start_ms")).alias("finding_uid"),
        F.concat(F.lit("Unusual "), names, F.lit(" "), subject[F.col("entity_type")], F.lit(" "), F.col("entity")).alias("title"),
    )


def reason_text(minutes: int = 5) -> Column:
    """A reason as a sentence: its value, the history that it is compared with, and z where the spread is the usual one."""
    noun = F.create_map(*[F.lit(x) for k, v in NOUNS.items() for x in (k, v)])[F.col("feature")]
    shown = lambda c: amount(F.col(c), F.col("feature"))
    whose = F.when(F.col("baseline") == "own history", "its").otherwise("all peers'")
    z = F.when(F.col("spread_from") == "mad", F.format_string(", robust z %.1f", "z")).otherwise("")
    return F.concat(
        shown("value"), F.lit(" "), noun, F.lit(f" in {minutes} min; "), whose, F.lit(" "), F.col("history").cast("string"),
        F.lit(" earlier windows: median "), shown("median"), F.lit(", highest "), shown("highest"), z,
    )


def flag_lines(found: DataFrame, minutes: int = 5) -> DataFrame:
    """(finding_uid, line): each flag as one line of JSON, its keys sorted and numbers to three decimals, so that a flag is always the
    same bytes. Reasons are in the order of titles."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(TITLES) for x in (k, i)])[F.col("feature")]
    number = lambda c: F.round(F.col(c), 3).alias(c)
    reason = F.struct(
        "baseline", "feature", number("highest"), "history", number("median"), number("min_excess"), number("z"), number("spread"), "spread_from", number("value"),
    )
    rows = found.groupBy("entity_type", "entity", "window_start_ms").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), reason_text(minutes).alias("t"), reason.alias("r")))).alias("x")
    )
    iso = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start, end = F.col("window_start_ms"), F.col("window_start_ms") + minutes * 60_000
    rows = rows.join(flags(found).select("entity_type", "entity", "window_start_ms", "finding_uid", "title"), ["entity_type", "entity", "window_start_ms"])
    line = F.to_json(F.struct(
        F.lit("baseline").alias("detector"), "entity", "entity_type", "finding_uid", F.transform("x", lambda e: e["r"]).alias("reasons"), F.lit("medium").alias("severity"),
        F.array_join(F.transform("x", lambda e: e["t"]), "; ").alias("summary"), F.lit(THRESHOLD).alias("threshold"), iso(end).alias("time"), "title",
        F.lit(1).alias("version"), iso(end).alias("window_end"), iso(start).alias("window_start"),
    ), {"ignoreNullFields": "false"})
    return rows.select("finding_uid", line.alias("line"))


def read_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """Findings from the detector's own lines; others are left out. The entity is the source address or the user that it names."""
    shape = "detector string, version int, entity_type string, entity string, finding_uid string, title string, summary string, severity string, time timestamp"
    rows = lines.withColumn("j", F.from_json(text, shape)).filter("j.detector = 'baseline' AND j.version = 1")
    entity = lambda kind: F.when(F.col("j.entity_type") == kind, F.col("j.entity"))
    return rows.select(
        F.lit(2004).alias("class_uid"), F.unix_millis("j.time").alias("time"), F.col("j.finding_uid").alias("finding_uid"), F.col("j.title").alias("finding_title"),
        F.col("j.summary").alias("message"), F.col("j.severity").alias("severity"), entity("src_ip").alias("src_ip"), entity("user").alias("user_name"),
    )


def run(features: DataFrame, kind: str, until_ms: int, score_hours: float = 1.0, width: int = 300_000) -> DataFrame:
    """Reasons of the complete windows in the last hours before ``until_ms``; windows before the history they need are not read."""
    until = until_ms // width * width
    since = until - int(score_hours * 3_600_000)
    needed = features.filter((F.col("window_start_ms") >= since - LOOKBACK_MS) & (F.col("window_start_ms") < until))
    return reasons(needed, kind, since, until)


def attach_evidence(found: DataFrame, events: DataFrame, entity: Column, width: int, most: int = 50) -> DataFrame:
    """The first ``most`` sequence numbers of the events of each flagged window."""
    rows = events.select(entity.alias("entity"), (F.floor(F.col("time") / width) * width).cast("long").alias("window_start_ms"), "sequence_num")
    keys = ["entity", "window_start_ms"]
    first = Window.partitionBy(*keys).orderBy("sequence_num")
    kept = rows.join(found.select(*keys).distinct(), keys, "left_semi").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= most)
    listed = kept.groupBy(*keys).agg(F.array_sort(F.collect_list("sequence_num")).alias("event_sequences"))
    return found.join(listed, keys, "left")


def unwritten(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Flags whose id is not stored yet, so that scoring windows again writes nothing twice."""
    return found.join(stored.select("finding_uid"), "finding_uid", "left_anti").dropDuplicates(["finding_uid"])


def reasons_sql(features: str, kind: str) -> str:
    rows = " UNION ALL ".join(f"SELECT entity, window_start_ms AS t, '{k}' AS feature, CAST({k} AS DOUBLE) AS value, CAST({v} AS DOUBLE) AS min_excess FROM f" for k, v in MIN_EXCESS[kind].items())
    return f"""
WITH f AS MATERIALIZED ({features}), v AS MATERIALIZED ({rows}),
w AS (SELECT a.entity, a.window_start_ms AS t, count(*) FILTER (WHERE b.entity = a.entity) AS own, count(b.entity) AS peers
  FROM f a LEFT JOIN f b ON b.window_start_ms < a.window_start_ms AND b.window_start_ms >= a.window_start_ms - 86400000 GROUP BY 1, 2),
c AS (SELECT v.*, CASE WHEN own >= 8 THEN 'own history' ELSE 'peers' END AS baseline FROM v JOIN w USING (entity, t) WHERE value >= min_excess AND (own >= 8 OR peers >= 30)),
h AS (SELECT c.entity, c.t, c.feature, c.value, c.min_excess, c.baseline, b.value AS x FROM c JOIN v b ON b.feature = c.feature AND b.t < c.t AND b.t >= c.t - 86400000 AND b.value IS NOT NULL
  AND (c.baseline = 'peers' OR b.entity = c.entity)),
m AS (SELECT entity, t, feature, value, min_excess, baseline, count(*) AS history, quantile_cont(x, 0.5) AS median, max(x) AS highest FROM h GROUP BY ALL),
s AS (SELECT m.*, d.mad, d.mean FROM m JOIN (SELECT h.entity, h.t, h.feature, 1.4826 * quantile_cont(abs(x - median), 0.5) AS mad, 1.2533 * avg(abs(x - median)) AS mean
  FROM h JOIN m USING (entity, t, feature) GROUP BY 1, 2, 3) d USING (entity, t, feature)),
z AS (SELECT *, CASE WHEN mad <> 0 THEN mad ELSE mean END AS spread, CASE WHEN mad <> 0 THEN 'mad' WHEN mean <> 0 THEN 'mean absolute deviation' ELSE 'none' END AS spread_from FROM s)
SELECT '{kind}' AS entity_type, entity, t AS window_start_ms, feature, value, median, highest, spread, spread_from,
  CASE WHEN spread <> 0 THEN (value - median) / spread END AS z, history, baseline, min_excess
FROM z WHERE history >= CASE WHEN baseline = 'peers' THEN 30 ELSE 8 END AND value - median >= min_excess AND (spread = 0 OR (value - median) / spread >= 3.5)
"""


def flags_sql(features: str, kind: str) -> str:
    named = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(TITLES.items()))
    return f"""
SELECT entity_type, entity, window_start_ms, count(*) AS reasons,
  'baseline-' || substr(sha256('baseline|' || entity_type || '|' || entity || '|' || CAST(window_start_ms AS VARCHAR)), 1, 16) AS finding_uid,
  'Unusual ' || string_agg(title, ' and ' ORDER BY place) || ' {SUBJECTS[kind]} ' || entity AS title
FROM ({reasons_sql(features, kind)}) JOIN (VALUES {named}) n(place, feature, title) USING (feature) GROUP BY 1, 2, 3
"""
