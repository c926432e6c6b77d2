"""Sinks: partitioned Parquet in two layouts, daily JSON lines, and which events an output takes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepts(classes: Iterable[int] = (), min_severity: int = 0, sources: Iterable = ()) -> Column:
    """Every condition that an output names; an empty one takes all."""
    ok = F.col("severity_id") >= min_severity
    classes, sources = list(classes), list(sources)
    if classes:
        ok = ok & F.col("class_uid").isin(*classes)
    return ok & F.col("source_id").isin(*sources) if sources else ok


def route(events: DataFrame, outputs: dict[str, dict]) -> DataFrame:
    """(output, outcome, event): each output's events, and those it filters out with the outcome ``filtered``. The events are read once."""
    outcome = lambda conditions: F.when(F.coalesce(accepts(**conditions), F.lit(False)), "queued").otherwise("filtered")
    each = [F.struct(F.lit(name).alias("output"), outcome(conditions).alias("outcome")) for name, conditions in outputs.items()]
    return events.select(F.inline(F.array(*each)), "event_id", "sequence_num")


def day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyyMMdd")


def write_hive(events: DataFrame, path: str) -> None:
    """class_uid=/event_day= directories; a partition's rows are sorted by time for row-group pruning."""
    rows = events.withColumn("event_day", day(F.col("time")))
    rows = rows.repartition("class_uid", "event_day").sortWithinPartitions("class_uid", "event_day", "time")
    rows.write.mode("append").option("compression", "zstd").partitionBy("class_uid", "event_day").parquet(path)


def write_lake(events: DataFrame, path: str, source: str, region: str, account: str, version: str = "1.1.0") -> None:
    """ext/<source>/region=/accountId=/eventDay= with one class per object; only schema versions up to 1.3."""
    if tuple(map(int, version.split(".")[:2])) > (1, 3):
        raise ValueError(f"schema version {version} is not accepted by this layout")
    rows = events.withColumn("region", F.lit(region)).withColumn("accountId", F.lit(account)).withColumn("eventDay", day(F.col("time")))
    for uid in (r[0] for r in events.select("class_uid").distinct().collect()):
        one = rows.filter(F.col("class_uid") == uid).repartition("eventDay").sortWithinPartitions("time")
        one.write.mode("append").option("compression", "zstd").partitionBy("region", "accountId", "eventDay").parquet(f"{path}/ext/{source}-{uid}")


def write_json_days(events: DataFrame, path: str) -> None:
    events.withColumn("day", day(F.col("time"))).write.mode("append").partitionBy("day").json(path)


def export_oldest(events: DataFrame, limit: int = 5000) -> DataFrame:
    return events.orderBy("sequence_num").limit(min(limit, 5000))
