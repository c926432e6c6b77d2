"""Dashboard questions: counts, breakdowns, timelines, parse quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENIED = ("denied", "dropped", "blocked")
# Bucket sizes in seconds.
STEPS = (1, 5, 10, 30, 60, 300, 600, 1800, 3600, 7200, 14400, 43200, 86400, 604800)


def breakdowns(events: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(dimension, value, n) for every column at once, by grouping sets: one scan and one shuffle."""
    sets = [[F.col(c)] for c in columns]
    out = events.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    picked = [(1 << len(columns)) - 1 - (1 << len(columns) - 1 - i) for i in range(len(columns))]
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c, g in zip(columns, picked, strict=True):
        name, value = F.when(F.col("g") == g, F.lit(c)).otherwise(name), F.when(F.col("g") == g, F.col(c).cast("string")).otherwise(value)
    return out.select(name.alias("dimension"), value.alias("value"), "n")


def by_source(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Current events of every source; those without any stay with 0."""
    counted = events.filter(F.col("superseded_by").isNull()).groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.join(counted, "source_id", "left").select("source_id", "source_name", F.coalesce("n", F.lit(0)).alias("events"))


def step_seconds(span_ms: Column, target: int = 60) -> Column:
    """The smallest step that needs at most ``target`` buckets, else the largest."""
    fits = F.filter(F.array(*map(F.lit, STEPS)), lambda s: span_ms / 1000 / s <= target)
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(STEPS[-1]))


def timeline(events: DataFrame, step_ms: int) -> DataFrame:
    """(slot, events, denied) without gaps between the first and the last event."""
    at = (F.floor(F.col("time") / step_ms) * step_ms).cast("long")
    slots = events.groupBy(at.alias("slot")).agg(F.count("*").alias("events"), F.count_if(F.col("disposition").isin(*DENIED)).alias("denied"))
    span = events.agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a IS NOT NULL")
    every = span.select(F.explode(F.sequence("a", "b", F.lit(step_ms).cast("long"))).alias("slot"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return every.join(slots, "slot", "left").select("slot", zero("events"), zero("denied"))


def top_denied(events: DataFrame, k: int = 8) -> DataFrame:
    hits = events.filter(F.col("disposition").isin(*DENIED)).groupBy("src_ip").agg(F.count("*").alias("n"))
    return hits.orderBy(F.col("n").desc(), "src_ip").limit(k)


def pack_group(pack: Column) -> Column:
    """vendor, learned, generic or error."""
    return (
        F.when(pack.isNull() | (pack == "parse_error"), "error").when(pack.startswith("learned:"), "learned")
        .when(pack.startswith("generic") | pack.isin("unstructured", "text"), "generic").otherwise("vendor")
    )


def parse_breakdown(events: DataFrame) -> DataFrame:
    """Share of each kind of parser, in percent to one decimal, half to even."""
    n = events.groupBy(pack_group(F.col("parser_pack")).alias("kind")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select("kind", "n", F.bround(F.col("n") * F.lit(100.0) / F.col("total"), 1).alias("percent"))


def overview(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count("*").alias("total"), F.count_if(F.col("superseded_by").isNull()).alias("current"), F.min("time").alias("oldest"), F.max("time").alias("newest"),
        F.count_distinct("source_id").alias("sources"), F.count_distinct("parser_pack").alias("parsers"),
    )


def retention(events: DataFrame, now_ms: int, minimum_days: int = 180) -> DataFrame:
    """How long events are held, and whether that reaches the minimum."""
    one = events.agg(F.min("time").alias("oldest"), F.max("time").alias("newest"), F.count("*").alias("records"))
    held = F.floor((F.lit(now_ms) - F.col("oldest")) / 86_400_000)
    return one.withColumn("days_held", held.cast("long")).withColumn("reached", held >= minimum_days)
