"""Do the stores agree: ledger, archive and events side by side, revision links, counts, witnesses, delivery batches, the report.

Tables that a rule compares are joined on their keys; one-row results are unions of counts, so nothing is crossed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import integrity, ocsf
from .search import current


def evidence_records(ledger: DataFrame, raw: DataFrame, events: DataFrame) -> DataFrame:
    """Ledger records with their archived line and event; a side that is missing stays null and is named in ``missing``."""
    lines = raw.select("raw_id", "raw_text", F.lit(True).alias("_raw"))
    typed = events.select("event_id", "class_uid", "severity", F.lit(True).alias("_event"))
    both = ledger.join(lines, "raw_id", "left").join(typed, "event_id", "left")
    missing = F.array_compact(F.array(F.when(F.col("_raw").isNull(), "raw"), F.when(F.col("_event").isNull(), "event")))
    return both.withColumn("missing", F.array_join(missing, ",")).drop("_raw", "_event")


def revision_check(events: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row: every superseded event points to a chained revision that names it, whose own event names it too.

    events: event_id, superseded_by, revises; revisions: event_id, supersedes.
    """
    old = events.filter("superseded_by IS NOT NULL").select("event_id", "superseded_by")
    chained = revisions.select(F.col("event_id").alias("superseded_by"), "supersedes", F.lit(True).alias("_chained"))
    new = events.select(F.col("event_id").alias("superseded_by"), "revises", F.lit(True).alias("_new"))
    linked = old.join(chained, "superseded_by", "left").join(new, "superseded_by", "left")
    sound = (
        F.col("_chained").isNotNull() & F.col("_new").isNotNull()
        & F.col("supersedes").eqNullSafe(F.col("event_id")) & F.col("revises").eqNullSafe(F.col("event_id"))
    )
    links = linked.agg(F.count("*").alias("superseded"), F.count_if(~sound).alias("broken_links"))
    return _beside({"revisions": revisions}, links).withColumn(
        "consistent", (F.col("revisions") == F.col("superseded")) & (F.col("broken_links") == 0)
    )


def _beside(tables: dict[str, DataFrame], one_row: DataFrame | None = None) -> DataFrame:
    """One row with the number of rows of each table under its name, and the numbers of ``one_row``."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    names = list(tables)
    if one_row is not None:
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in one_row.columns])
        parts.append(one_row.select(F.inline(pairs)))
        names += one_row.columns
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.agg(*[F.max(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in names])


def pipeline_counts(raw: DataFrame, events: DataFrame, ledger: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row: lines, events, current ones, revisions, chained and streamed records, and whether these numbers agree.

    Streamed lines have a transport other than an upload or a call.
    """
    streamed = raw.filter(F.col("transport").isNotNull() & ~F.col("transport").isin("api", "upload"))
    n = _beside({"raw_archived": raw, "events": events, "revisions": revisions, "hash_chained": ledger, "streamed": streamed})
    now = F.col("events") - F.col("revisions")
    return n.withColumn("current_events", now).withColumn("consistent", (F.col("raw_archived") == now) & (F.col("events") == F.col("hash_chained")))


def report_fingerprint(report: DataFrame) -> DataFrame:
    """A report's rows with the SHA-256 of their canonical JSON, which anyone can compute again."""
    return report.withColumn("report_sha256", F.sha2(integrity.canonical_json(report.columns), 256))


def reparse_candidates(raw: DataFrame, events: DataFrame, formats: DataFrame, generic: str = "generic_inferred") -> DataFrame:
    """(format_id, lines) of the listed formats: current events whose line was read by inference alone."""
    lines = raw.filter(F.col("format_detected") == generic).join(formats.select("format_id").distinct(), "format_id", "left_semi")
    return current(events).select("raw_id").join(lines.select("raw_id", "format_id"), "raw_id").groupBy("format_id").agg(F.count("*").alias("lines"))


def incident_events(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """(incident_id, title, sequence_num, event columns) of the facts in each incident's JSON; a fact without its event stays."""
    shape = "title string, observed_facts array<struct<sequence_num bigint>>"
    facts = incidents.withColumn("j", F.from_json("data_json", shape)).select("incident_id", "j.title", F.explode("j.observed_facts").alias("f"))
    return facts.select("incident_id", "title", "f.sequence_num").join(events, "sequence_num", "left")


def resolve_formats(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """lines with ``canonical_id``: the format that an alias stands for, else the line's own."""
    known = aliases.select(F.col("alias").alias("format_id"), F.col("format_id").alias("_to")).dropDuplicates(["format_id"])
    return lines.join(known, "format_id", "left").withColumn("canonical_id", F.coalesce("_to", "format_id")).drop("_to")


def list_formats(formats: DataFrame, aliases: DataFrame, status: str | None = None) -> DataFrame:
    """Formats with their mean confidence and number of aliases, the most frequent first."""
    rows = formats if status is None else formats.filter(F.col("status") == status)
    named = aliases.groupBy("format_id").agg(F.count_distinct("alias").alias("aliases"))
    mean = F.coalesce(F.round(F.try_divide(F.col("confidence_sum"), F.col("count")), 2), F.lit(0.0))
    out = rows.join(named, "format_id", "left").withColumn("avg_confidence", mean).withColumn("aliases", F.coalesce("aliases", F.lit(0)))
    return out.drop("confidence_sum").orderBy(F.col("count").desc(), "format_id")


def conformance(exported: DataFrame, after: int | None = None) -> DataFrame:
    """One row: exported events after a sequence number, those that break no rule, and their share in percent."""
    rows = exported if after is None else exported.filter(F.col("sequence_num") > after)
    ok = F.size("violations") == 0
    n = ocsf.violations(rows).agg(F.count("*").alias("checked"), F.count_if(ok).alias("valid"), F.max("sequence_num").alias("after"))
    return n.withColumn("valid_pct", F.coalesce(F.bround(F.try_divide(F.col("valid") * F.lit(100.0), F.col("checked")), 1), F.lit(0.0)))


def conformance_failures(exported: DataFrame, k: int = 5) -> DataFrame:
    """(violation, n): the rules broken most."""
    broken = ocsf.violations(exported).select(F.explode("violations").alias("violation"))
    return broken.groupBy("violation").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "violation").limit(k)


def log_counts(nodes: DataFrame, cosigned: DataFrame) -> DataFrame:
    """Per log that a witness knows: its node key, checkpoints signed and the last index, 0 where none was signed."""
    n = cosigned.groupBy("log_id").agg(F.count("*").alias("checkpoints"), F.max("idx").alias("last_index"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.join(n, "log_id", "left").select("log_id", "node_key_id", zero("checkpoints"), zero("last_index"))


def cosign(cosigned: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (log_id, idx, prev, digest) with a witness's ``verdict``.

    A signed index is answered again for the same digest and refused for another. A new one is signed when it follows the last one
    that is signed and extends its digest. Requests of a log are taken by index, so a run of them may be signed at once; from the first
    that fits badly on, the rest is refused. Of requests for one new index, the smallest digest is asked first and the others are others.
    """
    held = cosigned.select("log_id", "idx", F.col("digest").alias("signed"))
    last = cosigned.groupBy("log_id").agg(F.max("idx").alias("last_idx"), F.max_by("digest", "idx").alias("last_digest"))
    rows = asked.join(held, ["log_id", "idx"], "left").join(last, "log_id", "left")
    rows = rows.withColumn("last_idx", F.coalesce("last_idx", F.lit(0))).withColumn("last_digest", F.coalesce("last_digest", F.lit(integrity.GENESIS)))
    rows = rows.withColumn("first", F.min("digest").over(Window.partitionBy("log_id", "idx")))
    new = F.col("signed").isNull() & (F.col("digest") == F.col("first"))
    fresh = rows.filter(new).dropDuplicates(["log_id", "idx"])
    order = Window.partitionBy("log_id").orderBy("idx")
    follows = F.col("idx") == F.coalesce(F.lag("idx").over(order), F.col("last_idx")) + 1
    extends = F.col("prev") == F.coalesce(F.lag("digest").over(order), F.col("last_digest"))
    state = F.when(~follows, "not the next index").when(~extends, "does not extend").otherwise("signed")
    fresh = fresh.withColumn("own", state).withColumn("broken", F.max(F.when(F.col("own") != "signed", 1).otherwise(0)).over(order))
    held_up = F.when((F.col("own") == "signed") & (F.col("broken") == 1), "not the next index").otherwise(F.col("own"))
    fresh = fresh.select("log_id", "idx", held_up.alias("own"))
    verdict = (
        F.when(F.col("signed") == F.col("digest"), "signed before").when(F.col("signed").isNotNull(), "another digest is signed")
        .when(F.col("digest") != F.col("first"), "another digest is signed").otherwise(F.col("own"))
    )
    return rows.join(fresh, ["log_id", "idx"], "left").select("log_id", "idx", "prev", "digest", verdict.alias("verdict"))


def register_outputs(known: DataFrame, added: DataFrame, events: DataFrame) -> DataFrame:
    """(output, first_sequence): known outputs keep theirs, new ones are owed events after the greatest sequence number."""
    fresh = added.select("output").distinct().join(known.select("output"), "output", "left_anti")
    newest = events.agg((F.coalesce(F.max("sequence_num"), F.lit(0)) + 1).alias("first_sequence"))
    return known.select("output", "first_sequence").unionByName(fresh.join(F.broadcast(newest)).select("output", "first_sequence"))


def delivery_batches(deliveries: DataFrame, head: str = integrity.GENESIS) -> DataFrame:
    """Chained batch rows of deliveries (batch_id, output, outcome, trigger, at, sequence_num, event_uid).

    Events are counted and hashed in a shuffle by batch. Each batch names the one before it, so the chain itself is one pass over
    the rows of the batches (not of their events) in order, from ``head`` on; it holds one hash at a time.
    """
    keys = ["output", "outcome", "trigger", "at"]
    made = deliveries.groupBy(F.col("batch_id").alias("id"), *keys).agg(F.count("*").alias("count"), integrity.events_hash().alias("events_hash"))
    ordered = made.repartitionByRange(1, "id").sortWithinPartitions("id")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = head
        for pdf in frames:
            before, hashes = [], []
            for row in pdf[[*keys, "count", "events_hash"]].itertuples(index=False):
                before.append(prev)
                prev = hashlib.sha256(":".join([prev, *map(str, row)]).encode()).hexdigest()
                hashes.append(prev)
            yield pdf.assign(prev_hash=before, batch_hash=hashes)

    kinds = ", ".join(f"`{c}` {t}" for c, t in made.dtypes)
    return ordered.mapInPandas(link, f"{kinds}, prev_hash string, batch_hash string")


def newest_findings(events: DataFrame, n: int = 200) -> DataFrame:
    """The newest current findings, 200 at most: a top-k, so tasks keep n rows each."""
    found = current(events).filter(F.col("class_uid") == 2004)
    return found.orderBy(F.col("time").desc(), F.col("sequence_num").desc()).limit(min(max(n, 1), 200))


def by_count(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def sender_hosts(lines: DataFrame, hostname: Column) -> DataFrame:
    """lines (peer_ip, vendor, product, hostname) with ``device``: a sound name of the line's own, else the one that its sender has
    shown for this product up to then, when it is the only one and the vendor is known.

    ``at`` orders a sender's lines. Only the least and the greatest name so far are kept, which tells one name from several.
    """
    sound = F.when(hostname.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,62}$"), hostname)
    so_far = Window.partitionBy("peer_ip", "vendor", "product").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.withColumn("_own", sound).withColumn("_low", F.min("_own").over(so_far)).withColumn("_high", F.max("_own").over(so_far))
    only = F.when((F.col("_low") == F.col("_high")) & (F.col("vendor") != "Unknown"), F.col("_low"))
    return rows.withColumn("device", F.coalesce("_own", only)).drop("_own", "_low", "_high")
