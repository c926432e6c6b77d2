"""The catalogue of sources: an append-only table of changes, read as the latest state of each source; lines register what is new.

One writer at a time adds changes. A source's id is made from its name, so a batch that is run again registers nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "id string, name string, vendor string, product string, format_type string, category string, description string, is_active boolean, created_at long"
CHANGES = f"{FIELDS}, version long, removed boolean"
# The kind of device behind a pack; every other one is "network".
CATEGORIES = {
    "suricata_eve": "ids", "snort_alert": "ids", "zeek_json": "ids", "paloalto_panos": "firewall", "fortinet_fortigate": "firewall", "cisco_asa": "firewall",
    "checkpoint_log_exporter": "firewall", "juniper_srx": "firewall", "sophos_firewall": "firewall", "sonicwall_sonicos": "firewall", "pfsense_filterlog": "firewall",
}


def source_id(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 32)


def source_name(vendor: Column, product: Column, who: Column) -> Column:
    """The product, after its vendor unless it names it, and who sent."""
    label = F.when(F.contains(F.lower(product), F.lower(vendor)), product).otherwise(F.concat_ws(" ", vendor, product))
    return F.concat(label, F.lit(" ("), who, F.lit(")"))


def named(records: DataFrame) -> DataFrame:
    """records (static_name, hint_name, vendor, product, device, peer_ip, input_name) with ``source_name``: the configured name, the one
    that came with the line, or one made of the device, which is the sender or else the input where no device is known."""
    vendor, product = F.coalesce("vendor", F.lit("Unknown")), F.coalesce("product", F.lit("Syslog device"))
    made = source_name(vendor, product, F.coalesce("device", "peer_ip", "input_name"))
    return records.withColumn("vendor", vendor).withColumn("product", product).withColumn("source_name", F.coalesce("static_name", "hint_name", made))


class Catalogue:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], CHANGES).write.mode("append").parquet(path)

    def changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(self.path)

    def current(self) -> DataFrame:
        """The sources that there are now, with the version of their last change."""
        names = [c.split()[0] for c in CHANGES.split(", ")]
        last = self.changes().groupBy("id").agg(F.max_by(F.struct(*names), "version").alias("s"))
        return last.select("s.*").filter(~F.col("removed")).drop("removed")

    def _add(self, rows: DataFrame, removed: bool) -> None:
        version = self.changes().agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
        out = rows.select(*[c.split()[0] for c in FIELDS.split(", ")], F.lit(version).cast("long").alias("version"), F.lit(removed).alias("removed"))
        out.write.mode("append").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Add sources, whose ids must be new; nothing is added otherwise."""
        taken = rows.select("id").union(self.current().select("id")).groupBy("id").count().filter("count > 1").join(rows.select("id"), "id", "left_semi")
        bad = [r.id for r in taken.limit(5).collect()]
        if bad:
            raise ValueError(f"sources that are there already or named twice: {', '.join(map(str, bad))}")
        self._add(rows, False)

    def remove(self, ids: DataFrame) -> None:
        """Take sources out; their events stay."""
        self._add(self.current().join(ids.select("id"), "id", "left_semi"), True)

    def get(self, ident: str) -> DataFrame:
        return self.current().filter(F.col("id") == ident)

    def register(self, records: DataFrame, now_ms: int) -> None:
        """Add the sources of ``named`` records that are not there by name; of the records with a name the first by ``seq`` describes it.

        Records are pre-aggregated to one a name before anything is joined, so a source that sends a third of all lines is one row.
        """
        vendor, product, fmt = F.col("vendor"), F.col("product"), F.coalesce("format_type", F.lit("unknown"))
        category = F.coalesce("category", _category(fmt))
        sender = F.when(F.col("peer_ip").isNotNull(), F.concat(F.lit(" sender "), "peer_ip")).otherwise("")
        about = F.concat(F.lit("Auto-registered from "), "transport", F.lit(" input '"), "input_name", F.lit("'"), sender)
        first = records.groupBy("source_name").agg(F.min_by(F.struct(vendor, product, fmt.alias("format_type"), category.alias("category"), about.alias("description")), "seq").alias("r"))
        new = first.join(self.current().select(F.col("name").alias("source_name")), "source_name", "left_anti")
        self._add(new.select(source_id(F.col("source_name")).alias("id"), F.col("source_name").alias("name"), "r.*", F.lit(True).alias("is_active"), F.lit(now_ms).alias("created_at")), False)

    def resolve(self, records: DataFrame) -> DataFrame:
        """``named`` records with the ``source_id`` of their source; a merge join, since one source may hold a third of the rows and the
        catalogue grows with the devices."""
        known = self.current().groupBy("name").agg(F.min_by("id", F.struct("created_at", "id")).alias("source_id"))
        return records.join(known.withColumnRenamed("name", "source_name").hint("merge"), "source_name", "left")

    def listed(self, events: DataFrame | None = None) -> DataFrame:
        """Sources, newest first, with how many events (source_id, time) they have and when the last one was."""
        out = self.current().drop("version").withColumn("description", F.coalesce("description", F.lit("")))
        if events is not None:
            seen = events.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("event_count"), F.max("time").alias("last_event_at"))
            out = out.join(seen, "id", "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))
        return out.orderBy(F.col("created_at").desc(), "id")


def _category(fmt: Column) -> Column:
    out = F.lit("network")
    for pack, kind in CATEGORIES.items():
        out = F.when(fmt == pack, kind).otherwise(out)
    return out
