"""Rows of the archive, its newest entries, canonical events of a pack, and features for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ocsf import CARRIED, activity_name, iso_millis

#: The archive's columns in order, with their types.
ARCHIVE = {
    "id": "string", "sequence_num": "long", "raw_id": "string", "class_uid": "int", "class_name": "string", "category_uid": "int", "category_name": "string", "activity_id": "int", "activity_name": "string",
    "severity_id": "int", "severity": "string", "time": "string", "time_epoch_ms": "long", "src_ip": "string", "src_port": "int", "dst_ip": "string", "dst_port": "int", "protocol": "string", "action": "string",
    "disposition": "string", "user_name": "string", "finding_title": "string", "normalized_json": "string", "unmapped_json": "string", "parser_pack": "string",
}
#: What an export or a list may hold at most.
LEDGER_ROWS, FEATURE_ROWS = 200, 1_000_000


def archive_rows(exported: DataFrame, fmt: str = "generic_inferred", own: str = "$.parse.parser_pack") -> DataFrame:
    """Strict events (``ocsf.export``) as the flat rows of the archive. ``unmapped`` is JSON text beside them; what read an event is the
    parser that it names there at the path ``own``, else its pack, else ``fmt``."""
    has = set(exported.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    end = lambda s, f: F.col(f"{s}_endpoint.{f}")
    made = {
        "id": F.col("event_id"), "category_uid": F.floor(F.col("class_uid") / 1000), "activity_name": activity_name(), "time": iso_millis(F.col("time")), "time_epoch_ms": F.col("time"), **{f"{s}_{f}": end(s, f) for s in ("src", "dst") for f in ("ip", "port")},
        "protocol": F.col("protocol_name"), "user_name": F.col("user"), "normalized_json": F.to_json(F.struct(*[c for c in exported.columns if c not in CARRIED])),
        "unmapped_json": F.coalesce(col("unmapped"), F.lit("{}")), "parser_pack": F.coalesce(F.nullif(F.get_json_object(col("unmapped"), own), F.lit("")), col("parser_pack"), F.lit(fmt)),
    }
    return exported.select(*[made.get(c, col(c)).cast(t).alias(c) for c, t in ARCHIVE.items()])


def canonical_event(vendor: str, product: str, class_uid: int, fields: dict[str, Column], extra: Column | None = None, activity: tuple[int, str] | None = None) -> Column:
    """What a pack hands on: its names and class, the canonical ``fields`` that hold something, and the device's other fields apart in
    ``vendor_fields`` (a map), so that they cannot be taken for canonical ones. Null and empty values are left out."""
    holds = lambda k, v: v.isNotNull() & (v != "")
    some = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]) if fields else F.expr("map()").cast("map<string,string>")
    number, name = activity or (None, None)
    return F.struct(
        F.lit(vendor).alias("vendor"), F.lit(product).alias("product"), F.lit(class_uid).alias("class_uid"), F.lit(number).cast("int").alias("activity_id"), F.lit(name).cast("string").alias("activity_name"),
        F.map_filter(some, holds).alias("fields"), (F.lit(None).cast("map<string,string>") if extra is None else F.map_filter(extra, holds)).alias("vendor_fields"),
    )


def newest_ledger(ledger: DataFrame, events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest entries of the ledger, newest first, with what their event says. The limit comes before the join."""
    if not 1 <= limit <= LEDGER_ROWS:
        raise ValueError(f"limit is 1 to {LEDGER_ROWS}, not {limit}")
    top = ledger.orderBy(F.col("sequence_num").desc()).limit(limit)
    said = events.select("event_id", "severity", "class_name", "action")
    # at most LEDGER_ROWS rows on one side: told to all tasks, and the events that match come back
    met = said.join(F.broadcast(top.select("event_id")), "event_id", "left_semi")
    return top.join(met, "event_id", "left").orderBy(F.col("sequence_num").desc())


def newest_incidents(incidents: DataFrame, ident: str | None = None) -> DataFrame:
    """Stored incidents, the last version of each, newest first; or one of them."""
    last = incidents.groupBy("incident_id").agg(F.max_by(F.struct(*[c for c in incidents.columns if c != "incident_id"]), "created_at").alias("i"))
    out = last.select("incident_id", "i.*")
    return (out if ident is None else out.filter(F.col("incident_id") == ident)).orderBy(F.col("created_at").desc(), "incident_id")


def oldest_features(table: DataFrame, limit: int = 100_000) -> DataFrame:
    """Window features, oldest window first and by entity within it, without NaN."""
    if not 1 <= limit <= FEATURE_ROWS:
        raise ValueError(f"limit is 1 to {FEATURE_ROWS}, not {limit}")
    plain = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in table.dtypes]
    return table.select(*plain).orderBy("window_start_ms", "entity").limit(limit)


def write_features(table: DataFrame, path: str, form: str = "csv", limit: int = 100_000) -> None:
    """``oldest_features`` as one CSV file with a header, or as JSON lines in which what is not known is null."""
    out = oldest_features(table, limit).coalesce(1)
    if form == "csv":
        out.write.option("header", "true").csv(path)
    elif form == "json":
        out.write.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"form is csv or json, not {form}")
