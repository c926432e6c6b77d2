"""What outside services take: an event's payload as a column, so that a writer outside Spark's plan only has to post it.

Events are rows of the contract: its flat columns beside ``ocsf``, the whole event as JSON.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from sentrylake.functions import formats as fm
from sentrylake.functions import json_folds
from sentrylake.session import ship

APP = "sentrylake"
# Attributes that describe an event, as dotted paths into it.
KEY_PATHS = (
    "class_uid", "class_name", "activity_name", "type_uid", "severity_id", "severity", "action", "disposition", "status",
    "src_endpoint.ip", "src_endpoint.port", "dst_endpoint.ip", "dst_endpoint.port", "connection_info.protocol_name", "user.name",
    "finding_info.title", "finding_info.uid", "metadata.uid", "metadata.product.vendor_name", "metadata.product.name", "metadata.log_name",
)
# Severity numbers and names of the log data model, by severity_id.
LOG_SEVERITY = {
    0: (0, "UNSPECIFIED"), 1: (9, "INFO"), 2: (10, "INFO2"), 3: (13, "WARN"), 4: (17, "ERROR"), 5: (21, "FATAL"), 6: (21, "FATAL"), 99: (9, "INFO"),
}


def _folded(fold: Callable, kind: DataType, text: Column) -> Column:
    """A fold of ``json_folds`` over a column of texts."""
    ship(SparkSession.active())

    def run(column):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([fold(x.as_py()) for x in column], to_arrow_type(kind))

    return F.arrow_udf(run, kind)(text)


def flatten_json(text: Column) -> Column:
    """Dotted (key, value) pairs of a JSON object, in the order of its text; null where it is none.

    Lists of plain values are joined by ", "; other lists, empty ones and empty objects give no pair. Values keep JSON's spelling; a JSON null is a
    null value.
    """
    return _folded(json_folds.flatten, ArrayType(StructType().add("key", StringType()).add("value", StringType())), text)


def prune_json(text: Column) -> Column:
    """JSON without members that are null, "", {} or [], also those that only pruning made so; null where the text is no JSON.

    Lists lose elements that are empty as they stand.
    """
    return _folded(json_folds.prune, StringType(), text)


def host_of() -> Column:
    name = F.coalesce(F.nullif("device_hostname", F.lit("")), F.nullif("sender_ip", F.lit("")), F.lit(APP))
    return F.substring(F.replace(name, F.lit(" "), F.lit("_")), 1, 255)


def summary() -> Column:
    """type | title | source -> destination | action, without the parts that an event lacks."""
    known = lambda c: F.nullif(c, F.lit(""))
    src, dst = known("src_ip"), known("dst_ip")
    ends = F.when(src.isNotNull() | dst.isNotNull(), F.concat(F.coalesce(src, F.lit("?")), F.lit(" -> "), F.coalesce(dst, F.lit("?"))))
    kind = F.when(F.col("class_name").isNotNull(), F.concat_ws(": ", "class_name", "activity_name"))
    return F.concat_ws(" | ", kind, known("finding_title"), ends, known("action"))


def key_attributes(ocsf: Column) -> Column:
    """The attributes of KEY_PATHS that an event has, as a map."""
    found = F.array(*[F.struct(F.lit(p).alias("key"), F.get_json_object(ocsf, f"$.{p}").alias("value")) for p in KEY_PATHS])
    return F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull() & (e["value"] != "")))


def _json(ignore_nulls: bool = True, **fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": str(ignore_nulls).lower()})


def _with(head: Column, name: str, json_text: Column) -> Column:
    """A JSON object with one more member that is JSON already."""
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(f',"{name}":'), json_text, F.lit("}"))


def at_millis() -> Column:
    return F.date_format(F.timestamp_millis(F.coalesce("time", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def splunk(source: str = APP, sourcetype: str = f"ocsf:{APP}", index: str | None = None) -> Column:
    fields = {"time": (F.coalesce("time", F.lit(0)).cast("decimal(18,0)") / 1000).cast("decimal(18,3)"), "host": host_of(), "source": F.lit(source), "sourcetype": F.lit(sourcetype)}
    return _with(_json(**fields, **({} if index is None else {"index": F.lit(index)})), "event", F.col("ocsf"))


def bulk(index: str = f"{APP}-ocsf", day: str = "yyyy.MM.dd") -> Column:
    """Action and document of a bulk call. The id is the event's and the action ``create``, so a repeat is refused, not stored twice."""
    name = F.concat(F.lit(f"{index}-"), F.date_format(F.timestamp_millis(F.coalesce("time", F.lit(0))), day))
    action = F.to_json(F.struct(F.struct(name.alias("_index"), F.nullif("event_uid", F.lit("")).alias("_id")).alias("create")))
    return F.concat(action, F.lit('\n{"@timestamp":"'), at_millis(), F.lit('",'), F.substring("ocsf", F.lit(2), F.length("ocsf")))


def bulk_outcome(status: Column) -> Column:
    """delivered (also 409: it is there already), retry or rejected, of one item's status in a bulk answer."""
    busy = (status == 429) | (status >= 500)
    return F.when(F.coalesce(status, F.lit(200)) == 409, "delivered").when(busy, "retry").when(status >= 400, "rejected").otherwise("delivered")


def loki_labels(job: str = APP) -> Column:
    low = lambda c: F.lower(F.coalesce(c, F.lit("unknown")))
    return F.create_map(
        F.lit("job"), F.lit(job), F.lit("ocsf_class"), F.replace(low("class_name"), F.lit(" "), F.lit("_")),
        F.lit("vendor"), F.coalesce("vendor", F.lit("unknown")), F.lit("severity"), low("severity"),
    )


def loki(job: str = APP) -> Column:
    entry = F.array((F.coalesce("time", F.lit(0)) * 1000000).cast("string"), F.col("ocsf"))
    return F.to_json(F.struct(F.array(F.struct(loki_labels(job).alias("stream"), F.array(entry).alias("values"))).alias("streams")))


def otlp(service: str = APP) -> Column:
    number = F.create_map(*[F.lit(x) for k, v in LOG_SEVERITY.items() for x in (k, v[0])])
    name = F.create_map(*[F.lit(x) for k, v in LOG_SEVERITY.items() for x in (k, v[1])])
    text = lambda c: F.struct(c.alias("stringValue"))
    attribute = lambda k, c: F.struct(k.alias("key"), text(c).alias("value"))
    record = F.struct(
        (F.coalesce("time", F.lit(0)) * 1000000).cast("string").alias("timeUnixNano"), F.coalesce(number[F.col("severity_id")], F.lit(0)).alias("severityNumber"),
        F.coalesce(name[F.col("severity_id")], F.lit("UNSPECIFIED")).alias("severityText"), text(F.col("ocsf")).alias("body"),
        F.transform(F.map_entries(key_attributes(F.col("ocsf"))), lambda e: attribute(e["key"], e["value"])).alias("attributes"),
    )
    resource = F.struct(F.array(attribute(F.lit("service.name"), F.lit(service)), attribute(F.lit("host.name"), host_of())).alias("attributes"))
    scope = F.struct(F.array(record).alias("logRecords"))
    return F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeLogs"))).alias("resourceLogs")))


def sentinel() -> Column:
    flat = {
        "TimeGenerated": at_millis(), "ClassUid": F.col("class_uid"), "ClassName": F.col("class_name"), "ActivityName": F.col("activity_name"),
        "SeverityId": F.col("severity_id"), "Severity": F.col("severity"), "SrcIp": F.col("src_ip"), "SrcPort": F.col("src_port"), "DstIp": F.col("dst_ip"),
        "DstPort": F.col("dst_port"), "UserName": F.col("user_name"), "Action": F.col("action"), "Vendor": F.col("vendor"), "Product": F.col("product"),
        "Message": summary(),
    }
    return _with(_json(ignore_nulls=False, **flat), "Ocsf", F.col("ocsf"))


def datadog(service: str = APP) -> Column:
    tags = F.concat(F.lit("ocsf_class:"), F.col("class_uid").cast("string"), F.lit(",severity:"), F.lower(F.coalesce("severity", F.lit(""))))
    return _json(ddsource=F.lit(APP), service=F.lit(service), hostname=host_of(), ddtags=tags, message=F.col("ocsf"))


def newrelic() -> Column:
    more = F.map_concat(key_attributes(F.col("ocsf")), F.create_map(F.lit("ocsf"), F.col("ocsf")))
    return _json(timestamp=F.col("time"), message=summary(), attributes=more)


def gelf() -> Column:
    level = F.greatest(F.lit(7) - F.coalesce("severity_id", F.lit(0)), F.lit(0))
    return fm.to_gelf(host_of(), summary(), F.col("time"), level, {"class_uid": F.col("class_uid"), "ocsf": F.col("ocsf")})


def syslog(facility: int = 20) -> Column:
    level = F.greatest(F.lit(7) - F.coalesce("severity_id", F.lit(0)), F.lit(0))
    return fm.to_rfc5424(facility * 8 + level, F.coalesce("time", F.lit(0)), host_of(), F.lit(APP), F.col("ocsf"))


_whole = lambda: F.col("ocsf")
#: Names of outputs, with the payload that each takes; file and parquet are written by ``sinks``.
OUTPUTS: dict[str, Callable[[], Column]] = {
    "splunk_hec": splunk, "elasticsearch": bulk, "opensearch": bulk, "wazuh_indexer": bulk, "loki": loki, "otlp_http": otlp, "sentinel": sentinel,
    "webhook": _whole, "datadog": datadog, "newrelic": newrelic, "syslog": syslog, "gelf": gelf, "kafka": _whole, "file": _whole, "parquet": _whole,
}


def shaped(events: DataFrame, output: str) -> DataFrame:
    """(sequence_num, key, value) for an output: what a ``foreachBatch`` posts or Spark's Kafka writer takes. The key is the source
    address, so one talker's events stay in order in one partition."""
    if output not in OUTPUTS:
        raise ValueError(f"unknown output {output}; known: {', '.join(OUTPUTS)}")
    return events.select("sequence_num", F.col("src_ip").alias("key"), OUTPUTS[output]().alias("value"))
