"""Inbound payloads to one row per line: (raw, hints). Batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.sources import frames

LINES = r"([^\n]*\n|[^\n]+$)"


def lines(payload: Column) -> Column:
    """A text cut into lines that keep their ends; blank ones are left out by ``not_blank``."""
    return F.regexp_extract_all(payload, F.lit(LINES), F.lit(1))


def not_blank(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(" \t\r\n"))) > 0


def datagram(payload: Column) -> Column:
    """One message, or several when every line of it starts with a priority."""
    parts = F.filter(F.split(payload, "\r?\n"), lambda x: x != "")
    return F.when((F.size(parts) > 1) & F.forall(parts, lambda x: x.startswith("<")), parts).otherwise(F.array(payload))


def datagrams(payload: Column, limit: int = 65_536) -> Column:
    """The messages of a datagram's first ``limit`` bytes, as bytes: see ``datagram``. Lines are cut apart as Latin-1, which keeps every byte."""
    text = F.decode(F.substring(payload, 1, limit), "ISO-8859-1")
    parts = F.filter(F.split(text, "\r?\n"), not_blank)
    several = (F.size(parts) > 1) & F.forall(parts, lambda x: x.startswith("<"))
    return F.transform(F.when(several, parts).otherwise(F.array(text)), lambda x: F.encode(x, "ISO-8859-1"))


def tcp_frames(payload: Column, limit: int = frames.LIMIT) -> Column:
    """RFC 6587 frames of a whole buffer as text, without the ends of lines. Counts are of bytes."""
    return F.transform(frames.whole(payload, limit), lambda f: F.regexp_replace(F.decode(f, "UTF-8"), r"\r?\n$", ""))


def json_objects(body: Column) -> Column:
    """JSON objects written one after the other, cut where one ends and the next begins; braces within strings are text."""
    tokens = F.regexp_extract_all(body, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"?|\}\s*\{|[^"}]++|\}'), F.lit(0))
    marked = F.transform(tokens, lambda t: F.when(t.rlike(r"^\}\s*\{$"), "}\u001e{").otherwise(t))
    return F.transform(F.split(F.array_join(marked, ""), "\u001e"), lambda o: F.trim(o, F.lit(" \t\r\n")))


def _hec(bodies: DataFrame, body: str) -> tuple[DataFrame, Column]:
    """The bodies with their objects, and whether every object of a body is JSON with an ``event``."""
    cut = bodies.withColumn("_objects", json_objects(F.trim(F.col(body), F.lit(" \t\r\n"))))
    return cut, F.coalesce(F.forall("_objects", lambda o: F.try_parse_json(o).isNotNull() & F.get_json_object(o, "$.event").isNotNull()), F.lit(False))


def hec_events(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Event-collector JSON: objects one after the other. A body with an object that is broken or has no ``event`` is refused as a
    whole, see ``hec_refused``. Text events stay, objects become JSON."""
    cut, sound = _hec(bodies, body)
    one = cut.filter(sound).withColumn("_o", F.explode("_objects"))
    raw = F.coalesce(F.get_json_object("_o", "$.event._raw"), F.get_json_object("_o", "$.event"))
    keep = [c for c in bodies.columns if c != body]
    return one.select(
        *keep, raw.alias("raw"), F.get_json_object("_o", "$.host").alias("host"), F.get_json_object("_o", "$.sourcetype").alias("sourcetype"), F.get_json_object("_o", "$.time").try_cast("double").alias("sent_at"),
    )


def hec_refused(bodies: DataFrame, body: str = "body") -> DataFrame:
    cut, sound = _hec(bodies, body)
    return cut.filter(~sound).select(*bodies.columns)


def hec_raw(bodies: DataFrame, body: str = "body") -> DataFrame:
    keep = [c for c in bodies.columns if c != body]
    return bodies.select(*keep, F.explode(F.split(body, r"\r?\n")).alias("raw")).filter(not_blank(F.col("raw")))


_VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
OTLP = (
    f"resourceLogs array<struct<resource:struct<attributes:array<struct<key:string,value:{_VALUE}>>>,scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,severityText:string,"
    f"body:{_VALUE},attributes:array<struct<key:string,value:{_VALUE}>>>>>>>>"
)


def otlp_logs(bodies: DataFrame, body: str = "body") -> DataFrame:
    """OTLP/JSON log records with their resource's host name."""
    value = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    keep = [c for c in bodies.columns if c != body]
    r = bodies.select(*keep, F.explode(F.from_json(body, OTLP)["resourceLogs"]).alias("r"))
    host = F.get(F.filter("r.resource.attributes", lambda a: a["key"] == "host.name"), F.lit(0))["value"]
    s = r.select(*keep, value(host).alias("host"), F.explode("r.scopeLogs").alias("s"))
    rec = s.select(*keep, "host", F.explode("s.logRecords").alias("l"))
    return rec.select(*keep, "host", value(F.col("l.body")).alias("raw"), F.col("l.severityText").alias("severity"), (F.col("l.timeUnixNano").try_cast("long") / 1_000_000).cast("long").alias("time_ms"))


def http_stream(bodies: DataFrame, body: str = "body", message_field: str = "message") -> DataFrame:
    """A body of plain lines, JSON lines or a JSON array; a JSON object gives its message field, else itself."""
    array = F.col(body).rlike(r"(?s)^\s*\[")
    items = F.when(array, F.transform(F.try_parse_json(body).cast("array<variant>"), lambda v: F.to_json(v))).otherwise(F.split(body, r"\r?\n"))
    keep = [c for c in bodies.columns if c != body]
    rows = bodies.select(*keep, F.explode(items).alias("_i")).filter(not_blank(F.col("_i")))
    return rows.select(*keep, F.coalesce(F.get_json_object("_i", f"$.{message_field}"), F.col("_i")).alias("raw"), F.coalesce(F.get_json_object("_i", "$.host.name"), F.get_json_object("_i", "$.host")).alias("host"))


def tail_files(spark: SparkSession, glob: str, per_batch: int = 100) -> DataFrame:
    """Streaming lines of a folder's files; the checkpoint holds what was read."""
    return spark.readStream.option("maxFilesPerTrigger", per_batch).text(glob).withColumn("input", F.col("_metadata.file_path"))


def kafka(spark: SparkSession, servers: str, topics: str, **options: str) -> DataFrame:
    """Streaming lines of Kafka topics. Needs Spark's Kafka package on the cluster."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load().select(F.col("value").alias("raw"), F.col("topic").alias("input"), "timestamp")


def parquet_events(spark: SparkSession, root: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Stored events under a folder, only these (name, type) columns; a missing one is null."""
    found = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(root)
    return found.select(*[(F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in columns])


def named_sources(records: DataFrame, static: DataFrame) -> DataFrame:
    """``source_name`` by peer address first, then by host name in any case. The static list is configuration, so small."""
    by_ip = static.filter("match_ip IS NOT NULL").select(F.col("match_ip").alias("peer_ip"), F.col("name").alias("_a")).dropDuplicates(["peer_ip"])
    by_host = static.filter("match_hostname IS NOT NULL").select(F.lower("match_hostname").alias("_h"), F.col("name").alias("_b")).dropDuplicates(["_h"])
    out = records.withColumn("_h", F.lower("hostname")).join(F.broadcast(by_ip), "peer_ip", "left").join(F.broadcast(by_host), "_h", "left")
    return out.withColumn("source_name", F.coalesce("_a", "_b")).drop("_a", "_b", "_h")


def batch_counts(lines: DataFrame, by: str, text: str = "line") -> DataFrame:
    """Per upload or call: lines, lines taken and blank ones left out; a line that starts with # is taken."""
    blank = ~F.coalesce(not_blank(F.col(text)), F.lit(False))
    return lines.groupBy(by).agg(F.count("*").alias("total"), F.count_if(~blank).alias("ingested"), F.count_if(blank).alias("skipped_blank"))


def csv_lines(lines: DataFrame) -> DataFrame:
    """lines (path, pos, line) with ``is_header`` and the file's ``delimiter`` and ``names``, null where it has no header.

    The first two lines with text decide. They are found by two aggregates, so a large file is not gathered; the header rule runs once a
    file. Lines of a header's file carry it after its own line.
    """
    some = lines.filter(not_blank(F.col("line")))
    header = F.udf(lambda a, b: fm.csv_header(a, b), "struct<delimiter:string,names:array<string>>")
    first = some.groupBy("path").agg(F.min(F.struct("pos", "line")).alias("a"))
    second = some.join(first, "path").filter(F.col("pos") > F.col("a.pos")).groupBy("path").agg(F.min(F.struct("pos", "line")).alias("b"))
    heads = first.join(second, "path").select("path", F.col("a.pos").alias("_at"), header("a.line", "b.line").alias("_h")).filter("_h IS NOT NULL")
    out = lines.join(heads, "path", "left")
    after = F.col("pos") > F.col("_at")
    return out.select(
        *[F.col(c) for c in lines.columns], F.coalesce(F.col("pos") == F.col("_at"), F.lit(False)).alias("is_header"),
        F.when(after, F.col("_h.delimiter")).alias("delimiter"), F.when(after, F.col("_h.names")).alias("names"),
    )
