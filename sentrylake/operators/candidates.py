"""Candidate parsers: a rule proposed from a sample line, and how it does on a table of lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm

# Names of a format's fields and the schema's paths that they go to; ports and severities are numbers.
SRC, SPT, DST, DPT, PROTO, ACT, USER = "src_endpoint.ip", "src_endpoint.port", "dst_endpoint.ip", "dst_endpoint.port", "connection_info.protocol_name", "disposition", "user.name"
ALWAYS = {
    "cef": {"src": SRC, "spt": SPT, "dst": DST, "dpt": DPT, "proto": PROTO, "act": ACT, "severity_raw": "severity_id"},
    "leef": {"src": SRC, "dst": DST, "usrName": USER, "proto": PROTO},
}
JSON_NAMES = {"src_ip": SRC, "dest_ip": DST, "src_port": SPT, "dest_port": DPT, "proto": PROTO, "event_type": "activity_name"}
KV_NAMES = {
    SRC: ("src", "srcip", "source_ip", "saddr"), DST: ("dst", "dstip", "destination_ip", "daddr"), SPT: ("spt", "srcport", "sport"), DPT: ("dpt", "dstport", "dport"),
    PROTO: ("proto", "protocol"), ACT: ("act", "action", "status"), USER: ("user", "username", "suser"),
}
NUMBERS = (SPT, DPT, "severity_id")
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
TWO_ENDS, ANYTHING = rf"(?P<src_ip>{IP}).*?(?P<dst_ip>{IP})", r"(?P<message>.*)"

_PAIRS = "map<string,string>"


@dataclass(frozen=True)
class Candidate:
    name: str
    vendor: str
    product: str
    kind: str
    #: Field of the line -> path of the schema.
    mappings: dict[str, str] = field(default_factory=dict)
    pattern: str | None = None
    class_uid: int = 4001
    status: str = "candidate"

    def transform(self, source: str) -> str | None:
        return "int" if self.mappings[source] in NUMBERS else None


def _merged(first: Column, then: Column) -> Column:
    """Two maps as one, the second having its way."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(first), lambda e: ~F.map_contains_key(then, e["key"])), F.map_entries(then)))


def _headed(parsed: Column, names: dict[str, str]) -> Column:
    head = F.create_map(*[x for ours, theirs in names.items() for x in (F.lit(theirs), parsed[ours])])
    return F.when(parsed.isNotNull(), _merged(F.map_filter(head, lambda k, v: v.isNotNull() & (v != "")), F.coalesce(parsed["ext"], F.expr("map()").cast(_PAIRS))))


def fields(kind: str, line: Column) -> Column:
    """The fields of a line as a map, null where it does not read as ``kind``: cef, leef, json, kv or syslog."""
    if kind == "cef":
        return _headed(fm.cef(line), {n: {"severity": "severity_raw", "version": "device_version", "name": "event_name"}.get(n, n) for n in fm.CEF_HEAD})
    if kind == "leef":
        return _headed(fm.leef(line), {n: n for n in ("leef_version", "vendor", "product", "version", "event_id")})
    if kind == "json":
        return F.when(fm.json_object(line).isNotNull(), fm.json_pairs(line))
    if kind == "kv":
        return fm.kv(line, least=2)
    if kind == "syslog":
        env = fm.envelope(line)
        return F.when(line.startswith("<") & env["message"].isNotNull(), F.map_filter(F.create_map(F.lit("hostname"), env["hostname"], F.lit("app"), env["app"], F.lit("message"), env["message"]), lambda k, v: v.isNotNull()))
    raise ValueError(f"no such format: {kind}")


def detect(line: Column) -> Column:
    """(kind, fields) of a line: json, cef, leef, syslog with or without pairs, kv; ``text`` for others, ``empty`` for none. What is within an
    envelope decides before the envelope."""
    t = F.trim(line, F.lit(" \t\r\n"))
    as_ = lambda kind, m: F.struct(F.lit(kind).alias("kind"), m.cast(_PAIRS).alias("fields"))
    # each format is tried once, and only where those before it did not read the line
    found = lambda kind, m: fm.let(m, lambda x: F.when(x.isNotNull(), as_(kind, x)))
    within = lambda bare: fm.let(fm.kv(bare["message"], least=2), lambda kv: F.when(kv.isNotNull(), as_("syslog_kv", _merged(bare, kv))).otherwise(as_("syslog", bare)))
    none = F.lit(None)
    return F.coalesce(
        F.when(t == "", as_("empty", none)), F.when(t.startswith("{") & t.endswith("}"), found("json", fields("json", t))), F.when(F.contains(t, F.lit("CEF:")), found("cef", fields("cef", t))),
        F.when(F.contains(t, F.lit("LEEF:")), found("leef", fields("leef", t))), F.when(t.startswith("<"), fm.let(fields("syslog", t), lambda bare: F.when(bare.isNotNull(), within(bare)))), found("kv", fields("kv", t)), as_("text", none),
    )


def propose(spark: SparkSession, sample: str, name: str, vendor: str, product: str, class_uid: int = 4001) -> Candidate:
    """A candidate from one sample line; it is never approved by itself."""
    if not sample or not sample.strip():
        raise ValueError("a parser is proposed from a line with text")
    row = spark.createDataFrame([(sample.strip(),)], "line string").select(detect(F.col("line")).alias("d"), F.size(F.regexp_extract_all("line", F.lit(IP), F.lit(0))).alias("ips")).first()
    kind, found, pattern = row.d.kind, row.d.fields or {}, None
    if kind in ALWAYS:
        mappings = ALWAYS[kind]
    elif kind == "json":
        mappings = {k: v for k, v in JSON_NAMES.items() if k in found}
    elif kind in ("kv", "syslog_kv"):
        kind = "kv"
        role = {n: path for path, names in KV_NAMES.items() for n in names}
        mappings = {k: role[k.lower()] for k in found if k.lower() in role}
    else:
        kind = "regex"
        pattern, mappings = (TWO_ENDS, {"src_ip": SRC, "dst_ip": DST}) if row.ips >= 2 else (ANYTHING, {"message": "unmapped.message"})
    return Candidate(name, vendor, product, kind, dict(mappings), pattern, class_uid)


def tested(candidate: Candidate, lines: DataFrame, line: str = "line") -> DataFrame:
    """Every line with text: whether the candidate reads it, the fields that it finds and, where it does not, why."""
    t = F.trim(F.col(line), F.lit(" \t\r\n"))
    if candidate.kind == "regex":
        names, java = re.findall(r"\(\?P<(\w+)>", candidate.pattern), re.sub(r"\(\?P<\w+>", "(", candidate.pattern)
        got = F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.regexp_extract(t, java, i))])
        read, why = F.when(t.rlike(java), got), "Pattern did not match the line"
    else:
        read, why = fields(candidate.kind, t), f"Not read as {candidate.kind}"
    rows = lines.filter(F.length(t) > 0).withColumn("fields", read)
    return rows.withColumn("passed", F.col("fields").isNotNull()).withColumn("error", F.when(F.col("fields").isNull(), why))


def validation(tested_lines: DataFrame) -> DataFrame:
    """One row: lines, those read, those not, and the percentage read."""
    return tested_lines.agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.round(F.try_divide(F.count_if("passed") * 100.0, F.count("*")), 1), F.lit(0.0)).alias("accuracy"),
    )


def unmapped(candidate: Candidate, tested_lines: DataFrame) -> DataFrame:
    """Fields that lines hold and the candidate maps nowhere, with the number of lines; keys may be data, so they stay a table."""
    key = tested_lines.select(F.explode(F.map_keys("fields")).alias("field"))
    return key.filter(~F.col("field").isin(*candidate.mappings) & ~F.col("field").startswith("_")).groupBy("field").agg(F.count("*").alias("n"))
