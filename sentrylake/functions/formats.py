"""Line formats as Column expressions: key=value, CEF, LEEF, JSON, syslog, CSV, XML; and the encoders back to text."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from sentrylake.functions import xml_folds
from sentrylake.session import ship

LIST_KEYS = r"[A-Za-z_][\w.\-]*"
KV = rf'({LIST_KEYS})=("(?:[^"\\]|\\.)*"|[^\s"]*)'


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f over a value that is computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


#: Stands between the groups of a match; no line has it.
_BETWEEN = "\x1d\x1e\x1d"


def groups(text: Column, pattern: str, whole: bool = False) -> Column:
    """All groups of the first match as an array, by one run of the expression; null without a match. A group that took no part
    is empty. ``whole``: the pattern is for the whole text."""
    n = re.compile(pattern).groups
    full = pattern if whole else rf"(?s)^.*?{pattern}.*$"
    parts = F.split(F.regexp_replace(text, full, _BETWEEN.join(f"${i + 1}" for i in range(n)) + _BETWEEN), _BETWEEN)
    return let(parts, lambda p: F.when(F.size(p) == n + 1, p))


def last_wins(keys: Column, values: Column) -> Column:
    """A map of two arrays in which the last of equal keys stays."""

    def of(kv: Column) -> Column:
        n = F.size(kv["k"])
        rows = F.transform(kv["k"], lambda k, i: F.struct(k.alias("key"), F.get(kv["v"], i).alias("value"), F.array_contains(F.slice(kv["k"], i + 2, n), k).alias("again")))
        return F.map_from_entries(F.transform(F.filter(rows, lambda r: ~r["again"]), lambda r: F.struct(r["key"], r["value"])))

    return let(F.struct(keys.alias("k"), values.alias("v")), of)


def kv(text: Column, least: int = 1) -> Column:
    """key=value and key="quoted value" pairs; null when there are fewer than ``least``."""
    keys = F.regexp_extract_all(text, F.lit(KV), F.lit(1))
    raw = F.regexp_extract_all(text, F.lit(KV), F.lit(2))
    values = F.transform(raw, lambda v: F.when(v.startswith('"'), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('\\"'), F.lit('"'))).otherwise(v))
    return F.when(F.size(keys) >= least, last_wins(keys, values))


def delimited_kv(text: Column, delimiter: str, separator: str = "=") -> Column:
    pieces = F.filter(F.split(text, re.escape(delimiter)), lambda p: F.contains(p, F.lit(separator)))
    key = lambda p: F.trim(F.substring_index(p, separator, 1))
    value = lambda p: F.trim(F.trim(F.substring(p, F.length(F.substring_index(p, separator, 1)) + 1 + len(separator), F.length(p))), F.lit('"'))
    return last_wins(F.transform(pieces, key), F.transform(pieces, value))


_PART = r"((?:[^|\\]|\\.)*)"
CEF = r"(?s)CEF:\s*(\d+)\|" + r"\|".join([_PART] * 6) + r"\|(.*)$"
EXTENSION = r"(?s)([\w.\-\[\]]+)=(.*?)(?=\s+[\w.\-\[\]]+=|\s*$)"
CEF_HEAD = ("cef_version", "vendor", "product", "version", "event_class_id", "name", "severity")


def cef(text: Column) -> Column:
    """A struct of the header parts and ``ext``, a map; null for other lines."""
    plain = lambda c: F.replace(F.replace(c, F.lit("\\|"), F.lit("|")), F.lit("\\\\"), F.lit("\\"))
    head = [plain(F.regexp_extract(text, CEF, i + 1)).alias(n) for i, n in enumerate(CEF_HEAD)]
    tail = F.regexp_extract(text, CEF, 8)
    unescape = lambda v: F.trim(F.trim(F.replace(F.replace(F.replace(v, F.lit("\\="), F.lit("=")), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))), F.lit('"'))
    ext = last_wins(F.regexp_extract_all(tail, F.lit(EXTENSION), F.lit(1)), F.transform(F.regexp_extract_all(tail, F.lit(EXTENSION), F.lit(2)), unescape))
    return F.when(text.rlike(CEF), F.struct(*head, ext.alias("ext")))


def leef(text: Column) -> Column:
    """LEEF 1.0 and 2.0: a struct of the header parts and ``ext``. Version 2 may name its delimiter, as a character or xHH."""
    parts = F.split(F.regexp_extract(text, r"(?s)LEEF:(.*)$", 1), r"\|", 6)
    two = F.get(parts, F.lit(0)).startswith("2")
    named = F.trim(F.get(parts, F.lit(5)))
    v2 = F.split(F.regexp_extract(text, r"(?s)LEEF:(.*)$", 1), r"\|", 7)
    has_delimiter = two & (F.size(v2) == 7)
    hexed = F.regexp_extract(F.get(v2, F.lit(5)), r"^(?:0x|x)([0-9A-Fa-f]{2})$", 1)
    delimiter = F.when(has_delimiter, F.when(hexed != "", F.unhex(hexed).cast("string")).when(F.length(F.get(v2, F.lit(5))) == 1, F.get(v2, F.lit(5)))).otherwise("\t")
    body = F.when(has_delimiter, F.get(v2, F.lit(6))).otherwise(named)
    pieces = F.filter(F.split(F.replace(body, F.coalesce(delimiter, F.lit("\t")), F.lit("\x1f")), "\x1f"), lambda p: F.contains(p, F.lit("=")))
    ext = last_wins(F.transform(pieces, lambda p: F.trim(F.substring_index(p, "=", 1))), F.transform(pieces, lambda p: F.substring(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))))
    names = ("leef_version", "vendor", "product", "version", "event_id")
    return F.when(text.rlike(r"LEEF:\d") & (F.size(parts) >= 6), F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)], ext.alias("ext")))


RFC5424 = r"(?s)^<(\d{1,3})>(\d{1,2}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:[^\]\\\"]|\\.|\"(?:[^\"\\]|\\.)*\")*\])+)(?: (.*))?$"
RFC3164 = r"(?s)^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2}(?: \d{4})? \d{2}:\d{2}:\d{2}) (\S+) (?:([\w./\-]+)(?:\[(\d+)\])?: ?)?(.*)$"
BARE = r"(?s)^<(\d{1,3})>(.*)$"


def structured_data(sd: Column) -> Column:
    """RFC 5424 parameters as a map of id.name to value, escapes undone."""
    elements = F.regexp_extract_all(sd, F.lit(r'\[((?:[^\]\\"]|\\.|"(?:[^"\\]|\\.)*")*)\]'), F.lit(1))
    pair = r'([^\s="\]]+)="((?:[^"\\]|\\.)*)"'

    def of(e: Column) -> Column:
        ident = F.regexp_extract(e, r"^(\S+)", 1)
        return F.arrays_zip(
            F.transform(F.regexp_extract_all(e, F.lit(pair), F.lit(1)), lambda k: F.concat(ident, F.lit("."), k)).alias("k"),
            F.transform(F.regexp_extract_all(e, F.lit(pair), F.lit(2)), lambda v: F.regexp_replace(v, r'\\(["\\\]])', "$1")).alias("v"),
        )

    flat = F.flatten(F.transform(elements, of))
    return last_wins(F.transform(flat, lambda x: x["k"]), F.transform(flat, lambda x: x["v"]))


def envelope(text: Column) -> Column:
    """A struct (pri, facility, severity, timestamp, hostname, app, procid, msgid, sd, message) of a syslog line."""
    nil = lambda c: F.nullif(F.nullif(c, F.lit("-")), F.lit(""))
    none = F.lit(None).cast("string")

    def row(pri: Column, timestamp=none, hostname=none, app=none, procid=none, msgid=none, sd=None, message=text) -> Column:
        number = pri.try_cast("int")
        sd = F.lit(None).cast("map<string,string>") if sd is None else F.when(sd != "-", structured_data(sd))
        return F.struct(
            number.alias("pri"), F.shiftright(number, 3).alias("facility"), number.bitwiseAND(7).alias("severity"), nil(timestamp).alias("timestamp"), nil(hostname).alias("hostname"), nil(app).alias("app"),
            nil(procid).alias("procid"), nil(msgid).alias("msgid"), sd.alias("sd"), message.alias("message"),
        )

    def new(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i - 1))
        return row(at(1), at(3), at(4), at(5), at(6), at(7), at(8), at(9))

    def old(g: Column) -> Column:
        at = lambda i: F.get(g, F.lit(i - 1))
        return row(at(1), at(2), at(3), at(4), at(5), message=at(6))

    bare = let(groups(text, BARE, True), lambda g: F.when(g.isNotNull(), row(F.get(g, F.lit(0)), message=F.get(g, F.lit(1)))).otherwise(row(none)))
    three = let(groups(text, RFC3164, True), lambda g: F.when(g.isNotNull(), old(g)).otherwise(bare))
    five = let(groups(text, RFC5424, True), lambda g: F.when(g.isNotNull(), new(g)).otherwise(three))
    return F.when(text.rlike(r"^<\d{1,3}>\d"), five).otherwise(three)


def pri_severity(severity: Column) -> Column:
    return F.when(severity <= 2, "critical").when(severity == 3, "high").when(severity == 4, "medium").when(severity == 5, "low").when(severity <= 7, "informational")


def json_object(text: Column) -> Column:
    """A variant where the line is one JSON object, else null."""
    v = F.try_parse_json(text)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def json_pairs(text: Column) -> Column:
    """Top-level members of a JSON object as text."""
    return F.when(F.trim(text).startswith("{"), F.from_json(text, "map<string,string>"))


def structure(text: Column) -> Column:
    """json, xml, cef, leef, kv, delimited or text."""
    t = F.trim(text)
    pairs = F.size(F.regexp_extract_all(t, F.lit(KV), F.lit(1)))
    count = lambda d: F.length(t) - F.length(F.translate(t, d, ""))
    piecewise = F.lit(False)
    for d in "|;,\t":
        n = F.size(F.filter(F.split(t, re.escape(d)), lambda p: p.rlike(rf"^\s*{LIST_KEYS}\s*=")))
        piecewise = piecewise | ((n >= 3) & (n >= 0.6 * (count(d) + 1)))
    return (
        F.when(F.try_parse_json(t).isNotNull() & t.startswith("{"), "json").when(t.rlike(r"(?s)^<[A-Za-z?][^>]*>.*>$"), "xml").when(t.rlike(r"CEF:\s*\d+\|"), "cef")
        .when(t.rlike(r"LEEF:\d"), "leef").when(piecewise | (pairs >= 2), "kv").when((count(",") >= 4) | (count("\t") >= 4), "delimited").otherwise("text")
    )


def xml_pairs(text: Column, most: int = 400, bytes_: int = 65536) -> Column:
    """Simple elements, Name= data elements and attributes of a document; none where it declares a DOCTYPE or an entity or is too long."""
    safe = ~text.rlike(r"(?i)<!(DOCTYPE|ENTITY)") & (F.octet_length(text) <= bytes_)
    unescape = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    simple, data, attr = r"<([\w.\-:]+)(?:\s[^<>]*)?>([^<>]+)</\1>", r"<Data\s+Name=[\"']([^\"']+)[\"']\s*>([^<>]*)</Data>", r"\s([\w.\-:]+)=[\"']([^\"'<>]*)[\"']"
    k = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (attr, simple, data)])
    v = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(2)) for p in (attr, simple, data)])
    return F.when(safe, last_wins(F.slice(k, 1, most), F.slice(F.transform(v, unescape), 1, most)))


def xml_paths(text: Column, most: int = xml_folds.PAIRS, bytes_: int = xml_folds.BYTES) -> Column:
    """(key, value) pairs of a document by dotted paths, in its order: namespaces, CDATA, attributes and equal nested names; see ``xml_folds``.
    ``xml_pairs`` reads flat documents without leaving the JVM."""
    ship(SparkSession.active())
    kind = ArrayType(StructType().add("key", StringType()).add("value", StringType()))

    def run(column):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        keys, values, starts, there = [], [], [0], []
        for x in column.to_pylist():
            there.append(xml_folds.scan(x, keys, values, most, bytes_))
            starts.append(len(keys))
        wanted = to_arrow_type(kind)
        flat = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], fields=list(wanted.value_type))
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat, type=wanted, mask=pa.array([not x for x in there], pa.bool_()))

    return F.arrow_udf(run, kind)(text)


def csv_header(first: str, second: str) -> tuple[str, list[str]] | None:
    """(delimiter, columns) when the first line of a file names columns and the second is a row of as many cells."""
    for d in (",", "\t", ";"):
        names, row = (next(csv.reader([x], delimiter=d)) for x in (first, second))
        names = [n.strip() for n in names]
        fine = all(re.fullmatch(r"[A-Za-z][A-Za-z0-9 _.\-/()]*", n) for n in names) and len({n.lower() for n in names}) == len(names)
        if len(names) >= 3 and fine and len(row) == len(names) and any(c.strip() for c in row) and "=" not in first:
            return d, names
    return None


def csv_pairs(text: Column, delimiter: str, names: list[str]) -> Column:
    """A row's cells by column name; null when it has another number of cells."""
    fields = ", ".join(f"`c{i}` string" for i in range(len(names)))
    row = F.from_csv(text, F.lit(f"{fields}, `more` string"), {"sep": delimiter})
    full = row[f"c{len(names) - 1}"].isNotNull() & row["more"].isNull()
    return F.when(full, F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[row[f"c{i}"] for i in range(len(names))])))


def line_format(text: Column) -> Column:
    """The plain format of a line: json, cef, leef, cef_syslog, syslog_kv, syslog, kv, unstructured or empty; the first that fits.

    A header is CEF with seven bars and LEEF with five; pairs are key=value words.
    """
    t = F.trim(F.translate(text, "\t\r\n", "   "))
    is_cef, is_leef, has_pair = (t.rlike(p) for p in (r"CEF:(?:[^|\\]|\\.)*(?:\|(?:[^|\\]|\\.)*){7}", r"LEEF:[^|]*(?:\|[^|]*){5}", r"(?:^|[\s,;|])[A-Za-z_][\w.\-]*="))
    envelope = t.rlike(r"^<\d{1,3}>")
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "empty").when(t.startswith("{") & t.endswith("}") & F.try_parse_json(t).isNotNull(), "json")
        .when(is_cef, F.when(envelope, "cef_syslog").otherwise("cef")).when(is_leef, "leef").when(envelope & has_pair, "syslog_kv").when(envelope, "syslog")
        .when(has_pair, "kv").otherwise("unstructured")
    )


# Encoders


def to_cef(vendor: Column, product: Column, version: Column, class_id: Column, name: Column, severity: Column, ext: dict[str, Column]) -> Column:
    head = lambda c: F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    value = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\=")), F.lit("\n"), F.lit("\\n"))
    pairs = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), value(c))) for k, c in ext.items()]
    return F.concat_ws("|", F.lit("CEF:0"), *map(head, (vendor, product, version, class_id, name, severity)), F.concat_ws(" ", *pairs))


def to_leef(vendor: Column, product: Column, version: Column, event_id: Column, ext: dict[str, Column]) -> Column:
    clean = lambda c: F.translate(c.cast("string"), "\t\r\n", "   ")
    pairs = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}="), clean(c))) for k, c in ext.items()]
    return F.concat_ws("|", F.lit("LEEF:1.0"), vendor, product, version, event_id, F.concat_ws("\t", *pairs))


def to_rfc5424(pri: Column, time_ms: Column, host: Column, app: Column, message: Column, sd: dict[str, Column] | None = None) -> Column:
    value = lambda c: F.regexp_replace(c.cast("string"), r'(["\\\]])', r"\\$1")
    pairs = [F.when(c.isNotNull(), F.concat(F.lit(f' {k}="'), value(c), F.lit('"'))) for k, c in (sd or {}).items()]
    data = F.concat(F.lit("[event@32473"), F.concat_ws("", *pairs), F.lit("]")) if sd else F.lit("-")
    at = F.date_format(F.timestamp_millis(time_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.concat(F.lit("<"), pri.cast("string"), F.lit(">1 "), F.concat_ws(" ", at, F.coalesce(host, F.lit("-")), F.coalesce(app, F.lit("-")), F.lit("- -"), data, message))


def to_gelf(host: Column, short: Column, time_ms: Column, level: Column, extra: dict[str, Column]) -> Column:
    return F.to_json(F.struct(F.lit("1.1").alias("version"), host.alias("host"), short.alias("short_message"), (time_ms / 1000).alias("timestamp"), level.alias("level"), *[c.alias(f"_{k}") for k, c in extra.items()]))
