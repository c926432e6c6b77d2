"""From parsed lines to typed events (OCSF classes), their strict export, its validation and the flat contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import text as tx

# Fixed values of the schema.
CLASSES = {4001: ("Network Activity", 4, "Network Activity"), 3002: ("Authentication", 3, "Identity & Access Management"), 2004: ("Detection Finding", 2, "Findings"), 0: ("Base Event", 0, "Uncategorized")}
SEVERITY_NAMES = {1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical"}
ACTION_IDS = {"allow": 1, "deny": 2, "drop": 2}
DISPOSITIONS = {"allowed": (1, "Allowed"), "denied": (2, "Blocked"), "dropped": (6, "Dropped"), "alert": (19, "Alert")}
STATUSES = {"success": (1, "Success"), "failure": (2, "Failure")}
DIRECTIONS = {"inbound": 1, "outbound": 2, "lateral": 3}
PROTOCOL_NUMBERS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "ah": 51, "ipv6-icmp": 58, "sctp": 132}
ALIASES = {
    "src_ip": ("src", "src_ip", "srcip", "source_ip", "saddr", "c-ip", "sourceAddress", "src_addr", "client_ip"),
    "src_port": ("spt", "src_port", "srcport", "sourcePort", "sport", "source_port", "client_port"),
    "dst_ip": ("dst", "dst_ip", "dstip", "destination_ip", "daddr", "cs-ip", "destinationAddress", "dst_addr", "server_ip"),
    "dst_port": ("dpt", "dst_port", "dstport", "destinationPort", "dport", "destination_port", "server_port"),
    "protocol": ("proto", "protocol", "transport", "protocol_name", "app", "proto_name"),
    "action": ("act", "action", "disposition", "status", "result", "outcome", "decision"),
    "user_name": ("user", "username", "suser", "duser", "src_user", "dst_user", "usrName", "account"),
    "bytes_in": ("bytes_in", "in_bytes", "rcvdbyte", "bytesIn", "inBytes", "bytes_received"),
    "bytes_out": ("bytes_out", "out_bytes", "sentbyte", "bytesOut", "outBytes", "bytes_sent"),
    "signature": ("signature", "rule_name", "attack", "threat_name", "alert", "event_name", "msg"),
    "severity": ("severity_raw", "severity", "level", "priority"),
    "time_text": ("timestamp", "time", "date", "rt", "deviceReceiptTime", "start"),
}


def _map(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), key)


def alias(fields: Column, lowered: Column, names: tuple[str, ...]) -> Column:
    """The first alias present, each in its own spelling first and then in any."""
    return F.coalesce(*[c for n in names for c in (F.try_element_at(fields, F.lit(n)), F.try_element_at(lowered, F.lit(n.lower())))])


def canonical(fields: Column, text: Column) -> Column:
    """A struct of canonical fields from a map of a line's pairs, with the class that the evidence in them gives."""
    # of keys that differ in case alone the first with a value counts
    there = F.reverse(F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull()))
    low = fm.last_wins(F.transform(there, lambda e: F.lower(e["key"])), F.transform(there, lambda e: e["value"]))
    got = {k: alias(fields, low, v) for k, v in ALIASES.items()}
    finding = F.coalesce(*[F.try_element_at(low, F.lit(k)) for k in ("alert", "signature", "threat_name", "attack", "ids_type")]).isNotNull()
    auth = got["user_name"].isNotNull() & text.rlike("(?i)login|logon|auth|vpn|session.open")
    uid = F.when(finding, 2004).when(auth, 3002).when(F.coalesce(got["src_ip"], got["dst_ip"]).isNotNull(), 4001).otherwise(0)
    return F.struct(uid.cast("int").alias("class_uid"), *[c.alias(k) for k, c in got.items()])


def normalise(parsed: DataFrame, now_ms: int, received: str = "received_at_ms") -> DataFrame:
    """Typed event columns of ``parsed``: event_id, sequence_num, raw_text, received time, and canonical fields (p.*).

    A port without an address or host on its side is not kept. A time that the device did not give is the arrival time, and
    ``time_source`` says so. Status is for authentication alone.
    """
    p = lambda c: F.col(f"p.{c}")
    act = tx.normal_action(F.coalesce(p("auth_status") if "auth_status" in parsed.select("p.*").columns else F.lit(None).cast("string"), p("action")))
    device_ms = tx.read_time(p("time_text"), now_ms)
    rows = parsed.select(
        "*", p("class_uid").alias("class_uid"), act["disposition"].alias("disposition"), act["action"].alias("action"), tx.normal_severity(p("severity")).cast("int").alias("severity_id"),
        F.coalesce(device_ms, F.col(received)).alias("time"), F.when(device_ms.isNotNull(), "device").otherwise("received").alias("time_source"),
    )
    status = F.when(F.col("class_uid") == 3002, F.when((F.col("disposition") == "allowed") | F.col("disposition").contains("success"), "success").when(F.col("disposition").isin("denied", "dropped") | F.col("disposition").contains("fail"), "failure"))
    side = lambda s: F.when(tx.as_ip(p(f"{s}_ip")).isNotNull(), tx.as_port(p(f"{s}_port").cast("string")))
    name = lambda i: _map({k: v[i] for k, v in CLASSES.items()}, F.col("class_uid"))
    return rows.select(
        "event_id", "sequence_num", "raw_text", "class_uid", name(0).alias("class_name"), name(1).alias("category_uid"), name(2).alias("category_name"), "severity_id", _map(SEVERITY_NAMES, F.col("severity_id")).alias("severity"),
        "time", "time_source", tx.as_ip(p("src_ip")).alias("src_ip"), side("src").alias("src_port"), tx.as_ip(p("dst_ip")).alias("dst_ip"), side("dst").alias("dst_port"), F.coalesce(tx.as_protocol(p("protocol")), F.upper(p("protocol"))).alias("protocol"),
        "action", "disposition", status.alias("status"), p("user_name").alias("user_name"), p("bytes_in").try_cast("long").alias("bytes_in"), p("bytes_out").try_cast("long").alias("bytes_out"),
        F.when(F.col("class_uid") == 2004, p("signature")).alias("finding_title"),
    )


def iso_millis(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


#: What strict events do not hold and the contract reads beside them.
CARRIED = (
    "time_source", "action", "direction", "src_hostname", "dst_hostname", "packets", "finding_title", "finding_uid", "vendor", "product", "device_hostname", "sender_ip", "parser", "parser_pack", "fields_verified",
    "raw_id", "raw_sha256", "raw_text",
)


def export(events: DataFrame) -> DataFrame:
    """Strict events: enumerated ids, observables and pruned endpoints. Control ids are for 4001 and 2004 alone. The CARRIED columns
    that ``events`` has stand beside them."""
    control = F.col("class_uid").isin(4001, 2004)
    activity = F.coalesce(F.col("activity_id"), F.lit(99)) if "activity_id" in events.columns else F.when(F.col("class_uid") == 0, 99).when(F.col("class_uid") == 4001, 6).otherwise(1)
    end = lambda s: F.when(F.coalesce(F.col(f"{s}_ip"), F.col(f"{s}_port").cast("string")).isNotNull(), F.struct(F.col(f"{s}_ip").alias("ip"), F.col(f"{s}_port").alias("port")))
    user = F.when(F.col("user_name").isNotNull(), F.col("user_name")).when(F.col("class_uid") == 3002, "unknown")
    seen = lambda c, name, i, t: F.when(c.isNotNull(), F.struct(F.lit(name).alias("name"), F.lit(i).alias("type_id"), F.lit(t).alias("type"), c.alias("value")))
    observables = F.array_compact(F.array(seen(F.col("src_ip"), "src_endpoint.ip", 2, "IP Address"), seen(F.col("dst_ip"), "dst_endpoint.ip", 2, "IP Address"), seen(F.col("user_name"), "user.name", 4, "User Name")))
    total = F.nullif(F.coalesce("bytes_in", F.lit(0)) + F.coalesce("bytes_out", F.lit(0)), F.lit(0))
    return events.select(
        "event_id", "sequence_num", "class_uid", "class_name", "category_name", activity.cast("int").alias("activity_id"), (F.col("class_uid") * 100 + activity).cast("int").alias("type_uid"), "severity_id", "severity", "time",
        F.when(control, _map(ACTION_IDS, F.lower("action"))).alias("action_id"), F.when(control, _map({k: v[0] for k, v in DISPOSITIONS.items()}, F.lower("disposition"))).alias("disposition_id"),
        F.when(control, _map({k: v[1] for k, v in DISPOSITIONS.items()}, F.lower("disposition"))).alias("disposition"), _map({k: v[0] for k, v in STATUSES.items()}, F.lower("status")).alias("status_id"),
        end("src").alias("src_endpoint"), end("dst").alias("dst_endpoint"), F.lower("protocol").alias("protocol_name"), _map(PROTOCOL_NUMBERS, F.lower("protocol")).alias("protocol_num"), "bytes_in", "bytes_out", total.alias("bytes"),
        user.alias("user"), observables.alias("observables"), *[c for c in CARRIED if c in events.columns],
    )


def violations(exported: DataFrame) -> DataFrame:
    """Exported events with the list of rules that they break."""
    v = lambda c, name: F.when(c, F.lit(name))
    found = F.array_compact(F.array(
        v(~F.col("class_uid").isin(*CLASSES), "class_uid"), v(F.col("type_uid") != F.col("class_uid") * 100 + F.col("activity_id"), "type_uid"), v(~F.col("severity_id").between(0, 6), "severity_id"),
        v(F.col("time").isNull() | (F.col("time") <= 0), "time"), v((F.col("class_uid") == 3002) & F.col("user").isNull(), "user"),
        v((F.col("class_uid") == 4001) & F.col("src_endpoint").isNull() & F.col("dst_endpoint").isNull(), "endpoints"),
    ))
    return exported.withColumn("violations", found)


#: The contract: its columns in order, with their types.
CONTRACT = {
    "time": "long", "event_time": "string", "time_source": "string", "class_uid": "int", "class_name": "string", "activity_id": "int", "activity_name": "string", "severity_id": "int", "severity": "string",
    "status_id": "int", "action_id": "int", "action": "string", "disposition_id": "int", "disposition": "string", "src_ip": "string", "src_port": "int", "src_hostname": "string", "dst_ip": "string", "dst_port": "int",
    "dst_hostname": "string", "protocol": "string", "protocol_num": "int", "direction_id": "int", "bytes_in": "long", "bytes_out": "long", "packets": "long", "user_name": "string", "finding_title": "string",
    "finding_uid": "string", "vendor": "string", "product": "string", "device_hostname": "string", "sender_ip": "string", "parser": "string", "fields_verified": "boolean", "sequence_num": "long", "event_uid": "string",
    "raw_id": "string", "raw_sha256": "string", "ocsf": "string",
}
ACTIVITIES = {(4001, 1): "Open", (4001, 2): "Close", (4001, 5): "Refuse", (4001, 6): "Traffic", (3002, 1): "Logon", (3002, 2): "Logoff", (2004, 1): "Create"}
PRODUCTS = {
    "paloalto_panos": ("Palo Alto Networks", "PAN-OS"), "fortinet_fortigate": ("Fortinet", "FortiGate"), "cisco_asa": ("Cisco", "ASA"), "checkpoint_log_exporter": ("Check Point", "Security Gateway"),
    "juniper_srx": ("Juniper", "SRX"), "sophos_firewall": ("Sophos", "Firewall"), "sonicwall_sonicos": ("SonicWall", "SonicOS"), "pfsense_filterlog": ("Netgate", "pfSense"), "suricata_eve": ("OISF", "Suricata"),
    "zeek_json": ("Zeek", "Zeek"), "snort_alert": ("Cisco", "Snort"), "windows_security": ("Microsoft", "Windows"),
}


def activity_name() -> Column:
    """The name of ``activity_id`` within its class."""
    name = F.when(F.col("activity_id") == 99, "Other").otherwise("Unknown")
    for (uid, number), known in ACTIVITIES.items():
        name = F.when((F.col("class_uid") == uid) & (F.col("activity_id") == number), known).otherwise(name)
    return name


def contract(exported: DataFrame) -> DataFrame:
    """The flat typed columns of CONTRACT that analytics read, whatever ``exported`` lacks being null; the stand-in user name is null
    again. Fields are verified where a pack read them without an error, unless the event says so itself."""
    has = set(exported.columns)
    col = lambda c: F.col(c) if c in has else F.lit(None)
    end = lambda s, f: F.col(f"{s}_endpoint.{f}")
    parser = F.coalesce(col("parser"), col("parser_pack"))
    made = {
        "event_time": iso_millis(F.col("time")), "activity_name": activity_name(),
        **{f"{s}_{f}": end(s, f) for s in ("src", "dst") for f in ("ip", "port")}, "protocol": F.col("protocol_name"), "direction_id": _map(DIRECTIONS, F.lower(col("direction").cast("string"))),
        "user_name": F.nullif("user", F.lit("unknown")), "vendor": F.coalesce(col("vendor"), _map({k: v[0] for k, v in PRODUCTS.items()}, parser.cast("string"))),
        "product": F.coalesce(col("product"), _map({k: v[1] for k, v in PRODUCTS.items()}, parser.cast("string"))), "parser": parser,
        "fields_verified": F.coalesce(col("fields_verified"), F.coalesce(parser != "parse_error", F.lit(False))), "event_uid": F.col("event_id"),
        "raw_sha256": F.coalesce(col("raw_sha256"), F.sha2(col("raw_text").cast("string"), 256)),
        "ocsf": F.to_json(F.struct(*[F.col(c) for c in exported.columns if c not in CARRIED])),
    }
    return exported.select(*[made.get(c, col(c)).cast(t).alias(c) for c, t in CONTRACT.items()])


def label(labels: Column, key: str, namespace: str) -> Column:
    """The value of the first ``namespace.key=value`` among an event's labels; null where it is empty or absent."""
    head = f"{namespace}.{key}="
    found = F.get(F.filter(labels, lambda x: x.startswith(head)), F.lit(0))
    return F.nullif(F.substring(found, F.lit(len(head) + 1), F.length(found)), F.lit(""))
