import json

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import archive, candidates, correlate
from sentrylake.sources import catalogue


def sources(spark, *rows):
    return spark.createDataFrame([(i, n, "v", "p", "kv", "firewall", None, True, at) for i, n, at in rows], catalogue.FIELDS)


def test_the_catalogue_keeps_the_last_state_of_each_source(spark, tmp_path):
    c = catalogue.Catalogue(spark, str(tmp_path / "c"))
    assert c.listed().count() == 0
    c.create(sources(spark, ("a", "one", 1), ("b", "two", 2)))
    with pytest.raises(ValueError, match="b"):
        c.create(sources(spark, ("b", "again", 3), ("z", "new", 3)))
    with pytest.raises(ValueError, match="q"):
        c.create(sources(spark, ("q", "x", 3), ("q", "y", 3)))
    c.remove(spark.createDataFrame([("a",), ("nobody",)], "id string"))
    assert [r.id for r in c.listed().collect()] == ["b"] and c.get("a").count() == 0
    c.create(sources(spark, ("a", "one more", 5)))
    events = spark.createDataFrame([("a", 10), ("a", 30), (None, 7)], "source_id string, time long")
    got = [(r.id, r.name, r.description, r.event_count, r.last_event_at) for r in c.listed(events).collect()]
    assert got == [("a", "one more", "", 2, 30), ("b", "two", "", 0, None)]


def test_lines_register_what_is_new_once(spark, tmp_path):
    c = catalogue.Catalogue(spark, str(tmp_path / "c"))
    kind = "seq long, static_name string, hint_name string, vendor string, product string, device string, peer_ip string, input_name string, transport string, format_type string, category string"
    rows = [
        (1, "office", "hint", "Cisco", "Cisco ASA", "fw1", "1.1.1.1", "udp", "syslog", "cisco_asa", None), (2, None, "hint", None, None, None, None, "udp", "syslog", None, "vpn"), (3, None, None, "Cisco", "Cisco ASA", None, "1.1.1.1", "udp", "syslog", "cisco_asa", None),
        (4, None, None, "Cisco", "ISE", "fw1", "1.1.1.1", "udp", "syslog", "x", None), (5, None, None, None, None, None, None, "udp", "syslog", None, None), (6, None, None, None, None, None, None, "udp", "other", "y", None),
    ]
    records = catalogue.named(spark.createDataFrame(rows, kind))
    for now in (7, 8):
        c.register(records, now)
    got = {r.name: (r.category, r.format_type, r.created_at, r.description) for r in c.current().collect()}
    assert got == {
        "office": ("firewall", "cisco_asa", 7, "Auto-registered from syslog input 'udp' sender 1.1.1.1"), "hint": ("vpn", "unknown", 7, "Auto-registered from syslog input 'udp'"),
        "Cisco ASA (1.1.1.1)": ("firewall", "cisco_asa", 7, "Auto-registered from syslog input 'udp' sender 1.1.1.1"), "Cisco ISE (fw1)": ("network", "x", 7, "Auto-registered from syslog input 'udp' sender 1.1.1.1"),
        "Unknown Syslog device (udp)": ("network", "unknown", 7, "Auto-registered from syslog input 'udp'"),
    }
    ids = {r.seq: r.source_id for r in c.resolve(records).collect()}
    assert None not in ids.values() and len(set(ids.values())) == 5 and ids[5] == ids[6]


def test_archive_rows_have_the_columns_in_order_and_the_event_as_json(spark):
    from sentrylake.plans.queries import _exported

    made = archive.archive_rows(_exported(spark, "/root/testdata/sf0.001").limit(20))
    assert made.columns == list(archive.ARCHIVE) and [t for _, t in made.dtypes] == ["bigint" if t == "long" else t for t in archive.ARCHIVE.values()]
    for r in made.collect():
        told = json.loads(r.normalized_json)
        assert (told["class_uid"], told["time"], told["src_endpoint"]["ip"]) == (r.class_uid, r.time_epoch_ms, r.src_ip) and r.category_uid == r.class_uid // 1000


def test_canonical_events_hold_no_empty_values(spark):
    df = spark.createDataFrame([(None, "", {"a": "1", "b": "", "c": None})], "x string, y string, m map<string,string>")
    r = df.select(archive.canonical_event("V", "P", 2004, {"x": F.col("x"), "y": F.col("y"), "n": F.lit(0)}, F.col("m")).alias("e"), archive.canonical_event("V", "P", 0, {}).alias("none")).first()
    assert (r.e.fields, r.e.vendor_fields, r.e.activity_id) == ({"n": "0"}, {"a": "1"}, None) and (r.none.fields, r.none.vendor_fields) == ({}, None)


def test_exports_have_bounds_an_order_and_no_nan(spark, tmp_path):
    rows = [("b", 10, 0.5), ("a", 10, float("nan")), ("c", 5, None)]
    table = spark.createDataFrame(rows, "entity string, window_start_ms long, share double").repartition(3)
    assert [(r.entity, r.share) for r in archive.oldest_features(table).collect()] == [("c", None), ("a", None), ("b", 0.5)]
    archive.write_features(table, str(tmp_path / "j"), "json", 2)
    (part,) = (tmp_path / "j").glob("part-*")
    assert [json.loads(x) for x in part.read_text().splitlines()] == [{"entity": "c", "window_start_ms": 5, "share": None}, {"entity": "a", "window_start_ms": 10, "share": None}]
    for bad in (0, archive.FEATURE_ROWS + 1):
        with pytest.raises(ValueError):
            archive.oldest_features(table, bad)
    with pytest.raises(ValueError):
        archive.write_features(table, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError):
        archive.newest_ledger(table, table, 201)


def test_candidates_of_each_format_and_their_trial(spark):
    cases = {
        '{"src_ip":"1.2.3.4","dest_port":80,"event_type":"alert","x":1}': ("json", {"src_ip": candidates.SRC, "dest_port": candidates.DPT, "event_type": "activity_name"}),
        "CEF:0|A|B|1|7|n|5|src=1.2.3.4": ("cef", candidates.ALWAYS["cef"]), "LEEF:1.0|A|B|1|7|src=1.2.3.4\tusrName=bob": ("leef", candidates.ALWAYS["leef"]),
        "<13>Jan  2 03:04:05 h app: SrcIP=1.2.3.4 sport=9 suser=bob other=1": ("kv", {"SrcIP": candidates.SRC, "sport": candidates.SPT, "suser": candidates.USER}),
        "went 1.2.3.4 to 5.6.7.8": ("regex", {"src_ip": candidates.SRC, "dst_ip": candidates.DST}), "nothing here": ("regex", {"message": "unmapped.message"}),
    }
    for line, (kind, mappings) in cases.items():
        made = candidates.propose(spark, line, "n", "v", "p")
        assert (made.kind, made.mappings, made.status) == (kind, mappings, "candidate")
    assert candidates.propose(spark, next(iter(cases)), "n", "v", "p").transform("dest_port") == "int"
    with pytest.raises(ValueError):
        candidates.propose(spark, " \n", "n", "v", "p")
    ends = candidates.propose(spark, "went 1.2.3.4 to 5.6.7.8", "n", "v", "p")
    lines = spark.createDataFrame([("from 9.9.9.9 via x to 8.8.8.8",), ("one 1.1.1.1 only",), ("  ",), (None,)], "line string")
    tried = candidates.tested(ends, lines)
    got = {r.line: (r.passed, r.fields, r.error) for r in tried.collect()}
    assert got == {"from 9.9.9.9 via x to 8.8.8.8": (True, {"src_ip": "9.9.9.9", "dst_ip": "8.8.8.8"}, None), "one 1.1.1.1 only": (False, None, "Pattern did not match the line")}
    assert tuple(candidates.validation(tried).first()) == (2, 1, 1, 50.0) and candidates.unmapped(ends, tried).count() == 0
    assert tuple(candidates.validation(tried.limit(0)).first()) == (0, 0, 0, 0.0)
    json_lines = spark.createDataFrame([('{"src_ip":"1.1.1.1","zone":"a","_own":1}',), ("{broken",)], "line string")
    made = candidates.propose(spark, '{"src_ip":"1.2.3.4"}', "n", "v", "p")
    tried = candidates.tested(made, json_lines)
    assert [tuple(r) for r in candidates.unmapped(made, tried).collect()] == [("zone", 1)] and tried.filter("passed").count() == 1


def test_advice_once_in_order_and_always_the_last(spark):
    logins = spark.createDataFrame([(5, "1.1.1.1,2.2.2.2"), (3, "9.9.9.9"), (7, "9.9.9.9")], "login_id long, shared string")
    alerts = spark.createDataFrame([(1, "1.1.1.1,2.2.2.2")], "alert_id long, shared string")
    sweeps = spark.createDataFrame([("4.4.4.4", 2)], "src_ip string, event_id long")
    said = [r.text for r in correlate.recommendations(logins, alerts, sweeps).orderBy("pos").collect()]
    assert [x.split(";")[0] for x in said] == [
        "Confirm with the account owner that the session behind 9.9.9.9 was theirs", "Confirm with the account owner that the session behind 1.1.1.1, 2.2.2.2 was theirs",
        "Pull the sensor's payload for the alert between 1.1.1.1 and 2.2.2.2 and review the rule that allowed the connection.", "Check whether 4.4.4.4 is a known scanner", correlate.LAST_ADVICE,
    ]
    assert [tuple(r) for r in correlate.recommendations(logins.limit(0), alerts.limit(0), sweeps.limit(0)).collect()] == [(1, correlate.LAST_ADVICE)]
