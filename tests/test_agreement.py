"""Stores that agree or not, payloads, detector lines and files with headers, on small rows."""

from __future__ import annotations

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import json_folds
from sentrylake.operators import accounts, baseline, features, integrity, ocsf
from sentrylake.sources import inbound, payloads


def column(spark, text, made):
    return spark.createDataFrame([(text,)], "text string").select(made(F.col("text")).alias("x")).first()["x"]


def test_flatten_keeps_order_and_lists(spark):
    text = '{"a":{"b":{"c":1},"d":null},"l":[1,"x",true],"o":[{"k":1}],"n":[[1]],"e":{},"s":"{\\"q\\":1}"}'
    got = [tuple(p) for p in column(spark, text, payloads.flatten_json)]
    assert sorted(got, key=lambda p: p[0]) == [("a.b.c", "1"), ("a.d", None), ("l", "1, x, true"), ("s", '{"q":1}')]
    assert column(spark, "[1]", payloads.flatten_json) is None and column(spark, "no", payloads.flatten_json) is None
    deep = column(spark, '{"k":' * 200 + "1.50" + "}" * 200, payloads.flatten_json)
    assert [tuple(p) for p in deep] == [(".".join("k" * 200), "1.50")]
    assert [tuple(p) for p in column(spark, '{"z":1e2,"a":{"":{"b":-0.0}},"z":3}', payloads.flatten_json)] == [("z", "3"), ("a..b", "-0.0")]
    assert column(spark, '{"a":' * 200_000 + "1" + "}" * 200_000, payloads.flatten_json) is None


def test_prune_drops_empty_members_to_the_top(spark):
    prune = lambda t: json.loads(column(spark, t, payloads.prune_json))
    assert prune('{"a":null,"b":{"c":"","d":{"e":[]}},"f":1,"g":"x,\\"h\\":null"}') == {"f": 1, "g": 'x,"h":null'}
    assert prune('{"a":{"b":{"c":{"d":{"e":{"f":{}}}}}},"x":1}') == {"x": 1} and prune('{"l":[{}, {"a":null}, "", [], [[]], 0, false]}') == {"l": [{}, [], 0, False]}
    assert column(spark, '{"n":1.50,"é":[]}', payloads.prune_json) == '{"n":1.50}' and column(spark, "{", payloads.prune_json) is None
    assert prune('{"a":1,"b":""}') == {"a": 1} and prune('{"a":""}') == {}


JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.text("ab.\"\\é{}[],:", max_size=4)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text("abé.", max_size=2), x, max_size=3)), max_leaves=20)


def pruned(v):
    """``json_folds.prune`` in plain recursion."""
    empty = lambda x: x is None or x == "" or x == {} or x == []
    if isinstance(v, dict):
        return {k: x for k, x in ((k, pruned(x)) for k, x in v.items()) if not empty(x)}
    return [pruned(x) for x in v if not empty(x)] if isinstance(v, list) else v


def flattened(v, path=""):
    """``json_folds.flatten`` in plain recursion."""
    for k, x in v.items():
        name = f"{path}.{k}" if path else k
        if isinstance(x, dict):
            yield from flattened(x, name)
        elif isinstance(x, list):
            if x and not any(isinstance(y, (dict, list)) for y in x):
                yield name, ", ".join("null" if y is None else str(y).lower() if isinstance(y, bool) else str(y) for y in x)
        else:
            yield name, None if x is None else str(x).lower() if isinstance(x, bool) else str(x)


@settings(max_examples=400, deadline=None)
@given(value=JSON)
def test_folds_equal_plain_recursion(value):
    text = json.dumps(value, ensure_ascii=False)
    assert json_folds.prune(text) == json.dumps(pruned(value), ensure_ascii=False, separators=(",", ":"))
    got = json_folds.flatten(text)
    assert (got is None) if not isinstance(value, dict) else [tuple(p.values()) for p in got] == list(flattened(value))


def test_bulk_answers(spark):
    rows = spark.createDataFrame([(s,) for s in (200, 201, 400, 409, 429, 503, None)], "status int")
    got = [r[0] for r in rows.select(payloads.bulk_outcome(F.col("status"))).collect()]
    assert got == ["delivered", "delivered", "rejected", "delivered", "retry", "retry", "delivered"]


def test_payloads_of_an_event_that_says_little(spark):
    shape = (
        "sequence_num long, time long, src_ip string, src_port int, dst_ip string, dst_port int, device_hostname string, sender_ip string, class_uid int, class_name string, "
        "activity_name string, severity_id int, severity string, action string, finding_title string, user_name string, vendor string, product string, event_uid string, ocsf string"
    )
    row = spark.createDataFrame([(1,) + (None,) * 18 + ("{}",)], shape)
    for name in payloads.OUTPUTS:
        assert payloads.shaped(row, name).count() == 1
    assert json.loads(payloads.shaped(row, "otlp_http").first()["value"])["resourceLogs"][0]["scopeLogs"][0]["logRecords"][0]["severityText"] == "UNSPECIFIED"
    assert payloads.shaped(row, "splunk_hec").first()["value"].startswith('{"time":0.000,"host":"sentrylake"')
    with pytest.raises(ValueError):
        payloads.shaped(row, "pigeon")


def test_witness_takes_runs_and_refuses_the_rest(spark):
    held = spark.createDataFrame([("a", 1, "h1")], "log_id string, idx long, digest string")
    asked = [("a", 1, integrity.GENESIS, "h1"), ("a", 1, "x", "other"), ("a", 2, "h1", "h2"), ("a", 3, "h2", "h3"), ("a", 5, "h4", "h5"), ("b", 1, integrity.GENESIS, "b1"), ("b", 2, "no", "b2"), ("b", 3, "b2", "b3"), ("c", 2, "c1", "c2")]
    got = accounts.cosign(held, spark.createDataFrame(asked, "log_id string, idx long, prev string, digest string"))
    assert {(r["log_id"], r["digest"]): r["verdict"] for r in got.collect()} == {
        ("a", "h1"): "signed before", ("a", "other"): "another digest is signed", ("a", "h2"): "signed", ("a", "h3"): "signed", ("a", "h5"): "not the next index",
        ("b", "b1"): "signed", ("b", "b2"): "does not extend", ("b", "b3"): "not the next index", ("c", "c2"): "not the next index",
    }


def test_batches_chain_from_a_head_and_verify(spark):
    rows = [(b, "siem", "delivered", "live", b * 10, s, f"u{s}") for b in (1, 2, 3) for s in range(b * 10, b * 10 + b)]
    sent = spark.createDataFrame(rows, "batch_id long, output string, outcome string, trigger string, at long, sequence_num long, event_uid string")
    made = accounts.delivery_batches(sent)
    got = [r.asDict() for r in made.orderBy("id").collect()]
    prev = integrity.GENESIS
    for r in got:
        events = hashlib.sha256("\n".join(f"{s}:u{s}" for s in range(r["id"] * 10, r["id"] * 10 + r["id"])).encode()).hexdigest()
        assert r["prev_hash"] == prev and r["events_hash"] == events
        prev = hashlib.sha256(f"{prev}:siem:delivered:live:{r['id'] * 10}:{r['id']}:{events}".encode()).hexdigest()
        assert r["batch_hash"] == prev
    assert integrity.verify_deliveries(made, sent.select("batch_id", "sequence_num", "event_uid", "outcome")).count() == 0
    assert accounts.delivery_batches(sent.filter("false")).count() == 0


def test_counts_of_empty_stores(spark):
    none = spark.createDataFrame([], "transport string")
    got = accounts.pipeline_counts(none, none, none, none).first().asDict()
    assert got["events"] == 0 and got["streamed"] == 0 and got["consistent"]
    e = spark.createDataFrame([], "event_id string, superseded_by string, revises string")
    assert accounts.revision_check(e, spark.createDataFrame([], "event_id string, supersedes string")).first()["consistent"]


def test_sender_hosts_forget_nothing(spark):
    rows = [(1, "p", "V", None), (2, "p", "V", "fw1"), (3, "p", "V", None), (4, "p", "V", "fw2"), (5, "p", "V", None), (6, "p", "Unknown", "fw3"), (7, "p", "Unknown", ""), (8, "q", "V", "-bad")]
    lines = spark.createDataFrame(rows, "at long, peer_ip string, vendor string, hostname string").withColumn("product", F.lit("x"))
    got = {r["at"]: r["device"] for r in accounts.sender_hosts(lines, F.col("hostname")).collect()}
    assert got == {1: None, 2: "fw1", 3: "fw1", 4: "fw2", 5: None, 6: "fw3", 7: None, 8: None}


def test_headers_need_two_lines_with_text(spark):
    rows = [("a", 1, ""), ("a", 2, "id,host,user"), ("a", 3, "1,h,u"), ("b", 1, "id,host,user"), ("c", 1, "x=1,b,c"), ("c", 2, "1,2,3")]
    got = inbound.csv_lines(spark.createDataFrame(rows, "path string, pos long, line string")).collect()
    assert {(r["path"], r["pos"]): (r["is_header"], r["names"]) for r in got} == {
        ("a", 1): (False, None), ("a", 2): (True, None), ("a", 3): (False, ["id", "host", "user"]), ("b", 1): (False, None), ("c", 1): (False, None), ("c", 2): (False, None),
    }


def test_plain_formats(spark):
    lines = {None: "empty", "{bad}": "unstructured", "CEF:0|a|b": "unstructured", "<13>x CEF:0|a|b|c|d|e|f|g": "cef_syslog", "LEEF:1.0|a|b|c|d|": "leef", "k=v": "kv"}
    for text, kind in lines.items():
        assert column(spark, text, fm.line_format) == kind


def test_flag_line_is_read_back(spark):
    shape = "entity_type string, entity string, window_start_ms long, feature string, value double, median double, highest double, spread double, spread_from string, z double, history long, baseline string, min_excess double"
    found = spark.createDataFrame([
        ("user", "bob", 300000, "auth_failures", 12.0, 1.5, 3.0, 1.0, "mad", 10.5, 9, "own history", 5.0), ("user", "bob", 300000, "distinct_src_ips", 8.0, 1.0, 1.0, 0.0, "none", None, 9, "peers", 5.0),
    ], shape)
    line = baseline.flag_lines(found).first()["line"]
    held = json.loads(line)
    assert list(held) == sorted(held) and held["title"] == "Unusual failed logins and number of source addresses for user bob"
    assert held["summary"] == "12 failed logins in 5 min; its 9 earlier windows: median 1.5, highest 3, robust z 10.5; 8 source addresses in 5 min; all peers' 9 earlier windows: median 1, highest 1"
    assert held["reasons"][1]["z"] is None and held["window_end"] == "1970-01-01T00:10:00Z"
    back = baseline.read_lines(spark.createDataFrame([(line,), ("{}",), ("text",)], "line string")).collect()
    assert [(r["user_name"], r["src_ip"], r["time"], r["finding_uid"]) for r in back] == [("bob", None, 600000, held["finding_uid"])]


def test_labels_and_loose_rows(spark):
    row = spark.createDataFrame([(["x.k=1", "n.k=v=w", "n.e="],)], "labels array<string>")
    assert tuple(row.select(ocsf.label(F.col("labels"), "k", "n"), ocsf.label(F.col("labels"), "e", "n"), ocsf.label(F.col("labels"), "z", "n")).first()) == ("v=w", None, None)
    got = features.coerce(spark.createDataFrame([("x", "1.1.1.1", 5)], "dst_port string, sender_ip string, more int")).first()
    assert got["dst_port"] is None and got["device"] == "1.1.1.1" and got["fields_verified"] is False and got["time"] is None
