import pytest
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import text as tx
from sentrylake.operators import infer, learned, ocsf, packs
from sentrylake.sources import inbound

NOW = 1767398400000  # 2026-01-03
LINES = {
    "fortinet_fortigate": ('date=2026-01-02 time=03:04:05 devname="FG1" logid="1" type="traffic" subtype="forward" srcip=10.1.1.2 srcport=5151 dstip=198.51.100.9 dstport=443 proto=6 action="deny" sentbyte=120', (4001, 5, "10.1.1.2", 5151, "198.51.100.9", 443)),
    "cisco_asa": ("Jan  2 03:04:05 fw1 %ASA-6-302013: Built outbound TCP connection 77 for outside:198.51.100.1/443 (198.51.100.1/443) to inside:10.0.0.3/50000 (203.0.113.1/50000)", (4001, 1, "10.0.0.3", 50000, "198.51.100.1", 443)),
    "pfsense_filterlog": ("Jan  2 03:04:05 pf filterlog[1]: 5,,,1,em0,match,block,in,4,0x0,,64,1,0,DF,6,tcp,60,203.0.113.4,10.7.7.1,4000,22,0,S", (4001, 5, "203.0.113.4", 4000, "10.7.7.1", 22)),
    "zeek_json": ('{"ts":1767323045.1,"id.orig_h":"10.9.9.1","id.orig_p":5,"id.resp_h":"198.51.100.2","id.resp_p":53,"proto":"udp"}', (4001, 6, "10.9.9.1", 5, "198.51.100.2", 53)),
    "snort_alert": ("01/02-03:04:05.1 [**] [1:2001:3] ET SCAN X [**] [Priority: 2] {TCP} 203.0.113.5:1 -> 10.4.4.1:22", (2004, 1, "203.0.113.5", 1, "10.4.4.1", 22)),
    "windows_security": ("<Event xmlns='x'><System><EventID>4625</EventID><Computer>dc1</Computer></System><EventData><Data Name='TargetUserName'>bob</Data><Data Name='IpAddress'>::ffff:10.0.0.8</Data><Data Name='IpPort'>0</Data></EventData></Event>", (3002, 1, "10.0.0.8", None, None, None)),
    "juniper_srx": ("<14>1 2026-01-02T03:04:05Z srx RT_FLOW - RT_FLOW_SESSION_DENY [junos@2636 source-address=\"10.3.3.1\" source-port=\"99\" destination-address=\"198.51.100.7\" destination-port=\"22\" protocol-id=\"6\" policy-name=\"p\"] session denied", (4001, 5, "10.3.3.1", 99, "198.51.100.7", 22)),
    "sophos_firewall": ('device="SFW" log_type="Firewall" log_component="Firewall Rule" log_subtype="Denied" src_ip=10.5.5.1 src_port=1 dst_ip=198.51.100.8 dst_port=53 protocol="UDP"', (4001, 5, "10.5.5.1", 1, "198.51.100.8", 53)),
}


def one(spark, line, column):
    return spark.createDataFrame([(line,)], "t string").select(column.alias("x")).first().x


def test_packs_read_their_lines(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in LINES.items()] + [("none", "hello"), ("none", ""), ("null", None)], "name string, t string")
    for r in df.select("name", packs.parse(F.col("t")).alias("p")).collect():
        if r.name in LINES:
            p = r.p
            assert p.pack == r.name
            assert (p.class_uid, p.activity_id, p.src_ip, p.src_port, p.dst_ip, p.dst_port) == LINES[r.name][1]
        else:
            assert r.p is None


ASA = {  # number and text: class, activity, source, port, destination, port, protocol, action, user, rule
    "302013 in": ("Built inbound TCP connection 9 for outside:198.51.100.9/5000 (198.51.100.9/5000) to dmz:10.0.0.4/443 (203.0.113.4/443)", (4001, 1, "198.51.100.9", 5000, "10.0.0.4", 443, "TCP", "allow", None, None)),
    "302015 six": ("Built outbound UDP connection 9 for outside:2001:db8::5/53 (2001:db8::5/53) to inside:2001:db8::9/4000 (2001:db8::9/4000)", (4001, 1, "2001:db8::9", 4000, "2001:db8::5", 53, "UDP", "allow", None, None)),
    "302013 names": ("Built outbound TCP connection 5 for outside:UpdateHost/443 (x/443)(LOCAL\\ann) to inside:10.0.0.7/50123 (10.0.0.7/50123)", (4001, 1, "10.0.0.7", 50123, None, 443, "TCP", "allow", None, None)),
    "302013 side": ("Built inside TCP connection 9 for outside:198.51.100.9/5000 to dmz:10.0.0.4/443", (0, 99, None, None, None, None, None, None, None, None)),
    "302014": ("Teardown TCP connection 9 for outside:198.51.100.9/5000 to dmz:10.0.0.4/443 duration 0:00:30 bytes 4500 TCP FINs", (4001, 2, None, None, None, None, "TCP", "allow", None, None)),
    "302020": ("Built inbound ICMP connection for faddr 198.51.100.9/0(LOCAL\\ann) gaddr 203.0.113.4/7 laddr 10.0.0.4/7 type 8 code 0", (4001, 1, "198.51.100.9", 0, "10.0.0.4", 7, "ICMP", "allow", None, None)),
    "302021": ("Teardown ICMP connection for faddr 198.51.100.9/0 gaddr 203.0.113.4/7 laddr 10.0.0.4/7", (4001, 2, None, None, None, None, "ICMP", "allow", None, None)),
    "302017": ("Built GRE connection 12 from outside:198.51.100.9 (198.51.100.9) to inside:10.0.0.4/3 (10.0.0.4/3)", (4001, 1, "198.51.100.9", None, "10.0.0.4", 3, "GRE", "allow", None, None)),
    "305011": ("Built dynamic TCP translation from inside:10.0.0.4/4000 to outside:203.0.113.4/61000", (4001, 1, "10.0.0.4", 4000, None, None, "TCP", "allow", None, None)),
    "106016": ("Deny IP spoof from (10.9.9.9) to 203.0.113.4 on interface outside", (2004, 1, "10.9.9.9", None, "203.0.113.4", None, None, "deny", None, "106016")),
    "304001": ("10.0.0.4 Accessed URL 198.51.100.9:/index.html?a=1", (4001, 6, "10.0.0.4", None, "198.51.100.9", None, None, "allow", None, None)),
    "106023": ('Deny tcp src outside:198.51.100.9/5000(LOCAL\\ann) dst dmz:10.0.0.4/22 by access-group "edge in" [0x0, 0x0]', (4001, 5, "198.51.100.9", 5000, "10.0.0.4", 22, "TCP", "deny", None, "edge in")),
    "106023 icmp": ('Deny icmp src outside:198.51.100.9 dst dmz:10.0.0.4 (type 8, code 0) by access-group "edge"', (4001, 5, "198.51.100.9", None, "10.0.0.4", None, "ICMP", "deny", None, "edge")),
    "106001": ("Inbound TCP connection denied from 198.51.100.9/5000 to 10.0.0.4/22 flags SYN on interface outside", (4001, 5, "198.51.100.9", 5000, "10.0.0.4", 22, "TCP", "deny", None, None)),
    "106006": ("Deny inbound UDP from 198.51.100.9/5000 to 10.0.0.4/53 on interface outside", (4001, 5, "198.51.100.9", 5000, "10.0.0.4", 53, "UDP", "deny", None, None)),
    "106015": ("Deny TCP (no connection) from 198.51.100.9/5000 to 10.0.0.4/22 flags RST on interface outside", (4001, 5, "198.51.100.9", 5000, "10.0.0.4", 22, "TCP", "deny", None, None)),
    "106100": ("access-list acl_in denied tcp outside/198.51.100.9(5000) -> inside/10.0.0.4(22) hit-cnt 1 first hit [0x1, 0x0]", (4001, 5, "198.51.100.9", 5000, "10.0.0.4", 22, "TCP", "deny", None, "acl_in")),
    "106100 ok": ("access-list acl_in permitted udp outside/198.51.100.9(5000)(LOCAL\\ann) -> inside/10.0.0.4(53) hit-cnt 1", (4001, 6, "198.51.100.9", 5000, "10.0.0.4", 53, "UDP", "allow", None, "acl_in")),
    "710003": ("TCP access denied by ACL from 198.51.100.9/5000 to outside:203.0.113.4/22", (4001, 5, "198.51.100.9", 5000, "203.0.113.4", 22, "TCP", "deny", None, None)),
    "400013": ("IPS:2003 ICMP redirect from 198.51.100.9 to 203.0.113.4 on interface outside", (2004, 1, "198.51.100.9", None, "203.0.113.4", None, None, None, None, "2003")),
    "733100": ("[ Scanning] drop rate-1 exceeded. Current burst rate is 9 per second", (2004, 1, None, None, None, None, None, None, None, "733100")),
    "113004": ("AAA user authentication Successful : server = 10.0.0.5 : user = ann", (3002, 1, None, None, "10.0.0.5", None, None, "success", "ann", None)),
    "113015": ("AAA user authentication Rejected : reason = Invalid password : local database : user = bob : user IP = 198.51.100.9", (3002, 1, "198.51.100.9", None, None, None, None, "failure", "bob", None)),
    "113039": ("Group <G> User <ann> IP <198.51.100.9> AnyConnect parent session started.", (3002, 1, "198.51.100.9", None, None, None, None, "success", "ann", None)),
    "716002": ("Group <G> User <ann> IP <198.51.100.9> WebVPN session terminated: User Requested.", (3002, 2, "198.51.100.9", None, None, None, None, "success", "ann", None)),
    "611102": ("User authentication failed: IP address: 198.51.100.9, Uname: bob", (3002, 1, "198.51.100.9", None, None, None, None, "failure", "bob", None)),
    "611103": ("User logged out: Uname: ann", (3002, 2, None, None, None, None, None, "success", "ann", None)),
    "605004": ('Login denied from 198.51.100.9/5000 to outside:203.0.113.4/ssh for user "bob"', (3002, 1, "198.51.100.9", 5000, "203.0.113.4", None, None, "failure", "bob", None)),
    "199999": ("Something else", (0, 99, None, None, None, None, None, None, None, None)),
}


def test_asa_messages(spark):
    lines = [(k, f"<166>Jan  2 03:04:05 fw1 %ASA-4-{k[:6]}: {text}") for k, (text, _) in ASA.items()]
    for r in spark.createDataFrame(lines, "k string, t string").select("k", packs.parse(F.col("t")).alias("p")).collect():
        p = r.p
        assert (r.k, (p.class_uid, p.activity_id, p.src_ip, p.src_port, p.dst_ip, p.dst_port, p.protocol, p.action, p.user_name, p.rule)) == (r.k, ASA[r.k][1])
        assert (p.severity, p.device_hostname) == ("medium", "fw1")
        assert p.dst_hostname == ("UpdateHost" if r.k == "302013 names" else None) and p.bytes_total == (4500 if r.k == "302014" else None)
        assert p.signature == {"106016": "IP spoofing attempt denied", "733100": "Threat detection: Scanning drop rate exceeded", "400013": "ICMP redirect"}.get(r.k)


def test_event_collector_bodies(spark):
    bodies = ['{"event":"a} {b \\" } {"}', '{"event":{"_raw":"x"}}\n {"event":"y","host":"h"}', '{"event":1} {"no":1}', '{"event"', "", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    assert sorted((r.i, r.raw, r.host) for r in inbound.hec_events(df).collect()) == [(0, 'a} {b " } {', None), (1, "x", None), (1, "y", "h")]
    assert sorted(r.i for r in inbound.hec_refused(df).collect()) == [2, 3, 4, 5]


def test_keys_that_differ_in_case(spark):
    row = one(spark, "SRC=10.0.0.1 src=10.0.0.2 Dst=10.0.0.3 DST=10.0.0.4 x", ocsf.canonical(fm.kv(F.col("t")), F.col("t")))
    assert (row.src_ip, row.dst_ip, row.class_uid) == ("10.0.0.2", "10.0.0.3", 4001)


def test_contract_columns(spark):
    events = spark.createDataFrame(
        [(7, 8, 4001, "Network Activity", "Network Activity", 2, "Low", 1767323045123, "deny", "denied", None, "10.0.0.1", 5, None, None, "tcp", None, 3, 4, "cisco_asa", "raw line", "outbound")],
        "event_id long, sequence_num long, class_uid int, class_name string, category_name string, severity_id int, severity string, time long, action string, disposition string, status string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, user_name string, bytes_in long, bytes_out long, parser string, raw_text string, direction string",
    )
    out = ocsf.contract(ocsf.export(events))
    assert dict(out.dtypes) == {k: v.replace("long", "bigint") for k, v in ocsf.CONTRACT.items()} and out.columns == list(ocsf.CONTRACT) and len(out.columns) == 40
    r = out.first()
    assert (r.activity_name, r.direction_id, r.vendor, r.product, r.fields_verified, r.src_hostname, r.event_time) == ("Traffic", 2, "Cisco", "ASA", True, None, "2026-01-02T03:04:05.123Z")
    assert len(r.raw_sha256) == 64 and '"class_uid":4001' in r.ocsf and "raw_text" not in r.ocsf


def test_a_drifted_positional_line_is_not_believed(spark):
    drifted = LINES["pfsense_filterlog"][0].replace("203.0.113.4,", "x,203.0.113.4,")
    assert one(spark, drifted, packs.parse(F.col("t"))) is None


def test_cef_escapes_and_duplicates(spark):
    line = r"CEF:0|A\|B|P|1|9|name|7|src=10.0.0.1 msg=two words a\=b src=10.0.0.2"
    c = one(spark, line, fm.cef(F.col("t")))
    assert c.vendor == "A|B" and c.ext == {"msg": "two words a=b", "src": "10.0.0.2"}


@pytest.mark.parametrize(("value", "want"), [("10.0.0.1", "10.0.0.1"), ("[10.0.0.1]", "10.0.0.1"), ("10.0.0.01", None), ("256.1.1.1", None), ("::1", "::1"), ("2001:DB8::1", "2001:db8::1"), ("host", None), (None, None)])
def test_addresses(spark, value, want):
    assert one(spark, value, tx.as_ip(F.col("t"))) == want


def test_values(spark):
    assert one(spark, "65536", tx.as_port(F.col("t"))) is None and one(spark, " 80 ", tx.as_port(F.col("t"))) == 80
    assert one(spark, "17", tx.as_protocol(F.col("t"))) == "UDP" and one(spark, "tcp", tx.as_protocol(F.col("t"))) == "TCP"
    assert one(spark, "allowed then denied", tx.as_action(F.col("t"))) is None and one(spark, "Deny.", tx.as_action(F.col("t"))) == "denied"
    assert one(spark, "-", tx.as_user(F.col("t"))) is None and one(spark, "bob", tx.as_user(F.col("t"))) == "bob"


def test_times(spark):
    at = lambda s: one(spark, s, tx.read_time(F.col("t"), NOW))
    assert at("2026-01-02T03:04:05Z") == at("2026-01-02 03:04:05") == at("1767323045") == at("1767323045000") == at("Jan  2 03:04:05") == 1767323045000
    assert at("Dec 30 00:00:00") == 1767052800000  # last year, as it would lie ahead
    assert at("2027-01-01 00:00:00") is None and at("nonsense") is None


def test_envelope(spark):
    e = one(spark, '<165>1 2026-01-02T03:04:05Z host app 7 ID [x@1 k="a\\"b\\]" z="2"] message', fm.envelope(F.col("t")))
    assert (e.facility, e.severity, e.hostname, e.app, e.message) == (20, 5, "host", "app", "message")
    assert e.sd == {"x@1.k": 'a"b]', "x@1.z": "2"}
    e = one(spark, "<13>Jan  2 03:04:05 host sshd[9]: hi", fm.envelope(F.col("t")))
    assert (e.hostname, e.app, e.procid, e.message) == ("host", "sshd", "9", "hi")
    assert one(spark, "plain", fm.envelope(F.col("t"))).message == "plain"


def test_masks(spark):
    assert one(spark, 'user "a b" from 10.0.0.1 id 0xFF7 n=55 deadbeef1 www.ex.org', tx.mask(F.col("t"))) == "user <Q> from <IP> id <HEX> n=<N> <X> <HOST>"
    assert one(spark, "Deny tcp from", F.array_join(tx.mask_words(F.col("t")), " ")) == "<ACTION> <PROTO> from"


def test_xml_with_doctype_is_refused(spark):
    assert one(spark, "<!DOCTYPE x><a>1</a>", fm.xml_pairs(F.col("t"))) is None
    assert one(spark, "<a b='2'><c>1</c></a>", fm.xml_pairs(F.col("t"))) == {"b": "2", "c": "1"}


def test_csv_headers():
    assert fm.csv_header("timestamp,src_ip,dst_ip", "1,2,3") == (",", ["timestamp", "src_ip", "dst_ip"])
    assert fm.csv_header("a;b;c", "1;2;3")[0] == ";"
    for first, second in (("1,2,3", "4,5,6"), ("a,b", "1,2"), ("a,a,b", "1,2,3"), ("a=1,b=2,c=3", "1,2,3"), ("a,b,c", "1,2"), ("a,b,c", ",,")):
        assert fm.csv_header(first, second) is None


def test_key_roles():
    assert infer.key_role("sourceAddress") == ("src_ip", 0.95) and infer.key_role("clientPort") == ("src_port", 0.85) and infer.key_role("destaddr") == ("dst_ip", 0.85)
    want = {"client": "src_ip", "event.src": "src_ip", "log_time": "time", "device_severity": "severity", "attack_info": "signature", "sip": "src_ip", "dip": "dst_ip", "serverport": "dst_port", "clientip": "src_ip", "request.status": "action"}
    assert {k: infer.key_role(k)[0] for k in want} == want
    for key in ("device_ip", "deviceIp", "sensor_ip", "system_ip", "data_port", "EventData.IpAddress", "EventData.IpPort", "time_taken_elapsed", "user_name_x", "src_user"):
        assert infer.key_role(key) is None
    assert infer.key_role("nat_src_ip") is None and infer.key_role("banana") is None and infer.key_role("srcmac") is None


def test_conflicting_pairs_are_not_filled(spark):
    df = spark.createDataFrame([(1, {"src": "10.0.0.1", "saddr": "10.0.0.2", "dst": "10.0.0.9"})], "event_id int, m map<string,string>")
    assert [(r.role, r.value) for r in infer.from_pairs(df).collect()] == [("dst_ip", "10.0.0.9")]


def test_learning_and_its_gates(spark):
    lines = [f"srcip=10.0.0.{i} dstip=198.51.100.{i} dstport={i + 20} action=deny user=u{chr(97 + i % 20)}x" for i in range(40)]
    train, held = learned.split(lines)
    assert len(train) == 28 and len(held) == 12 and not set(train) & set(held)
    frame = lambda x: spark.createDataFrame([(s,) for s in x], "line string")
    spec = learned.learn(frame(train), "acme")
    assert {s.role for s in spec.slots} == {"src_ip", "dst_ip", "dst_port", "action", "user"}
    result = learned.evaluate(spec, frame(held))
    assert result == {"lines": 12, "recognised": 1.0, "clean": 1.0}
    assert learned.approve(learned.Spec.from_json(spec.to_json()), result).status == "approved"
    text = learned.learn(frame([f"conn 10.0.0.{i} to 198.51.100.{i} denied" for i in range(12)]), "t")
    assert text.kind == "text" and all(s.needs_review for s in text.slots if s.role.endswith("ip"))
    with pytest.raises(ValueError):
        learned.approve(text, {"recognised": 1.0, "clean": 1.0})
    f = one(spark, "conn 10.0.0.5 to 198.51.100.77 allowed", learned.apply(text, F.col("t")))
    assert (f.src_ip, f.dst_ip, f.action) == ("10.0.0.5", "198.51.100.77", "allowed")


def test_mask_query_reads_all_documents(spark, tmp_path):
    import re

    import __spark_entry__ as e

    texts = [None, "", "plain words", 'said "hi 5" to \'me\'', "see http://a.b/c?d=1 and https://x", "10.0.0.1:80 or 1.2.3.4.5", "mac 00:1b:44:11:3A:b7 host a-1.example.org", "0xFF deadbeef1 beef 12 a1b", "line 1\nline 22"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    rules = [(r"\"[^\"]*\"|'[^']*'", "<Q>"), (r"\b[a-z][a-z0-9+.-]*://\S+", "<URL>"), (rf"(?<![\d.]){octet}(?:\.{octet}){{3}}(?![\d.])", "<IP>"), (r"\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b", "<MAC>"), (r"\b(?:[a-z0-9-]+\.)+[a-z]{2,}\b", "<HOST>"), (r"\b0x[0-9a-f]+\b", "<HEX>"), (r"\b(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]+\b", "<X>"), (r"\d+", "<N>")]

    def masked(t):
        for pattern, name in rules if t else []:
            t = re.sub(pattern, name, t, flags=re.I | re.A)
        return t

    got = {r.doc_id: r.masked for r in e.queries()["fun_07_mask_all"](spark, str(tmp_path)).collect()}
    assert got == {i: masked(t) for i, t in enumerate(texts)}
    assert all(any(f"<{m}>" in (v or "") for v in got.values()) for m in ("Q", "URL", "IP", "MAC", "HOST", "HEX", "X", "N"))
