import hashlib
import statistics

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import analytics, baseline, correlate, features, integrity, search
from sentrylake.operators.registry import merge_templates
from sentrylake.sources import inbound, sinks
from sentrylake.streaming import pipeline

T0 = 1789948800000
COLUMNS = "time long, src_ip string, dst_ip string, dst_hostname string, dst_port int, bytes_in long, bytes_out long, class_uid int, status_id int, disposition_id int, action_id int, user_name string, device_hostname string, sender_ip string, fields_verified boolean, time_source string, sequence_num long"


def event(minute, **more):
    base = dict(time=T0 + minute * 60000, src_ip="10.0.0.1", dst_ip=None, dst_hostname=None, dst_port=None, bytes_in=None, bytes_out=None, class_uid=4001, status_id=None, disposition_id=None, action_id=None, user_name=None, device_hostname=None, sender_ip="192.0.2.1", fields_verified=True, time_source="device", sequence_num=minute)
    return tuple((base | more)[c.split()[0]] for c in COLUMNS.split(", "))


@pytest.fixture
def events(spark):
    return spark.createDataFrame(
        [
            event(1, dst_ip="198.51.100.1", dst_port=443, bytes_out=100, device_hostname="fw1"), event(2, dst_ip="198.51.100.2", dst_port=80, bytes_out=50, action_id=2, disposition_id=2, device_hostname="fw1"),
            event(3, dst_ip="198.51.100.2", dst_port=80, fields_verified=False, device_hostname="fw1"), event(6, dst_ip="198.51.100.1", dst_port=443), event(7, dst_ip="198.51.100.9", dst_port=443),
            event(8, class_uid=3002, status_id=2, user_name="bob"),
        ], COLUMNS,
    )


def test_hand_counted_windows(events):
    a, b = features.window_features(events, "src_ip").orderBy("window_start_ms").collect()
    assert (a.events, a.denied, a.distinct_dst_ips, a.distinct_dst_ports, a.bytes_out, a.unverified, a.history_windows, a.first_sequence, a.last_sequence) == (3, 1, 2, 2, 150, 1, 0, 1, 3)
    assert (b.events, b.distinct_dst_ips, b.new_dst_ips, b.bytes_out, b.auth_failures, b.history_windows) == (3, 2, 1, None, 1, 1)
    assert {r.entity for r in features.window_features(events, "device").collect()} == {"fw1", "192.0.2.1"}


def test_features_do_not_see_later_events(events):
    cut = T0 + 5 * 60000
    early = features.window_features(events.filter(F.col("time") < cut)).collect()
    assert early == features.window_features(events).filter(F.col("window_start_ms") < cut).collect()


def windows(spark, values):
    rows = [("src_ip", e, T0 + i * 300000, v) for e, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "entity_type string, entity string, window_start_ms long, events long")
    for c in baseline.MIN_EXCESS["src_ip"]:
        df = df if c == "events" else df.withColumn(c, F.lit(0).cast("long"))
    return df


def test_own_history(spark):
    history = [10, 12, 11, 9, 10, 13, 10, 12]
    r = baseline.reasons(windows(spark, {"a": [*history, 400]}), "src_ip").collect()
    assert len(r) == 1 and r[0].baseline == "own history" and r[0].history == 8
    med = statistics.median(history)
    spread = 1.4826 * statistics.median(abs(x - med) for x in history)
    assert r[0].median == med and r[0].spread == pytest.approx(spread) and r[0].z == pytest.approx((400 - med) / spread)
    assert baseline.reasons(windows(spark, {"a": [*history, 60]}), "src_ip").count() == 0  # under the least increase
    assert baseline.reasons(windows(spark, {"a": [10, 12, 400]}), "src_ip").count() == 0  # no history


def test_peers_and_flat_history(spark):
    values = {f"p{i}": [7] * 6 for i in range(6)} | {"x": [None] * 6 + [300]}
    df = windows(spark, values).filter("events IS NOT NULL")
    r = baseline.reasons(df, "src_ip").collect()
    assert [(x.entity, x.baseline, x.history, x.spread_from, x.z) for x in r] == [("x", "peers", 36, "none", None)]
    flag = baseline.flags(baseline.reasons(df, "src_ip")).first()
    assert flag.finding_uid == "baseline-" + hashlib.sha256(f"baseline|src_ip|x|{T0 + 6 * 300000}".encode()).hexdigest()[:16]
    assert flag.title == "Unusual event volume from x"


def scope(spark, rows):
    cols = "event_id long, time long, source_id int, class_uid int, src_ip string, dst_ip string, dst_port int, disposition string, action string, status string, user_name string, severity string, device_hostname string, superseded_by string, sequence_num long"
    base = dict(superseded_by=None, severity="High", device_hostname="d", user_name=None, status=None, action=None, disposition=None, dst_port=None)
    return correlate.scope(spark.createDataFrame([tuple((base | r | {"event_id": i, "sequence_num": i + 1})[c.split()[0]] for c in cols.split(", ")) for i, r in enumerate(rows)], cols))


def test_login_network_alert_chain(spark):
    rows = scope(spark, [
        {"time": T0, "source_id": 1, "class_uid": 3002, "src_ip": "10.0.1.15", "dst_ip": None, "status": "success"},
        {"time": T0 + 15000, "source_id": 2, "class_uid": 4001, "src_ip": "10.0.1.15", "dst_ip": "198.51.100.1", "disposition": "allowed"},
        {"time": T0 + 45000, "source_id": 3, "class_uid": 2004, "src_ip": "198.51.100.1", "dst_ip": "10.0.1.15"},
    ])
    login = correlate.login_then_activity(rows).first()
    assert (login.first_id, login.gap_ms, login.shared, login.matches) == (1, 15000, "10.0.1.15", 2)
    alert = correlate.allowed_then_alert(rows).first()
    assert (alert.allowed_id, alert.gap_ms) == (1, 30000)
    assert correlate.summary(rows).first().ips == "10.0.1.15,198.51.100.1"


@pytest.mark.parametrize(("ports", "found"), [(10, 1), (9, 0)])
def test_port_sweep_threshold(spark, ports, found):
    rows = [{"time": T0 + i * 1000, "source_id": 1, "class_uid": 4001, "src_ip": "10.0.0.1", "dst_ip": "10.0.0.2", "dst_port": 20 + i} for i in range(ports)]
    assert correlate.port_sweeps(scope(spark, rows)).count() == found


def test_merkle_matches_recursive_definition():
    def root(leaves):
        if len(leaves) == 1:
            return integrity.leaf_hash(leaves[0])
        k = 1 << (len(leaves) - 1).bit_length() - 1
        return integrity.node_hash(root(leaves[:k]), root(leaves[k:]))

    for n in range(1, 20):
        leaves = [f"{i}:x".encode() for i in range(n)]
        assert integrity.merkle_root(leaves) == root(leaves)
        for i in range(n):
            path = integrity.inclusion_path(i, leaves)
            assert integrity.verify_inclusion(i, n, leaves[i], path, root(leaves))
            assert not integrity.verify_inclusion(i, n, b"other", path, root(leaves))


def test_streamed_chain_equals_batch_chain(spark):
    rows = [(i % 2, i, f"r{i}", f"b{i}") for i in range(12)]
    heads = spark.createDataFrame([], "shard long, sequence_num long, record_hash string")
    made = []
    for part in (rows[:5], rows[5:]):
        out = pipeline.chain_batch(spark.createDataFrame(part, "shard long, arrival long, raw_hash string, body string"), heads).collect()
        made += [(r.shard, r.sequence_num, r.record_hash) for r in out]
        last = {s: max(x for x in made if x[0] == s) for s in {x[0] for x in made}}
        heads = spark.createDataFrame(list(last.values()), heads.schema)
    whole = spark.createDataFrame([(s, a // 2 + 1, r, b) for s, a, r, b in rows], "shard long, sequence_num long, raw_hash string, body string")
    assert sorted(made) == sorted((r.shard, r.sequence_num, r.record_hash) for r in integrity.chain(whole).collect())


def test_template_merging_depends_on_order_and_directions():
    rows = [("a", "", "user <N> logged in", 1), ("b", "", "user <Q> logged in", 2), ("c", "", "pass inbound on port", 3), ("d", "", "pass outbound on port", 4), ("e", "", "too short", 5)]
    assert merge_templates(rows) == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


def test_search_and_private(spark):
    df = spark.createDataFrame([(1, "Über den Fluss"), (2, "uber allem"), (3, "den uber")], "event_id long, raw_text string")
    assert sorted(r[0] for r in search.match(search.index(df), "den ub").collect()) == [3]
    ips = spark.createDataFrame([("10.1.1.1",), ("100.64.0.1",), ("11.0.0.1",), ("fd00::1",), ("2001::1",), (None,)], "ip string")
    assert [r[0] for r in ips.select(search.is_private(F.col("ip"))).collect()] == [True, True, False, True, False, False]


def test_sinks_write_their_layouts(spark, tmp_path):
    df = spark.createDataFrame([(1, 4001, T0), (2, 2004, T0 + 86400000)], "event_id long, class_uid int, time long")
    sinks.write_hive(df, f"{tmp_path}/hive")
    assert sorted(p.name for p in (tmp_path / "hive").iterdir() if p.is_dir()) == ["class_uid=2004", "class_uid=4001"]
    sinks.write_lake(df, f"{tmp_path}/lake", "acme", "eu", "1")
    assert (tmp_path / "lake/ext/acme-4001/region=eu/accountId=1").is_dir()
    with pytest.raises(ValueError):
        sinks.write_lake(df, f"{tmp_path}/x", "acme", "eu", "1", "1.4.0")
    assert spark.read.parquet(f"{tmp_path}/hive").count() == 2


def test_frames_and_datagrams(spark):
    df = spark.createDataFrame([("5 a b c3 xyz",), ("one\ntwo\r\n",)], "p string")
    assert [r[0] for r in df.select(inbound.tcp_frames(F.col("p"))).collect()] == [["a b c", "xyz"], ["one", "two"]]
    df = spark.createDataFrame([("<1>a\n<2>b",), ("<1>a\nb",)], "p string")
    assert [len(r[0]) for r in df.select(inbound.datagram(F.col("p"))).collect()] == [2, 1]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(T0 / 1000 + 60 * i, "10.0.0.1", "d", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "s double, src_ip string, dst_ip string, bytes_out long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    pipeline.windows(stream).writeStream.format("memory").queryName("windows_test").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.window_start_ms: r.events for r in spark.table("windows_test").collect()}
    want = {r.w: r.n for r in df.groupBy((F.floor(F.col("s") / 300) * 300000).cast("long").alias("w")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 1


def test_timeline_has_no_gaps(spark):
    df = spark.createDataFrame([(T0, "denied"), (T0 + 900000, "allowed")], "time long, disposition string")
    assert [(r.events, r.denied) for r in analytics.timeline(df, 300000).orderBy("slot").collect()] == [(1, 1), (0, 0), (0, 0), (1, 0)]


def brute_merge(rows):
    from sentrylake.operators.registry import DIRECTION

    out, known = {}, []
    for fid, app, template, _ in sorted(rows, key=lambda t: (t[3], t[0])):
        words = template.split(" ")
        out[fid] = fid
        for entry in known if len(words) > 3 else []:
            apart = [i for i, (a, b) in enumerate(zip(entry[2], words)) if a not in (b, "<*>")]
            if entry[1] == (app, len(words)) and len(apart) < 2 and not any(w.lower() in DIRECTION or w in DIRECTION for i in apart for w in (entry[2][i], words[i])):
                for i in apart:
                    entry[2][i] = "<*>"
                out[fid] = entry[0]
                break
        else:
            if len(words) > 3:
                known.append([fid, (app, len(words)), words])
    return out


def test_template_merging_equals_brute_force():
    import random

    rng = random.Random(3)
    rows = [(f"{i:04d}", rng.choice(["", "a"]), " ".join(rng.choice(["x", "y", "in", "z<N>"]) for _ in range(rng.randint(3, 7))), rng.randint(0, 300)) for i in range(600)]
    assert merge_templates(rows) == brute_merge(rows)


def test_templates_of_all_lines_are_merged(spark, tmp_path):
    import __spark_entry__ as e

    texts = ["head line of text\nuser 5 logged on here\nuser bob logged on here", None, "other\npass it inbound now", "pass it outbound now"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.format_id: r.canonical_id for r in e.queries()["fun_08_template_merge"](spark, str(tmp_path)).collect()}
    seen = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            seen.setdefault(line.replace("5", "<N>").replace("pass ", "<ACTION> "), i)
    rows = [(hashlib.sha1(t.encode()).hexdigest()[:12], "", t, i) for t, i in seen.items()]
    assert got == brute_merge(rows) and len(got) == 7 and len(set(got.values())) == 6


def test_registry_keeps_samples_of_small_and_large_formats(spark):
    from sentrylake.operators.registry import summarise

    rows = [("rare", f"line {i}", 1.0, i, 7) for i in (1, 2, 2)] + [("hot", f"text {i % 900}", 0.5, i, i % 30 if i % 2 else 4) for i in range(2000)]
    lines = spark.createDataFrame(rows, "format_id string, line string, confidence double, time long, source_id long")
    got = {r.format_id: r for r in summarise(lines).collect()}
    assert sorted(got["rare"].samples) == ["line 1", "line 2"] and [tuple(x) for x in got["rare"].top_sources] == [(7, 3)]
    hashes = {r.line: r.h for r in lines.filter("format_id = 'hot'").select("line", F.xxhash64("line").alias("h")).collect()}
    assert got["hot"].samples == sorted(hashes, key=hashes.get)[:200]
    counts = {}
    for _, _, _, _, s in rows[3:]:
        counts[s] = counts.get(s, 0) + 1
    assert [tuple(x) for x in got["hot"].top_sources] == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20]


def test_templates_merge_by_component_as_in_one_group(spark):
    """Wildcards let an entry fit templates that were two words and more from each of its first; also wildcards of the text itself."""
    import random

    from sentrylake.operators.registry import merge_table

    rng = random.Random(11)
    words = ["a", "b", "c", "in", "From", "<ACTION>", "<*>"]
    for n, most, p in ((4, 5, 0.3), (6, 7, 0.4), (9, 6, 0.12)):
        heads = [[rng.choice(words[:6]) for _ in range(n)] for _ in range(12)]
        texts = {" ".join(rng.choice(words[:most]) if rng.random() < p else w for w in rng.choice(heads)) for _ in range(150)} | {"x y", ""}
        rows = [(hashlib.sha1(t.encode()).hexdigest()[:12], rng.choice(["", "a"]), t, rng.randint(0, 40)) for t in sorted(texts)]
        made = spark.createDataFrame(rows, "id string, app string, t string, first long").repartition(3)
        out = merge_table(made)
        assert {r.format_id: r.canonical_id for r in out.collect()} == brute_merge(rows)
        assert "FlatMapGroupsInArrow" not in out._jdf.queryExecution().toString()


def test_only_entries_that_others_may_fit_are_held_and_the_first_that_fits_wins():
    import random

    from sentrylake.operators.registry import Merger

    rng = random.Random(5)
    texts = list({" ".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)} | {f"{i} far from all {i}" for i in range(40)})
    far = lambda t: not any(sum(a != b for a, b in zip(t.split(), o.split(), strict=True)) == 1 for o in texts)
    rows = [(f"{i:04d}", "", t, i) for i, t in enumerate(texts)]
    merger = Merger()
    assert {fid: merger.add(fid, app, t, met=not far(t)) for fid, app, t, _ in rows} == brute_merge(rows)
    [(group, _)] = merger.known.values()
    assert sum(map(far, texts)) >= 40 and not any(far(t) for fid, _ in group for t in texts if rows[int(fid)][2] == t)


def test_an_entry_of_wildcards_alone_takes_a_whole_length(spark):
    """Its templates are linked without keys, and no component is merged again that no link has changed."""
    from sentrylake.operators.registry import merge_table

    texts = [f"a{'x' if i > 0 else ''} b{'x' if i > 1 else ''} c{'x' if i > 2 else ''} d{'x' if i > 3 else ''}" for i in range(5)]
    texts += [f"one {i} of {i * 7}" for i in range(30)] + ["p q r s t", "p q r s u", "k in from to", "k in from out", "v in from to"]
    rows = [(hashlib.sha1(t.encode()).hexdigest()[:12], "", t, i % 20) for i, t in enumerate(texts)]
    out = merge_table(spark.createDataFrame(rows, "id string, app string, t string, first long"))
    got = {r.format_id: r.canonical_id for r in out.collect()}
    assert got == brute_merge(rows) and len({got[x] for x, *_ in rows[5:35]}) < 30
