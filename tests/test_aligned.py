import random

from pyspark.sql import functions as F

from sentrylake.operators import aligned, learned

RNG = random.Random(11)
ip = lambda: f"10.{RNG.randint(0, 9)}.{RNG.randint(0, 255)}.{RNG.randint(1, 254)}"
out = lambda: f"198.51.100.{RNG.randint(1, 254)}"


def truth():
    return {"src_ip": ip(), "src_port": str(RNG.randint(20_000, 60_000)), "dst_ip": out(), "dst_port": str(RNG.choice([22, 53, 80, 443])), "protocol": RNG.choice(["TCP", "UDP"]), "action": RNG.choice(["allow", "deny"]), "user": RNG.choice(["ann", "bob", "eve"])}


# Each format writes the same facts in its own words.
WRITERS = {
    "router": lambda t, i: f"<134>Sep 21 10:{i % 60:02d}:00 MikroTik forward: in:ether1 out:bridge, proto {t['protocol']} (SYN), {t['src_ip']}:{t['src_port']}->{t['dst_ip']}:{t['dst_port']}, len {40 + i}",
    "prose": lambda t, i: f"2026-09-21 10:00:{i % 60:02d} gate{i % 3} session {i} {t['action']} {t['protocol'].lower()} from {t['src_ip']} port {t['src_port']} to {t['dst_ip']} port {t['dst_port']} for user {t['user']}" + " retry" * (i % 4) + " done",
    "keyed words": lambda t, i: f"Sep 21 10:00:00 fw{i % 9} filter: verdict={t['action']} src={t['src_ip']}/{t['src_port']} dst={t['dst_ip']}/{t['dst_port']} note [{' x' * (i % 5)} ]",
    "bare": lambda t, i: f"flow {i} {t['src_ip']} {t['dst_ip']} {t['action']} {t['protocol']} ok",
    "columns": lambda t, i: f"2,{i},eni-{i % 7},{t['src_ip']},{t['dst_ip']},{t['src_port']},{t['dst_port']},{dict(TCP=6, UDP=17)[t['protocol']]},\"a, {i}\",{t['action']}",
}
HAS = {"router": ("src_ip", "src_port", "dst_ip", "dst_port", "protocol"), "prose": ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "action", "user"), "keyed words": ("src_ip", "src_port", "dst_ip", "dst_port", "action"), "bare": ("src_ip", "dst_ip", "protocol", "action"), "columns": ("src_ip", "src_port", "dst_ip", "dst_port", "protocol", "action")}


def test_layouts_are_learned_and_read_new_lines_without_a_wrong_value(spark):
    facts = [(f, i, truth()) for f in WRITERS for i in range(120)]
    lines = spark.createDataFrame([(f, WRITERS[f](t, i)) for f, i, t in facts if i < 100], "format string, line string")
    specs = {r.format: r for r in aligned.learn_formats(lines).collect()}
    assert set(specs) == set(WRITERS)
    for name, row in specs.items():
        assert row.learned_from == 60 and row.held_out == 40 and row.recognised == row.clean == 1.0, (name, row)
        spec = learned.Spec.from_json(row.spec)
        assert {s.role for s in spec.slots} == set(HAS[name]), (name, spec)
        new = [(i, WRITERS[name](t, i), t) for f, i, t in facts if f == name and i >= 100]
        got = {r.i: r.f for r in spark.createDataFrame([x[:2] for x in new], "i int, line string").select("i", learned.apply(spec, F.col("line")).alias("f")).collect()}
        for i, _, t in new:
            want = {r: t[r] for r in HAS[name]} | ({"action": {"allow": "allowed", "deny": "denied"}[t["action"]]} if "action" in HAS[name] else {})
            assert {r: got[i][r] for r in want} == want, name


def test_what_place_alone_says_is_for_a_reviewer(spark):
    def roles(name):
        return {s.role: s.needs_review for s in aligned.learn_lines([WRITERS[name](truth(), i) for i in range(60)], name).slots}

    assert roles("bare") == {"src_ip": True, "dst_ip": True, "protocol": False, "action": False}
    assert roles("prose") == dict.fromkeys(HAS["prose"], False)
    assert all(roles("columns")[r] for r in ("src_ip", "dst_ip", "src_port", "dst_port")) and not roles("columns")["action"]


def test_lines_of_other_formats_are_not_read(spark):
    spec = aligned.learn_lines([WRITERS["prose"](truth(), i) for i in range(60)], "prose")
    others = [(WRITERS[f](truth(), 1),) for f in WRITERS if f != "prose"] + [("",), (None,)]
    got = spark.createDataFrame(others, "line string").select(learned.score(spec, F.col("line")).alias("s"), learned.apply(spec, F.col("line")).alias("f")).collect()
    assert all(r.s is None and r.f is None for r in got)


def test_few_and_odd_lines(spark):
    assert aligned.learn_lines(["x"], "one").slots == []
    lines = spark.createDataFrame([("a", None), ("b", ""), ("c", "same 10.0.0.1"), ("c", "same 10.0.0.1")], "format string, line string")
    got = {r.format: (r.learned_from, r.held_out) for r in aligned.learn_formats(lines).collect()}
    assert got == {"b": (1, 0), "c": (1, 0)}
