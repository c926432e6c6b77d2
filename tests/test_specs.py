from pyspark.sql import functions as F

from sentrylake.operators import aligned, learned
from sentrylake.operators.learned import Slot, Spec
from sentrylake.streaming import pipeline, specs

KV = Spec("kv", "kv", keys=["src", "dst", "act", "lvl", "more"], slots=[Slot("src_ip", "src", 1.0), Slot("dst_ip", "dst", 1.0), Slot("action", "act", 1.0), Slot("severity", "lvl", 1.0, transform="syslog_severity"), Slot("user", "more", 1.0, transform="$.who.name")], status="approved")
PROSE = [f"gate {i} {a} tcp from 10.0.0.{i} port {4000 + i} to 198.51.100.{i} port 443" for i in range(40) for a in ("allow", "deny")]
CELLS = [f'1,x{i},10.0.0.{i},198.51.100.{i},"a, ""b""",{a}' for i in range(40) for a in ("allow", "deny")]


def learned_specs():
    out = [KV]
    for name, lines in (("prose", PROSE), ("cells", CELLS)):
        spec = aligned.learn_lines(lines, name)
        for s in spec.slots:
            s.needs_review = False
        spec.status = "approved"
        out.append(spec)
    return out


def test_specs_as_rows_read_as_specs_in_the_plan_do(spark):
    made = learned_specs()
    lines = spark.createDataFrame([(x,) for x in [*PROSE[:6], *CELLS[:6], "src=10.1.1.1 dst=10.2.2.2 act=deny more=x lvl=34", "nothing", "", None, "gate 1 allow tcp from nowhere port x to 1 port 443"]], "line string")
    got = {r.line: r for r in specs.read_with(lines, specs.table(spark, [(1, s) for s in made])).collect()}
    for spec in made[1:]:
        want = {r.line: r.f for r in lines.select("line", learned.apply(spec, F.col("line")).alias("f")).collect() if r.f is not None}
        assert len(want) == 6
        for line, f in want.items():
            assert got[line].spec == spec.name and all(got[line][role] == f[role] for role in f.asDict())
    assert [got[x].spec for x in ("nothing", "", None)] == [None] * 3 and got["gate 1 allow tcp from nowhere port x to 1 port 443"].spec is None


def test_values_are_converted_by_name(spark):
    lines = spark.createDataFrame([("src=10.1.1.1 dst=10.2.2.2 act=deny lvl=35 more={}".format('{"who":{"name":"ann"}}'.replace('"', "'")),)], "line string")
    r = specs.read_with(lines, specs.table(spark, [(3, KV)])).first()
    assert (r.spec, r.version, r.src_ip, r.dst_ip, r.action) == ("kv", 3, "10.1.1.1", "10.2.2.2", "denied")
    assert r.severity == "high"


def test_a_spec_approved_while_the_stream_runs_reads_the_next_batch(spark, tmp_path):
    store = specs.SpecStore(spark, f"file://{tmp_path}/specs")
    assert store.current() == []
    _, prose, cells = learned_specs()
    prose.status = "candidate"
    assert store.put(prose) == 1 and store.put(cells) == 1
    for i in range(4):
        spark.createDataFrame([(PROSE[i],), (CELLS[i],)], "line string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    seen = []

    def write(batch, batch_id):
        seen.append(sorted((r.spec, r.version) for r in batch.collect() if r.spec))
        if batch_id == 0:
            prose.status = "approved"
            store.put(prose)
        if batch_id == 1:
            cells.status = "retired"
            store.put(cells)

    stream = spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    pipeline.write_batches(stream, specs.reader(store, write), f"{tmp_path}/at").awaitTermination()
    assert seen == [[("cells", 1)], [("cells", 1), ("prose", 2)], [("prose", 2)], [("prose", 2)]]
