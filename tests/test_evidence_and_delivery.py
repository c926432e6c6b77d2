import pytest
from pyspark.sql import functions as F

from sentrylake.operators import evidence, integrity
from sentrylake.streaming import delivery


def ledger(spark, n=25):
    rows = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("shard"), F.col("id").alias("sequence_num"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("raw_text"))
    rows = rows.select("*", F.sha2("raw_text", 256).alias("raw_hash"), F.lit("{}").alias("body"))
    return integrity.chain(rows)


def test_bundle_proves_its_records(spark):
    led = ledger(spark)
    wanted = spark.createDataFrame([(1, 3), (1, 12), (1, 25)], "shard long, sequence_num long")
    got = evidence.bundle(led, wanted, size=10).collect()
    hashes = {r.sequence_num: r.record_hash for r in led.collect()}
    assert sorted(r.sequence_num for r in got) == [3, 12, 25]
    for r in got:
        assert r.raw_ok and r.record_ok
        leaf = f"{r.sequence_num}:{hashes[r.sequence_num]}".encode()
        path = [bytes.fromhex(p) for p in r.path]
        assert integrity.verify_inclusion(r.leaf_index, r.tree_size, leaf, path, bytes.fromhex(r.root))
    roots = {(r.idx, r.root) for r in integrity.checkpoints(led, size=10).collect()}
    assert {(r.idx, r.root) for r in got} <= roots
    with pytest.raises(ValueError):
        evidence.bundle(led, wanted.limit(0))


def test_incident_hints(spark):
    facts = spark.createDataFrame([("PORT_SWEEP",), ("failed login",), ("SQL injection over http",), ("nothing",)], "text string")
    assert {r.code: r["items"] for r in evidence.suggest_types(facts).collect()} == {"i": 1, "iii": 1, "x": 1}


def test_delivery_retries_and_dead_letters(spark):
    batch = spark.createDataFrame([(1,), (2,)], "event_id long")
    tries, waits, dead = [], [], []

    def flaky(df, batch_id):
        tries.append(batch_id)
        if len(tries) < 3:
            raise OSError("down")

    assert delivery.deliver(batch, 7, flaky, dead.append, sleep=waits.append) == "delivered"
    assert tries == [7, 7, 7] and waits == [1.0, 2.0] and not dead

    def down(df, batch_id):
        raise OSError("down")

    assert delivery.deliver(batch, 8, down, dead.append, attempts=9, sleep=waits.append) == "dead_lettered"
    assert max(waits) == 60.0 and [(r.kind, r.reason, r.attempts) for r in dead[0].collect()] == [("undeliverable", "down", 9)] * 2

    def refuse(df, batch_id):
        raise delivery.Rejected("bad token")

    assert delivery.deliver(batch, 9, refuse, dead.append, sleep=waits.append) == "dead_lettered"
    both = dead[0].unionByName(dead[1])
    sent = spark.createDataFrame([(1,)], "event_id long")
    assert [r.event_id for r in delivery.replayable(both, sent).collect()] == [2]
    assert delivery.replayable(both, sent, kinds=("rejected",)).count() == 1
