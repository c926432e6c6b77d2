"""Shards of any length: a task holds one batch or one window of them, never a shard."""

from pyspark.sql import functions as F

from sentrylake.operators import integrity, sealing


def _records(spark, n):
    return spark.range(n).select((F.col("id") % 2).alias("shard"), (F.floor(F.col("id") / 2) + 1).alias("sequence_num"), F.sha2(F.col("id").cast("string"), 256).alias("raw_hash"), F.concat(F.lit("b"), "id").alias("body"))


def _grouped(plan):
    return [n for n in ("FlatMapGroupsInPandas", "FlatMapGroupsInArrow") if n in plan]


def test_a_chain_is_folded_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # the hash goes on from batch to batch
    try:
        made = integrity.chain(_records(spark, 100))
        assert not _grouped(made._jdf.queryExecution().toString())
        prev, got = {0: integrity.GENESIS, 1: integrity.GENESIS}, made.orderBy("sequence_num").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import hashlib

    for r in got:
        assert r.prev_hash == prev[r.shard]
        prev[r.shard] = hashlib.sha256(f"{r.prev_hash}:{r.sequence_num}:{r.raw_hash}:{r.body}".encode()).hexdigest()
        assert r.record_hash == prev[r.shard]
    assert len(got) == 100


def test_windows_are_rooted_and_linked_over_batches(spark):
    ledger = _records(spark, 230).select("shard", "sequence_num", F.col("raw_hash").alias("record_hash"), F.col("sequence_num").alias("at"))
    seal = lambda: sealing.seal(ledger, sealing.empty(ledger), 10, force=True)
    assert not _grouped(seal()._jdf.queryExecution().toString())
    whole = sorted(map(tuple, seal().collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, seal().collect())) == whole and len(whole) == 24
        roots = integrity.checkpoints(ledger, size=10).orderBy("shard", "idx").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.root for r in roots] == [w[5] for w in whole] and [r.leaves for r in roots] == ([10] * 11 + [5]) * 2
