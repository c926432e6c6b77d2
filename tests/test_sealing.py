import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import integrity, sealing
from sentrylake.streaming import pipeline

LEDGER = "shard string, sequence_num long, record_hash string, at long"


def records(shard, first, last):
    return [(shard, i, hashlib.sha256(f"{shard}{i}".encode()).hexdigest(), 1000 + i) for i in range(first, last + 1)]


def ranges(sealed):
    return sorted((r.shard, r.idx, r.first_seq, r.last_seq, r.size) for r in sealed.collect())


def test_windows_follow_a_forced_one(spark):
    first = spark.createDataFrame(records("a", 1, 23), LEDGER)
    early = sealing.seal(first, sealing.empty(first), 10, force=True)
    assert ranges(early) == [("a", 1, 1, 10, 10), ("a", 2, 11, 20, 10), ("a", 3, 21, 23, 3)]
    more = spark.createDataFrame(records("a", 1, 47) + records("b", 1, 9), LEDGER)
    late = sealing.seal(more, early, 10)
    assert ranges(late) == [("a", 4, 24, 33, 10), ("a", 5, 34, 43, 10)]
    rows = sorted(early.unionByName(late).collect(), key=lambda r: r.idx)
    prev = integrity.GENESIS
    for r in rows:
        leaves = [f"{i}:{hashlib.sha256(f'a{i}'.encode()).hexdigest()}".encode() for i in range(r.first_seq, r.last_seq + 1)]
        body = {"v": 1, "type": "checkpoint", "log_id": "log", "index": r.idx, "first_seq": r.first_seq, "last_seq": r.last_seq, "size": r.size, "merkle_root": integrity.merkle_root(leaves).hex(), "prev_checkpoint": prev, "sealed_at": str(1000 + r.last_seq)}
        assert r.body == json.dumps(body, sort_keys=True, separators=(",", ":")) and r.prev_hash == prev
        prev = r.checkpoint_hash
        assert prev == hashlib.sha256(r.body.encode()).hexdigest()
    assert sealing.seal(more, early.unionByName(late), 10).count() == 0 and sealing.seal(first.limit(0), sealing.empty(first), 10, True).count() == 0


EDITS = {
    "nothing": (lambda s: s, lambda w: w, []),
    "text": (lambda s: s.withColumn("body", F.when(F.col("idx") == 2, F.regexp_replace("body", '"log"', '"gol"')).otherwise(F.col("body"))), lambda w: w, [(2, "its hash is not that of its text")]),
    "text and hash": (
        lambda s: s.withColumn("body", F.when(F.col("idx") == 2, F.regexp_replace("body", '"log"', '"gol"')).otherwise(F.col("body"))).withColumn("checkpoint_hash", F.sha2("body", 256)), lambda w: w,
        [(3, "it does not follow the one before it")],
    ),
    "columns": (lambda s: s.withColumn("first_seq", F.when(F.col("idx") == 2, 12).otherwise(F.col("first_seq"))), lambda w: w, [(2, "its columns differ from its text")]),
    "one dropped": (lambda s: s.filter("idx <> 2"), lambda w: w, [(3, "it does not follow the one before it"), (3, "records before it are in no checkpoint, or in two")]),
    "unreadable": (lambda s: s.withColumn("body", F.when(F.col("idx") == 4, "no").otherwise(F.col("body"))), lambda w: w, [(4, "its text cannot be read")]),
    "record changed": (lambda s: s, lambda w: w.withColumn("record_hash", F.when(F.col("sequence_num") == 15, "x").otherwise(F.col("record_hash"))), [(2, "records that it covers were changed")]),
    "records swapped": (lambda s: s, lambda w: w.withColumn("sequence_num", F.when(F.col("sequence_num") == 15, 16).when(F.col("sequence_num") == 16, 15).otherwise(F.col("sequence_num"))), [(2, "records that it covers were changed")]),
    "record gone": (lambda s: s, lambda w: w.filter("sequence_num <> 31"), [(4, "it covers other numbers of records than are stored")]),
    "range": (
        lambda s: s.withColumn("body", F.when(F.col("idx") == 4, F.regexp_replace("body", '"last_seq":\\d+', '"last_seq":99999999999')).otherwise(F.col("body"))), lambda w: w,
        [(4, "its hash is not that of its text"), (4, "its columns differ from its text"), (4, "it covers other numbers of records than are stored")],
    ),
}


@pytest.mark.parametrize("what", EDITS)
def test_every_kind_of_tampering_is_told(spark, what):
    ledger = spark.createDataFrame(records("a", 1, 36), LEDGER)
    sealed = sealing.seal(ledger, sealing.empty(ledger), 10, force=True)
    store, edit, want = EDITS[what]
    assert sorted((r.idx, r.problem) for r in sealing.verify(store(sealed), edit(ledger), width=7).collect()) == sorted(want)


def test_sealing_a_stream_is_sealing_the_table_also_when_a_batch_comes_again(spark, tmp_path):
    made = records("a", 1, 55) + records("b", 1, 8)
    cuts = [0, 7, 20, 21, 58, 60, len(made)]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        spark.createDataFrame(made[a:b], LEDGER).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    write = sealing.sealing_writer(f"{tmp_path}/ledger", f"{tmp_path}/sealed", 10)

    def twice(batch, batch_id):
        write(batch, batch_id)
        write(batch, batch_id)

    stream = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    pipeline.write_batches(stream, twice, f"{tmp_path}/at").awaitTermination()
    table = spark.createDataFrame(made, LEDGER)
    sealed = spark.read.parquet(f"{tmp_path}/sealed").drop("batch")
    assert spark.read.parquet(f"{tmp_path}/ledger").count() == len(made)
    assert sorted(map(tuple, sealed.collect())) == sorted(map(tuple, sealing.seal(table, sealing.empty(table), 10).collect()))
    assert sealing.verify(sealed, table, width=10).count() == 0
    assert {(r.shard, r.checkpoints, r.sealed, r.head, r.unsealed) for r in sealing.sealed_so_far(sealed, table).collect()} == {("a", 5, 50, 55, 5), ("b", 0, 0, 8, 8)}
