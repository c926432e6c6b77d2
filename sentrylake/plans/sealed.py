"""Registered queries over what is kept on disk: sealed ledgers, dead letters, postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sentrylake.operators import evidence, postings, sealing
from sentrylake.session import scratch_dir
from sentrylake.streaming.dead_letters import DeadLetters

from .fixtures import EVENTS, events
from .queries import query

SIZE, FORCED = 50, 120
_LEDGER = f"""SELECT source_id AS shard, row_number() OVER (PARTITION BY source_id ORDER BY event_id) AS seq, sha256(raw_text) AS record_hash, time AS stamp FROM ({EVENTS})"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("source_id").orderBy("event_id")).cast("long")
    return events(spark, sf_dir).select(F.col("source_id").alias("shard"), number.alias("sequence_num"), F.sha2("raw_text", 256).alias("record_hash"), F.col("time").alias("at"))


def _sealed(ledger: DataFrame) -> DataFrame:
    """The first FORCED records of a shard sealed by force, then what came after them; checkpoints are stored as they are made."""
    spark, path = ledger.sparkSession, scratch_dir(ledger.sparkSession, "checkpoints")
    none = sealing.empty(ledger)
    sealing.seal(ledger.filter(F.col("sequence_num") <= FORCED), none, SIZE, force=True).write.parquet(f"{path}/batch=0")
    early = spark.read.schema(none.schema).parquet(f"{path}/batch=0")
    sealing.seal(ledger, early, SIZE).write.parquet(f"{path}/batch=1")
    return spark.read.schema(none.schema).parquet(f"{path}/batch=0", f"{path}/batch=1")


@query("led_11_seals", f"""
WITH RECURSIVE l AS ({_LEDGER}), w AS (
  SELECT *, max(seq) OVER (PARTITION BY shard) AS head,
    CASE WHEN seq <= {FORCED} THEN 1 + (seq - 1) // {SIZE} ELSE 1 + ({FORCED} + {SIZE} - 1) // {SIZE} + (seq - {FORCED} - 1) // {SIZE} END AS idx,
    CASE WHEN seq <= {FORCED} THEN 1 + (seq - 1) // {SIZE} * {SIZE} ELSE {FORCED} + 1 + (seq - {FORCED} - 1) // {SIZE} * {SIZE} END AS first_seq
  FROM l
), k AS (
  SELECT *, CASE WHEN seq <= {FORCED} THEN least(first_seq + {SIZE} - 1, {FORCED}, head) ELSE first_seq + {SIZE} - 1 END AS last_seq FROM w
), t(shard, idx, level, pos, n, node) AS (
  SELECT shard, idx, 0, seq - first_seq, count(*) OVER (PARTITION BY shard, idx), unhex(sha256('\\x00'::BLOB || encode(concat(seq, ':', record_hash)))) FROM k WHERE last_seq <= head
  UNION ALL
  SELECT shard, idx, level + 1, pos // 2, (n + 1) // 2, CASE WHEN count(*) = 2 THEN unhex(sha256('\\x01'::BLOB || min_by(node, pos) || max_by(node, pos))) ELSE min_by(node, pos) END
  FROM t WHERE n > 1 GROUP BY shard, idx, level, pos // 2, n
), r AS (
  SELECT shard, idx, lower(hex(node)) AS merkle_root FROM t WHERE n = 1
), c AS (
  SELECT shard, idx, first_seq, last_seq, count(*) AS size, max(stamp) AS stamp, any_value(merkle_root) AS merkle_root FROM k JOIN r USING (shard, idx) GROUP BY ALL
), s(shard, idx, first_seq, last_seq, size, merkle_root, prev_hash, body) AS (
  SELECT shard, idx, first_seq, last_seq, size, merkle_root, repeat('0', 64),
    concat('{{"first_seq":', first_seq, ',"index":', idx, ',"last_seq":', last_seq, ',"log_id":"log","merkle_root":"', merkle_root, '","prev_checkpoint":"', repeat('0', 64), '","sealed_at":"', stamp, '","size":', size, ',"type":"checkpoint","v":1}}')
  FROM c WHERE idx = 1
  UNION ALL
  SELECT c.shard, c.idx, c.first_seq, c.last_seq, c.size, c.merkle_root, sha256(s.body),
    concat('{{"first_seq":', c.first_seq, ',"index":', c.idx, ',"last_seq":', c.last_seq, ',"log_id":"log","merkle_root":"', c.merkle_root, '","prev_checkpoint":"', sha256(s.body), '","sealed_at":"', c.stamp, '","size":', c.size, ',"type":"checkpoint","v":1}}')
  FROM s JOIN c ON c.shard = s.shard AND c.idx = s.idx + 1
)
SELECT shard, idx, first_seq, last_seq, size, merkle_root, prev_hash, sha256(body) AS checkpoint_hash FROM s
""")
def led_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sealed(_ledger(spark, sf_dir)).select("shard", "idx", "first_seq", "last_seq", "size", "merkle_root", "prev_hash", "checkpoint_hash")


_NOT_HASH, _COLUMNS, _FOLLOWS, _GAP, _NUMBER, _CHANGED, _UNREAD = (
    "its hash is not that of its text", "its columns differ from its text", "it does not follow the one before it", "records before it are in no checkpoint, or in two",
    "it covers other numbers of records than are stored", "records that it covers were changed", "its text cannot be read",
)
#: What is done to the third checkpoint of a shard, or to a record of it, and what is found.
_FOUND = [
    (0, 3, _NOT_HASH), (0, 3, _CHANGED), (1, 4, _FOLLOWS), (1, 4, _GAP), (2, 3, _CHANGED), (3, 1, _NUMBER), (3, 2, _COLUMNS), (3, 3, _UNREAD), (3, 4, _FOLLOWS), (3, 4, _GAP),
]


@query("led_03_seal_problems", f"WITH n AS (SELECT source_id AS shard, count(*) AS n FROM ({EVENTS}) GROUP BY 1) SELECT n.shard, CAST(i AS BIGINT) AS idx, problem FROM n JOIN (VALUES {', '.join(f'({s}, {i}, {chr(39)}{p}{chr(39)})' for s, i, p in _FOUND)}) v(shard, i, problem) ON v.shard = n.shard AND n.n >= {FORCED + SIZE}")
def led_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    is_ = lambda shard, idx: (F.col("shard") == shard) & (F.col("idx") == idx)
    sealed = _sealed(ledger).filter(~is_(1, 3))
    root = F.regexp_replace("body", '"merkle_root":"[0-9a-f]{8}', '"merkle_root":"00000000')
    sealed = sealed.withColumns({
        "merkle_root": F.when(is_(0, 3), F.concat(F.lit("00000000"), F.substring("merkle_root", 9, 56))).otherwise(F.col("merkle_root")),
        "body": F.when(is_(0, 3), root).when(is_(3, 3), F.lit("{")).otherwise(F.col("body")),
        "last_seq": F.when(is_(3, 2), F.col("last_seq") - 1).otherwise(F.col("last_seq")),
    })
    at = lambda shard, seq: (F.col("shard") == shard) & (F.col("sequence_num") == seq)
    now = ledger.filter(~at(3, 7)).withColumn("record_hash", F.when(at(2, 110), F.lit("0")).otherwise(F.col("record_hash")))
    return sealing.verify(sealed, now, width=SIZE)


@query("str_12_unsealed", f"""WITH h AS (SELECT source_id AS shard, count(*) AS head FROM ({EVENTS}) GROUP BY 1)
SELECT shard, CASE WHEN head <= {FORCED} THEN (head + {SIZE} - 1) // {SIZE} ELSE ({FORCED} + {SIZE} - 1) // {SIZE} + (head - {FORCED}) // {SIZE} END AS checkpoints,
  CASE WHEN head <= {FORCED} THEN head ELSE {FORCED} + (head - {FORCED}) // {SIZE} * {SIZE} END AS sealed, head, CASE WHEN head <= {FORCED} THEN 0 ELSE (head - {FORCED}) % {SIZE} END AS unsealed FROM h""")
def str_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = _ledger(spark, sf_dir)
    return sealing.sealed_so_far(_sealed(ledger), ledger)


@query("snk_08_dead_letters", f"""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'rejected' ELSE kind END AS kind, CASE WHEN event_id % 3 < 2 THEN 'no such index' ELSE reason END AS reason, CAST(CASE WHEN event_id % 3 < 2 THEN 7 ELSE 6 END AS INT) AS attempts
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'undeliverable' WHEN 1 THEN 'queue_full' ELSE 'rejected' END AS kind, concat('reason ', event_id % 3) AS reason FROM ({EVENTS})) WHERE event_id % 3 = 2 OR event_id % 10 = 0""")
def snk_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What still waits after a replay that was cut off in its first wave, and the one that went on; every tenth event is refused again."""
    kind = F.when(F.col("event_id") % 3 == 0, "undeliverable").when(F.col("event_id") % 3 == 1, "queue_full").otherwise("rejected")
    reason = F.concat(F.lit("reason "), (F.col("event_id") % 3).cast("string"))
    e = events(spark, sf_dir).select("event_id", kind.alias("kind"), reason.alias("reason"), F.lit(6).alias("attempts"), F.col("time").alias("at"))
    store = DeadLetters(spark, scratch_dir(spark, "dead"), wave=4000)
    store.append(e, "batch-0")
    store.append(e, "batch-0")  # the same batch again

    def down(rows: DataFrame, wave: str) -> None:
        raise OSError("connection refused")

    def taken(rows: DataFrame, wave: str) -> DataFrame:
        return rows.filter("event_id % 10 = 0").select("event_id", F.lit("no such index").alias("reason"))

    store.replay(down, "event_id")
    store.replay(taken, "event_id", at_once=8)
    return store.entries().select("event_id", "kind", "reason", "attempts")


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields of the events in two batches, the second one written twice."""
    path = scratch_dir(spark, "postings")
    e = events(spark, sf_dir)
    for batch in (0, 1, 1):
        postings.add(e.filter(F.col("event_id") % 2 == batch), path, batch, ("raw_text", "user_name"))
    return postings.opened(spark, path)


@query("flt_04_postings", f"SELECT event_id AS key FROM ({EVENTS}) WHERE regexp_matches(lower(raw_text), '(^|[^a-z0-9])error by user1')")
def flt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.match(_index(spark, sf_dir), "Error by USER1")


@query("joi_06_search_events", f"SELECT event_id, src_ip, user_name FROM ({EVENTS}) WHERE user_name LIKE 'user2%'")
def joi_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.events_of(events(spark, sf_dir), _index(spark, sf_dir), "user2", fields=(1,)).select("event_id", "src_ip", "user_name")


@query("led_07_multiproofs", f"""WITH l AS ({_LEDGER}), h AS (SELECT *, max(seq) OVER (PARTITION BY shard) AS head FROM l), k AS (
  SELECT shard, seq, head, CASE WHEN seq <= {FORCED} THEN 1 + (seq - 1) // {SIZE} ELSE 1 + ({FORCED} + {SIZE} - 1) // {SIZE} + (seq - {FORCED} - 1) // {SIZE} END AS idx,
    CASE WHEN seq <= {FORCED} THEN 0 ELSE {FORCED} + ((seq - {FORCED} - 1) // {SIZE} + 1) * {SIZE} END AS last_seq FROM h
)
SELECT shard, idx, count(*) AS records, NOT bool_or(shard = 2 AND idx = 2) AS proven FROM k WHERE seq % 7 = 0 AND last_seq <= head GROUP BY 1, 2""")
def led_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh record proven by the checkpoint that seals it; one record of another is not what was sealed."""
    ledger = _ledger(spark, sf_dir)
    changed = F.when((F.col("shard") == 2) & (F.col("sequence_num") == 60), F.lit("0")).otherwise(F.col("record_hash"))
    found = evidence.multiproofs(ledger.withColumn("record_hash", changed), _sealed(ledger), ledger.filter("sequence_num % 7 = 0"), width=SIZE)
    return found.select("shard", "idx", F.size("leaves").cast("long").alias("records"), "proven")
