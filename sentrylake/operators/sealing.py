"""Seals over a hash chain: checkpoints of its records whose own hashes are chained, and what a verifier finds wrong with them.

A checkpoint covers the records of a range of sequence numbers by their Merkle root and names the checkpoint before it; what is hashed is its
body, canonical JSON. Windows follow the last record that is sealed, so a partial window that was forced shifts those after it. A task walks
over sorted windows for their roots, and over the one row for each window of a shard for their chain, and holds one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .integrity import GENESIS, rooted

VERSION, TYPE = 1, "checkpoint"
SIZE = 1000
#: A range of more records than this is no window.
LONGEST = 1_000_000
SCHEMA = "shard {}, idx long, first_seq long, last_seq long, size long, merkle_root string, prev_hash string, checkpoint_hash string, body string, sealed_at string"
_BODY = "first_seq long, index long, last_seq long, log_id string, merkle_root string, prev_checkpoint string, sealed_at string, size long, type string, v int"


def canonical(first: int, index: int, last: int, log: str, root: str, prev: str, sealed_at: str, size: int) -> str:
    """The body of a checkpoint: keys in order, no spaces."""
    import json

    members = {"first_seq": first, "index": index, "last_seq": last, "log_id": log, "merkle_root": root, "prev_checkpoint": prev, "sealed_at": sealed_at, "size": size, "type": TYPE, "v": VERSION}
    return json.dumps(members, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def empty(ledger: DataFrame) -> DataFrame:
    """No checkpoints, for the first seal of a ledger."""
    return ledger.sparkSession.createDataFrame([], SCHEMA.format(dict(ledger.dtypes)["shard"]))


def seal(ledger: DataFrame, sealed: DataFrame, size: int = SIZE, force: bool = False, log: str = "log") -> DataFrame:
    """New checkpoints of ``ledger`` (shard, sequence_num, record_hash, at) after those of ``sealed``: all full windows, and with ``force`` also
    the partial one at the end. A window is sealed at the time of its last record, so doing it again gives the same bytes."""
    import pyarrow as pa

    last = sealed.groupBy("shard").agg(F.max_by(F.struct("idx", "last_seq", "checkpoint_hash"), "idx").alias("_before"))
    rows = ledger.select("shard", "sequence_num", "record_hash", "at").join(last, "shard", "left")
    done = F.coalesce("_before.last_seq", F.lit(0))
    rows = rows.filter(F.col("sequence_num") > done).withColumn("_w", F.floor((F.col("sequence_num") - done - 1) / size).cast("long"))
    # a row for each window from here on: the head of a shard is the last record of its last window
    windows = rooted(rows, ("shard", "_w"), "at").join(last, "shard", "left")
    first, head = done + F.col("_w") * size + 1, F.max("_last").over(Window.partitionBy("shard"))
    windows = windows.select(
        "shard", (F.coalesce("_before.idx", F.lit(0)) + F.col("_w") + 1).alias("idx"), first.alias("first_seq"), F.least(first + size - 1, head).alias("last_seq"), "size", "merkle_root",
        F.col("at").cast("string").alias("sealed_at"), F.coalesce("_before.checkpoint_hash", F.lit(GENESIS)).alias("_head"),
    )
    windows = windows if force else windows.filter(F.col("last_seq") - F.col("first_seq") == size - 1)
    schema = SCHEMA.format(dict(ledger.dtypes)["shard"])
    names = [c.split()[0] for c in schema.split(", ")]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, prev = None, GENESIS
        for batch in batches:
            rows, made = batch.to_pydict(), {"prev_hash": [], "checkpoint_hash": [], "body": []}
            for i, shard in enumerate(rows["shard"]):
                if (shard,) != here:
                    here, prev = (shard,), rows["_head"][i]
                body = canonical(rows["first_seq"][i], rows["idx"][i], rows["last_seq"][i], log, rows["merkle_root"][i], prev, rows["sealed_at"][i], rows["size"][i])
                made["prev_hash"].append(prev)
                prev = hashlib.sha256(body.encode()).hexdigest()
                made["checkpoint_hash"].append(prev)
                made["body"].append(body)
            texts = {k: pa.array(v, pa.string()) for k, v in made.items()}
            yield pa.RecordBatch.from_arrays([texts[n] if n in texts else batch.column(n) for n in names], names=names)

    return windows.repartition("shard").sortWithinPartitions("shard", "idx").mapInArrow(link, schema)


def members(ledger: DataFrame, ranges: DataFrame, width: int = SIZE) -> DataFrame:
    """Records with the ranges (shard, idx, first_seq, last_seq) that hold them.

    Both meet by the blocks of ``width`` numbers that they share, so the range join is one of equal keys. Ranges must not be longer than LONGEST.
    """
    blocks = F.sequence(F.floor(F.col("first_seq") / width), F.floor(F.col("last_seq") / width))
    cut = ranges.select("shard", "idx", F.col("first_seq").alias("_a"), F.col("last_seq").alias("_z"), F.explode(blocks).alias("_block"))
    records = ledger.withColumn("_block", F.floor(F.col("sequence_num") / width))
    return records.join(cut, ["shard", "_block"]).filter(F.col("sequence_num").between(F.col("_a"), F.col("_z"))).drop("_block", "_a", "_z")


def verify(sealed: DataFrame, ledger: DataFrame, width: int = SIZE) -> DataFrame:
    """(shard, idx, problem) of stored checkpoints against the ledger as it is now."""
    read = sealed.withColumn("b", F.from_json("body", _BODY)).withColumn("_text", F.try_parse_json("body").isNotNull())
    order = Window.partitionBy("shard").orderBy("idx")
    # an unreadable text ends nothing: the next one is held against the last that can be read
    before = lambda c: F.last(F.when(F.col("_text"), c), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    read = read.withColumn("_prev", F.coalesce(before(F.col("checkpoint_hash")), F.lit(GENESIS))).withColumn("_after", before(F.col("b.last_seq")) + 1)
    believed = F.col("_text") & (F.col("b.last_seq") - F.col("b.first_seq")).between(0, LONGEST - 1)
    ranges = read.filter(believed).select("shard", "idx", F.col("b.first_seq").alias("first_seq"), F.col("b.last_seq").alias("last_seq"))
    held = members(ledger.select("shard", "sequence_num", "record_hash"), ranges, width)
    now = rooted(held, ("shard", "idx")).select("shard", "idx", F.col("size").alias("_size"), F.col("merkle_root").alias("_root"))
    rows = read.join(now, ["shard", "idx"], "left")
    stored = F.coalesce("_size", F.lit(0))
    differ = lambda a, b: ~F.coalesce(a.eqNullSafe(b), F.lit(False))
    say = lambda c, text: F.when(c, F.lit(text))
    columns = [differ(F.col(f"b.{a}"), F.col(b)) for a, b in (("index", "idx"), ("first_seq", "first_seq"), ("last_seq", "last_seq"), ("merkle_root", "merkle_root"))]
    found = F.array_compact(F.array(
        say(F.sha2("body", 256) != F.col("checkpoint_hash"), "its hash is not that of its text"),
        say(columns[0] | columns[1] | columns[2] | columns[3], "its columns differ from its text"),
        say(differ(F.col("b.prev_checkpoint"), F.col("_prev")), "it does not follow the one before it"),
        say(F.col("_after").isNotNull() & differ(F.col("b.first_seq"), F.col("_after")), "records before it are in no checkpoint, or in two"),
        F.when(differ(F.col("b.size"), stored), "it covers other numbers of records than are stored").when(differ(F.col("b.merkle_root"), F.col("_root")), "records that it covers were changed"),
    ))
    problems = F.when(~F.col("_text"), F.array(F.lit("its text cannot be read"))).otherwise(found)
    return rows.select("shard", "idx", F.explode(problems).alias("problem"))


def sealing_writer(ledger_path: str, sealed_path: str, size: int = SIZE, force: bool = False, log: str = "log") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch of the ledger is stored and what is due is sealed.

    Records that no window covers yet are put beside the checkpoints, so a batch reads those and itself, not the ledger. A folder for each
    batch is written anew when a batch comes again, and only earlier batches are looked at, so a failure between two writes loses and
    doubles nothing.
    """

    def earlier(path: str, batch_id: int, like: DataFrame) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return like.sparkSession.read.schema(like.schema.add("batch", "long") if "batch" not in like.columns else like.schema).parquet(path).filter(F.col("batch") < batch_id)
        except AnalysisException:  # nothing is stored yet
            return like.limit(0).withColumn("batch", F.lit(-1).cast("long"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, folder = batch.sparkSession, f"batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{ledger_path}/{folder}")
        here = spark.read.schema(batch.schema).parquet(f"{ledger_path}/{folder}").select("shard", "sequence_num", "record_hash", "at")
        sealed = earlier(sealed_path, batch_id, empty(here)).drop("batch")
        waiting = earlier(f"{sealed_path}_open", batch_id, here)
        last = waiting.agg(F.max("batch")).first()[0]
        rows = waiting.filter(F.col("batch") == (-1 if last is None else last)).drop("batch").unionByName(here)
        seal(rows, sealed, size, force, log).write.mode("overwrite").parquet(f"{sealed_path}/{folder}")
        new = spark.read.schema(sealed.schema).parquet(f"{sealed_path}/{folder}").unionByName(sealed)
        done = new.groupBy("shard").agg(F.max("last_seq").alias("_done"))
        left = rows.join(done, "shard", "left").filter(F.col("sequence_num") > F.coalesce("_done", F.lit(0))).drop("_done")
        left.write.mode("overwrite").parquet(f"{sealed_path}_open/{folder}")

    return write


def sealed_so_far(sealed: DataFrame, ledger: DataFrame) -> DataFrame:
    """(shard, checkpoints, sealed, head, unsealed) of every shard."""
    s = sealed.groupBy("shard").agg(F.count("*").alias("checkpoints"), F.max("last_seq").alias("sealed"))
    h = ledger.groupBy("shard").agg(F.max("sequence_num").alias("head"))
    zero: Callable[[str], Column] = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return h.join(s, "shard", "left").select("shard", zero("checkpoints"), zero("sealed"), "head", (F.col("head") - F.coalesce("sealed", F.lit(0))).alias("unsealed"))
