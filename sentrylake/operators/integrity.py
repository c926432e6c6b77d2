"""Hash chain, Merkle checkpoints and the delivery ledger.

A chain is sequential within a shard, so records are chained per shard (one ordered fold each); verifying one is not: each record is
checked against its stored predecessor, which one window gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.session import ship

from .ordered import running_sum, with_previous

GENESIS = "0" * 64
#: Ids of batches that are one block of an order over all of them.
BLOCK = 100_000


def block_of(key: str) -> Column:
    return F.floor(F.col(key) / BLOCK)


def canonical_json(columns: list[str]) -> Column:
    """Compact JSON of the columns with sorted keys and nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def stored_raw_hash(text: Column, encoding: Column, hash_of: Column) -> Column:
    """``bytes``: of the received bytes, which the text in its encoding gives back; older rows: of the text in UTF-8."""
    latin = F.when(F.lower(encoding).isin("latin-1", "iso-8859-1"), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return F.sha2(F.when(hash_of == "bytes", latin).otherwise(F.encode(text, "UTF-8")), 256)


def record_hash(prev: Column, sequence: Column, raw_hash: Column, body: Column) -> Column:
    return F.sha2(F.concat_ws(":", prev, sequence.cast("string"), raw_hash, body), 256)


def chain(records: DataFrame, shard: str = "shard") -> DataFrame:
    """records (shard, sequence_num, raw_hash, body) with prev_hash and record_hash, each shard from GENESIS on.

    A task folds its sorted rows batch by batch and keeps one hash, so a shard of any length needs the memory of a batch.
    """
    import pyarrow as pa

    ship(records.sparkSession)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, prev = None, GENESIS
        for batch in batches:
            before, made = [], []
            for key, seq, raw, body in zip(*[batch.column(c).to_pylist() for c in (shard, "sequence_num", "raw_hash", "body")], strict=True):
                if (key,) != here:
                    here, prev = (key,), GENESIS
                before.append(prev)
                prev = hashlib.sha256(f"{prev}:{seq}:{raw}:{body}".encode()).hexdigest()
                made.append(prev)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(made, pa.string())], names=list(kinds))

    rows = records.drop("prev_hash", "record_hash")
    kinds = {**dict(rows.dtypes), "prev_hash": "string", "record_hash": "string"}
    return rows.repartition(shard).sortWithinPartitions(shard, "sequence_num").mapInArrow(fold, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))


def verify_chain(ledger: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, sequence_num, issue): what is wrong, from each record and the one before it.

    ledger: shard, sequence_num, raw_hash, prev_hash, record_hash, raw_text, body; a null raw_text or body is missing.
    """
    order = Window.partitionBy(shard).orderBy("sequence_num")
    expected_prev = F.coalesce(F.lag("record_hash").over(order), F.lit(GENESIS))
    expected_seq = F.coalesce(F.lag("sequence_num").over(order) + 1, F.first("_start").over(order) if "_start" in ledger.columns else F.lit(1))
    rows = ledger.withColumn("_prev", expected_prev).withColumn("_seq", expected_seq)
    issue = lambda c, name: F.when(c, F.lit(name))
    raw = F.sha2(F.encode("raw_text", "UTF-8"), 256)
    made = record_hash(F.col("prev_hash"), F.col("sequence_num"), F.col("raw_hash"), F.col("body"))
    found = F.array_compact(F.array(
        issue(F.col("sequence_num") != F.col("_seq"), "SEQUENCE_GAP_OR_REORDER"),
        F.when(F.col("raw_text").isNull(), F.lit("RAW_PAYLOAD_MISSING")).otherwise(issue(raw != F.col("raw_hash"), "RAW_HASH_MISMATCH")),
        issue(F.col("prev_hash") != F.col("_prev"), "BROKEN_CHAIN"),
        F.when(F.col("body").isNull(), F.lit("NORMALIZED_DATA_MISSING")).otherwise(issue(made != F.col("record_hash"), "HASH_MISMATCH")),
    ))
    return rows.select(shard, "sequence_num", F.explode(found).alias("issue"))


def verification(ledger: DataFrame, shard: str = "shard") -> DataFrame:
    """Per shard: records, failed records, first corrupted sequence and whether the chain is valid."""
    bad = verify_chain(ledger, shard).groupBy(shard).agg(F.count_distinct("sequence_num").alias("failed"), F.min("sequence_num").alias("first_corrupted"))
    n = ledger.groupBy(shard).agg(F.count("*").alias("records"))
    failed = F.coalesce("failed", F.lit(0))
    return n.join(bad, shard, "left").select(shard, "records", failed.alias("failed"), "first_corrupted", (failed == 0).alias("is_valid"))


# Merkle trees as in RFC 9162: 00 before leaves, 01 before inner nodes, the left part a power of two.


def leaf_hash(data: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + data).digest()


def node_hash(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Bottom up: neighbours are paired and an odd last node moves up, which gives the same tree."""
    level = [leaf_hash(x) for x in leaves]
    if not level:
        return hashlib.sha256(b"").digest()
    while len(level) > 1:
        level = [node_hash(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def inclusion_path(index: int, leaves: list[bytes]) -> list[bytes]:
    """The siblings from the leaf to the root."""
    level, path = [leaf_hash(x) for x in leaves], []
    while len(level) > 1:
        if index ^ 1 < len(level):
            path.append(level[index ^ 1])
        level = [node_hash(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        index //= 2
    return path


def verify_inclusion(index: int, size: int, leaf: bytes, path: list[bytes], root: bytes) -> bool:
    if not 0 <= index < size:
        return False
    here, rest = leaf_hash(leaf), iter(path)
    while size > 1:
        if index ^ 1 < size:
            other = next(rest, None)
            if other is None:
                return False
            here = node_hash(other, here) if index & 1 else node_hash(here, other)
        index, size = index // 2, (size + 1) // 2
    return here == root and next(rest, None) is None


def rooted(rows: DataFrame, keys: tuple[str, ...], latest: str | None = None) -> DataFrame:
    """``keys``, _first, _last, size and merkle_root of the records (sequence_num, record_hash) of each group: _first and _last are its least and
    greatest number; and the greatest value of the column ``latest``, where one is named.

    A task walks over its sorted rows and holds the leaves of one group at a time.
    """
    import pyarrow as pa

    ship(rows.sparkSession)
    told = F.lit(None).cast("long") if latest is None else F.col(latest)
    made = rows.select(*keys, "sequence_num", "record_hash", told.alias("_latest"))
    kinds = dict(made.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", _first long, _last long, size long, merkle_root string, _latest {kinds['_latest']}"
    made = made.repartition(*keys).sortWithinPartitions(*keys, "sequence_num")
    width = len(keys)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, leaves, newest, out, types = None, [], [], None, [], None

        def close() -> None:
            out.append((*key, numbers[0], numbers[-1], len(leaves), merkle_root(leaves).hex(), newest))

        def table() -> pa.RecordBatch:
            wanted = [*types[:-1], pa.int64(), pa.int64(), pa.int64(), pa.string(), types[-1]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), wanted, strict=True)], names=[*keys, "_first", "_last", "size", "merkle_root", "_latest"])

        for batch in batches:
            types = [batch.schema.field(i).type for i in (*range(width), width + 2)]
            for *at, number, record, told in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at != key:
                    if key is not None:
                        close()
                    key, numbers, leaves, newest = at, [], [], None
                numbers.append(number)
                leaves.append(f"{number}:{record}".encode())
                newest = told if newest is None or (told is not None and told > newest) else newest
            if out:
                yield table()
                out.clear()
        if key is not None:
            close()
            yield table()

    got = made.mapInArrow(walk, schema)
    return got.drop("_latest") if latest is None else got.withColumnRenamed("_latest", latest)


def checkpoints(ledger: DataFrame, shard: str = "shard", size: int = 1000) -> DataFrame:
    """(shard, idx, first_seq, last_seq, leaves, root) of each full or last group of ``size`` sequence numbers."""
    rows = ledger.select(shard, F.floor((F.col("sequence_num") - 1) / size).cast("long").alias("idx"), "sequence_num", "record_hash")
    names = [shard, "idx", F.col("_first").alias("first_seq"), F.col("_last").alias("last_seq"), F.col("size").alias("leaves"), F.col("merkle_root").alias("root")]
    return rooted(rows, (shard, "idx")).select(*names)


def covering(records: DataFrame, sealed: DataFrame, shard: str = "shard", size: int = 1000) -> DataFrame:
    """Each record with the checkpoint whose range holds it; the group number makes the range join an equi-join."""
    rows = records.withColumn("idx", F.floor((F.col("sequence_num") - 1) / size).cast("long"))
    got = rows.join(sealed.select(shard, "idx", "first_seq", "last_seq", "root"), [shard, "idx"], "left")
    inside = F.col("sequence_num").between(F.col("first_seq"), F.col("last_seq"))
    return got.withColumn("root", F.when(inside, F.col("root"))).drop("first_seq", "last_seq")


def verify_checkpoints(sealed: DataFrame, ledger: DataFrame, shard: str = "shard", size: int = 1000) -> DataFrame:
    """Each stored checkpoint beside the root and range that the ledger gives now."""
    now = checkpoints(ledger, shard, size).select(shard, "idx", F.col("root").alias("root_now"), F.col("leaves").alias("leaves_now"))
    same = (F.col("root") == F.col("root_now")) & (F.col("leaves") == F.col("leaves_now"))
    return sealed.join(now, [shard, "idx"], "full_outer").select(shard, "idx", "root", "root_now", F.coalesce(same, F.lit(False)).alias("ok"))


def witness_compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """agree, differ, pending (not signed yet) or missing here, per checkpoint."""
    both = ours.select("idx", F.col("root").alias("ours")).join(theirs.select("idx", F.col("root").alias("theirs")), "idx", "full_outer")
    state = (
        F.when(F.col("theirs").isNull(), "pending").when(F.col("ours").isNull(), "missing here").when(F.col("ours") == F.col("theirs"), "agree").otherwise("differ")
    )
    return both.select("idx", state.alias("state"))


# Delivery ledger


def events_hash() -> Column:
    """Of the rows of a group with sequence_num and event_uid: their sorted seq:uid lines."""
    keys = F.array_sort(F.collect_list(F.struct("sequence_num", "event_uid")))
    return F.sha2(F.array_join(F.transform(keys, lambda k: F.concat_ws(":", k["sequence_num"].cast("string"), k["event_uid"])), "\n"), 256)


def batch_hash(prev: Column) -> Column:
    return F.sha2(F.concat_ws(":", prev, "output", "outcome", "trigger", F.col("at").cast("string"), F.col("count").cast("string"), "events_hash"), 256)


def owed(outputs: DataFrame, events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(output, sequence_num) of events at or after an output's first owed sequence that have no outcome there."""
    due = events.select("sequence_num").join(F.broadcast(outputs), F.col("sequence_num") >= F.col("first_sequence")).select("output", "sequence_num")
    return due.join(deliveries.select("output", "sequence_num").distinct(), ["output", "sequence_num"], "left_anti")


def latest_outcome(deliveries: DataFrame) -> DataFrame:
    """(output, outcome, n): events by their last outcome."""
    last = deliveries.groupBy("output", "sequence_num").agg(F.max_by("outcome", "id").alias("outcome"))
    return last.groupBy("output", "outcome").agg(F.count("*").alias("n"))


def delivered_twice(deliveries: DataFrame) -> DataFrame:
    n = deliveries.filter("outcome = 'delivered'").groupBy("output", "sequence_num").agg(F.count("*").alias("times"))
    return n.filter("times > 1")


def reconcile(outputs: DataFrame, events: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Per output: owed = delivered + rerouted + filtered + dead_lettered + in_flight; ``unaccounted`` should be 0."""
    due = events.select("sequence_num").join(F.broadcast(outputs), F.col("sequence_num") >= F.col("first_sequence")).groupBy("output").agg(F.count("*").alias("owed"))
    kinds = ("delivered", "dead_lettered", "rerouted", "filtered")
    got = latest_outcome(deliveries).groupBy("output").agg(*[F.sum(F.when(F.col("outcome") == k, F.col("n")).otherwise(0)).alias(k) for k in kinds])
    missing = owed(outputs, events, deliveries).groupBy("output").agg(F.count("*").alias("in_flight"))
    out = due.join(got, "output", "left").join(missing, "output", "left")
    zero = {k: F.coalesce(k, F.lit(0)) for k in (*kinds, "in_flight")}
    return out.select("output", "owed", *[v.alias(k) for k, v in zero.items()], (F.col("owed") - sum(zero.values())).alias("unaccounted"))


def episodes(batches: DataFrame) -> DataFrame:
    """Batches that were not plain live deliveries, merged while output, outcome, trigger and reason stay the same (gaps and islands)."""
    odd = batches.filter(~((F.col("outcome") == "delivered") & (F.col("trigger") == "live")) & (F.col("outcome") != "filtered"))
    key = F.concat_ws("\x1f", "output", "outcome", "trigger", F.coalesce("detail", F.lit("")))
    marked = with_previous(odd.withColumn("k", key), block_of("id"), "id", {"was": F.col("k")})
    marked = marked.withColumn("new", F.when(F.col("was").eqNullSafe(F.col("k")), 0).otherwise(1))
    numbered = running_sum(marked, block_of("id"), "id", "new", "episode")
    return numbered.groupBy("episode", "output", "outcome", "trigger", F.coalesce("detail", F.lit("")).alias("detail")).agg(
        F.min_by("at", "id").alias("since"), F.max_by("at", "id").alias("until"), F.count("*").alias("batches"), F.sum("count").alias("count")
    )


def verify_deliveries(batches: DataFrame, rows: DataFrame) -> DataFrame:
    """(batch, problem) of a delivery ledger: five kinds."""
    seen = rows.groupBy(F.col("batch_id").alias("id")).agg(F.count("*").alias("n"), events_hash().alias("rows_hash"), F.collect_set("outcome").alias("outcomes"))
    b = with_previous(batches, block_of("id"), "id", {"_prev": F.col("batch_hash")})
    b = b.withColumn("_prev", F.coalesce("_prev", F.lit(GENESIS))).withColumn("_known", F.lit(True))
    both = b.join(seen, "id", "full_outer")
    empty = F.sha2(F.lit(""), 256)
    problems = F.when(F.col("_known").isNull(), F.array(F.lit("rows of a missing batch"))).otherwise(F.array_compact(F.array(
        F.when(F.col("prev_hash") != F.col("_prev"), "chain broken"),
        F.when((F.coalesce("n", F.lit(0)) != F.col("count")) | (F.coalesce("rows_hash", empty) != F.col("events_hash")), "event rows changed"),
        F.when(F.exists(F.coalesce("outcomes", F.array().cast("array<string>")), lambda o: o != F.col("outcome")), "outcome edited"),
        F.when(batch_hash(F.col("prev_hash")) != F.col("batch_hash"), "batch edited"),
    )))
    return both.select(F.col("id").alias("batch"), F.explode(problems).alias("problem"))
