"""Structured Streaming: parse, window with watermark, drop repeats, chain per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sentrylake.operators import integrity, packs
from sentrylake.session import scratch_dir


def parsed(lines: DataFrame, raw: str = "value") -> DataFrame:
    """One projection from lines to canonical fields; a line that no pack reads stays, with nulls."""
    return lines.withColumn("p", packs.parse_column(raw))


def windows(events: DataFrame, width: str = "5 minutes", late: str = "30 seconds", time: str = "ts") -> DataFrame:
    """Counts per source address and window; windows close ``late`` after their end. Destinations are counted exactly, so the state of
    an open window holds them."""
    rows = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "src_ip")
    return rows.agg(F.count("*").alias("events"), F.sum("bytes_out").alias("bytes_out"), F.size(F.collect_set("dst_ip")).alias("dst_ips")).select(
        "src_ip", F.unix_millis("w.start").alias("window_start_ms"), "events", "bytes_out", "dst_ips"
    )


def once(findings: DataFrame, key: str = "finding_uid", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Findings of rescored windows come again with the same id; only the first passes."""
    return findings.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def drain(rows: DataFrame, what: str) -> DataFrame:
    """A stream of rows run to its end, as a table of files in the shared folder, where its state and offsets are as well."""
    at = scratch_dir(rows.sparkSession, what)
    writer = rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/rows")


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Micro-batches to ``write(batch, id)``; without ``every`` all that is there now. A batch may come again after a
    failure, so ``write`` must be idempotent by its id."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def chain_batch(batch: DataFrame, heads: DataFrame, shard: str = "shard") -> DataFrame:
    """A batch's records chained on to each shard's head: (shard, sequence_num, record_hash) of its last record.

    Records of a shard are ordered and numbered within the batch, so one task a shard makes the hashes.
    """
    import pandas as pd

    last = heads.select(shard, F.col("sequence_num").alias("_seq"), F.col("record_hash").alias("_head"))
    rows = batch.join(F.broadcast(last), shard, "left")
    kinds = dict(batch.dtypes) | {"sequence_num": "long", "prev_hash": "string", "record_hash": "string"}

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        pdf = pdf.sort_values("arrival")
        first = pdf.iloc[0]
        seq = 0 if pd.isna(first["_seq"]) else int(first["_seq"])
        prev = integrity.GENESIS if pd.isna(first["_head"]) else first["_head"]
        numbers, before, made = [], [], []
        for raw, body in zip(pdf["raw_hash"], pdf["body"], strict=True):
            seq += 1
            numbers.append(seq)
            before.append(prev)
            prev = hashlib.sha256(f"{prev}:{seq}:{raw}:{body}".encode()).hexdigest()
            made.append(prev)
        return pdf.assign(sequence_num=numbers, prev_hash=before, record_hash=made)[list(kinds)]

    return rows.groupBy(shard).applyInPandas(fold, ", ".join(f"`{c}` {t}" for c, t in kinds.items()))
