"""An inverted index on disk: postings by word, added to by batch, searched by the few buckets that a term's words are in.

A word's bucket follows from its first two letters, so the words that begin with a term's last word are in one bucket too. Files are
partitioned by bucket and sorted by word, so a search prunes buckets first and then row groups. A batch's postings are dealt by ranges of (bucket, word,
key): a word that every text has is spread over tasks and files. A batch written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import words

BUCKETS, LETTERS = 64, 2
#: So many found keys at most are told to every task; more meet the events by an exchange.
NAMED = 100_000
SCHEMA = "word string, key long, field int, pos int"


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(word, 1, LETTERS)), F.lit(BUCKETS)).cast("int")


def postings(events: DataFrame, fields: tuple[str, ...], key: str = "event_id") -> DataFrame:
    """(word, key, field, pos, bucket) of the words of some columns; null texts have none."""
    texts = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"`{c}`").cast("string").alias("text")) for i, c in enumerate(fields)])
    rows = events.select(F.col(key).cast("long").alias("key"), F.inline(texts)).filter("text IS NOT NULL")
    rows = rows.select("key", "field", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return rows.select("word", "key", "field", "pos", _bucket(F.col("word")).alias("bucket"))


def add(events: DataFrame, path: str, batch: int, fields: tuple[str, ...], key: str = "event_id") -> None:
    """Put a batch of events into the index; the same batch again replaces what it put there."""
    order = ("bucket", "word", "key")
    rows = postings(events, fields, key).repartitionByRange(*order).sortWithinPartitions(*order, "field", "pos")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/batch={batch}")


def compact(spark: SparkSession, path: str, into: str) -> None:
    """All batches of an index as one batch of a new index, with as few files a bucket as their size needs."""
    order = ("bucket", "word", "key")
    rows = opened(spark, path).drop("batch").repartitionByRange(*order).sortWithinPartitions(*order, "field", "pos")
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{into}/batch=0")


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The index as a table."""
    return spark.read.schema(f"{SCHEMA}, batch int, bucket int").parquet(path)


def term_words(spark: SparkSession, term: str) -> list[str]:
    return spark.range(1).select(words(F.lit(term)).alias("w")).first()["w"]


def match(index: DataFrame, term: str, fields: tuple[int, ...] | None = None) -> DataFrame:
    """Keys of texts that have the term's words next to each other, the last one as a prefix; ``fields`` are places of columns."""
    spark = index.sparkSession
    parts = term_words(spark, term)
    if not parts:
        return index.select("key").limit(0)
    whole = len(parts[-1]) >= LETTERS
    wanted = sorted({w[:LETTERS] for w in parts})
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(_bucket(F.col("w"))).distinct().collect()]
    found = index.filter(F.col("bucket").isin(buckets)) if whole else index  # one letter may begin words of any bucket
    is_part = [F.col("word").startswith(w) if i == len(parts) - 1 else F.col("word") == w for i, w in enumerate(parts)]
    any_part = is_part[0]
    for c in is_part[1:]:
        any_part = any_part | c
    if fields is not None:
        found = found.filter(F.col("field").isin(*fields))
    at = F.array_compact(F.array(*[F.when(c, F.struct((F.col("pos") - i).alias("start"), F.lit(1 << i).cast("long").alias("bit"))) for i, c in enumerate(is_part)]))
    rows = found.filter(any_part).select("key", "field", F.inline(at))
    if len(parts) == 1:
        return rows.select("key").distinct()
    hits = rows.groupBy("key", "field", "start").agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") == (1 << len(parts)) - 1)
    return hits.select("key").distinct()


def events_of(events: DataFrame, index: DataFrame, term: str, fields: tuple[int, ...] | None = None, key: str = "event_id") -> DataFrame:
    """The events whose texts match the term."""
    keys = match(index, term, fields).withColumnRenamed("key", key)
    few = keys.limit(NAMED + 1).count() <= NAMED
    return events.join(F.broadcast(keys) if few else keys.hint("merge"), key, "left_semi")
