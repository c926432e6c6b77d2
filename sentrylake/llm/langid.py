"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 2, 1 and 0: a byte is coded in the longest known context, with an escape (method
C, bytes of the longer context excluded) to the next shorter one and at last to all bytes alike. The statistics are frozen
after training, so the exact code length of a byte depends on its context alone and is tabulated once; a text's score is
the posterior of its shortest code under equal priors.

The trees are learned from at most SAMPLE_DOCS whole documents of each language, those with the smallest hash of doc_id.
A text that is null or has no letter is ``und`` with score 0, as is every text when nothing was learned. Repeated rows
get equal answers, and lang is read for training only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship
from .words import slices

SAMPLE_DOCS = 400
UNKNOWN = "und"


def fold(x: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the two-byte capitals of Latin-1 lower-cased, and white space as one kind."""
    out = x.copy()
    out[(x >= 65) & (x <= 90)] += 32
    after = np.zeros(len(x), bool)
    after[1:] = x[:-1] == 0xC3
    out[after & (x >= 0x80) & (x <= 0x9E)] += 32
    out[(x >= 9) & (x <= 13)] = 32
    return out


def contexts(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The two bytes before each byte as one number; before a text's start there are spaces."""
    one, two = np.empty_like(x), np.empty_like(x)
    one[1:], two[2:] = x[:-1], x[:-2]
    one[starts], two[starts] = 32, 32
    second = starts + 1
    two[second[second < len(x)]] = 32
    return two.astype(np.int32) << 8 | one


class Trees:
    """Code lengths in bits: ``bits[language, context, byte]``; ``row_of`` gives the context of two bytes."""

    def __init__(self, texts: dict[str, list[bytes]]):
        self.langs = sorted(texts)
        keys, counts = [], []
        for lang in self.langs:
            raw = [t for t in texts[lang] if t]
            x = fold(np.frombuffer(b"".join(raw), np.uint8))
            starts = np.cumsum([0, *map(len, raw)])[:-1].astype(np.int64)
            k, c = np.unique(contexts(x, starts) << 8 | x, return_counts=True) if len(x) else (np.empty(0, np.int64), np.empty(0, np.int64))
            keys.append(k)
            counts.append(c)
        seen = np.unique(np.concatenate([k >> 8 for k in keys])) if keys else np.empty(0, np.int64)
        n = len(seen)
        self.row_of = (n + (np.arange(1 << 16) & 255)).astype(np.int32)
        self.row_of[seen] = np.arange(n)
        self.bits = np.zeros((len(self.langs), n + 256, 256), np.float32)
        last = np.concatenate([seen & 255, np.arange(256)]).astype(np.int64)
        for i, (k, c) in enumerate(zip(keys, counts, strict=True)):
            two = np.zeros((n + 256, 256))
            two[self.row_of[k >> 8], k & 255] = c
            one = np.zeros((256, 256))
            np.add.at(one, ((k >> 8) & 255, k & 255), c)
            self.bits[i] = -np.log2(self._coded([two, one[last], np.broadcast_to(one.sum(0), (n + 256, 256))]))

    @staticmethod
    def _coded(orders: list[np.ndarray]) -> np.ndarray:
        """Probability of each byte in each row, from the longest context to the shortest."""
        p = np.zeros(orders[0].shape)
        left, free = np.ones(len(p)), np.ones(p.shape, bool)
        for counts in orders:
            counts = np.where(free, counts, 0)
            total, kinds = counts.sum(1), (counts > 0).sum(1)
            there = kinds > 0
            below = np.where(there, total + kinds, 1)
            p += (left / below)[:, None] * counts
            left = np.where(there, left * kinds / below, left)
            free &= counts == 0
        spare = np.maximum(free.sum(1), 1)
        return p + np.where(free, (left / spare)[:, None], 0)

    def code_lengths(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each text (texts lie one after the other, none empty) under each language."""
        x = fold(x)
        at = self.row_of[contexts(x, starts)] * 256 + x
        return np.stack([np.add.reduceat(table.ravel()[at], starts, dtype=np.float64) for table in self.bits])


def training_rows(docs: DataFrame, is_training: Column, per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """At most per_lang documents of each language. A threshold on the hash keeps twice as many on average, whatever the
    language's share, before they are ranked."""
    known = docs.filter(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    u = F.shiftrightunsigned(F.xxhash64(F.lit(10), "doc_id"), 11).cast("double") / F.lit(float(1 << 53))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return known.select("lang", "text").limit(0)
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 2.0 * per_lang / n)])
    few = known.withColumn("_u", u).filter(F.col("_u") < F.element_at(share, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id", "text"))
    return few.withColumn("_r", rank).filter(F.col("_r") <= per_lang).select("lang", "text")


def train(docs: DataFrame, is_training: Column, per_lang: int = SAMPLE_DOCS) -> Trees:
    texts: dict[str, list[bytes]] = {}
    for row in training_rows(docs, is_training, per_lang).collect():
        texts.setdefault(row["lang"], []).append(row["text"].encode())
    return Trees(texts)


def predict(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees)
    one = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("_text"))
    fields = ", ".join(f"`{c}` {t}" for c, t in one.dtypes if c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                column = part.column("_text").cast(pa.large_binary())
                n = part.num_rows
                best, score = np.full(n, len(t.langs)), np.zeros(n)
                valid = np.asarray(column.is_valid())
                full = pc.drop_null(column)
                if len(full) and t.langs:
                    offsets = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
                    x = np.frombuffer(full.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                    bits = t.code_lengths(x, offsets[:-1] - offsets[0])
                    best[valid] = bits.argmin(0)
                    score[valid] = 1 / np.exp2(np.minimum(bits.min(0) - bits, 0)).sum(0)
                names = pa.array([*t.langs, UNKNOWN]).take(pa.array(best))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], names, pa.array(score)], names=[*keep, "lang_pred", "score"])

    return one.mapInArrow(run, f"{fields}, lang_pred string, score double")
