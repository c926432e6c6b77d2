"""Line deduplication over levelled sorted runs of line hashes.

A run is a table of (key hash, documents, largest doc_id), bucketed and sorted by hash, so that runs are merged without moving
them again. A batch of documents is merge-anti-joined with all runs: keys that are new to them become a run of level 0, and what
the batch says of known keys is put beside them. When a level holds ``FANOUT`` runs they are compacted into one of the next level, so
runs never share a key and a hash is rewritten a logarithmic number of times however many batches come.

The key of a line is the line without white space at both ends, with A-Z lower-cased; keys are compared by 128 bits of
hash. A key of at least MIN_CHARS code points in at least MIN_DOCS documents loses all its lines but those in the largest
doc_id that holds it. A null text is one empty line. Rows that repeat a doc_id count as one document, and each loses the lines of
its own text; a null doc_id is a document that is never the largest. An empty table gives an empty table; further columns pass
through, but for those with the names of the results, which the results replace.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Shared

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 20
MIN_DOCS = 3
FANOUT, BATCHES = 2, 4
_KEY = ("h1", "h2")


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_rows(docs: DataFrame, batches: int = 1) -> DataFrame:
    """(batch, h1, h2, doc_id, t, pos) of every line whose key is long enough; pos counts from 0, t is a hash of the text."""
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    lines = docs.select(batch, "doc_id", F.xxhash64("text").alias("t"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("batch", "doc_id", "t", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= MIN_CHARS)
    return keys.select("batch", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "t", "pos")


class Runs:
    """The levelled runs. ``add`` takes key rows of batches with disjoint doc_ids."""

    def __init__(self, spark: SparkSession, shared: Shared | None = None, fanout: int = FANOUT):
        self.shared, self.fanout = shared or Shared(spark, "lines"), fanout
        self.levels: list[list[DataFrame]] = []
        self.again: list[DataFrame] = []

    def add(self, keys: DataFrame) -> None:
        by_doc = keys.select(*_KEY, "doc_id").distinct()
        counted = by_doc.groupBy(*_KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        batch = self.shared.save_sorted(counted, "batch", *_KEY)
        new, runs = batch, self.all()
        for run in runs:
            new = new.join(run.select(*_KEY), list(_KEY), "left_anti")
        new = self.shared.save_sorted(new, "new", *_KEY, dealt=True)
        if runs:
            self.again.append(self.shared.save_sorted(batch.join(new.select(*_KEY), list(_KEY), "left_anti"), "again", *_KEY, dealt=True))
        self.shared.drop(batch)
        self._put(new, 0)

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            self.compact(level)

    def compact(self, level: int) -> None:
        """Merge a level's runs, which share no key, into one run of the next level."""
        old, self.levels[level] = self.levels[level], []
        merged = old[0]
        for run in old[1:]:
            merged = merged.join(run.withColumnsRenamed({"n_docs": "n", "last_doc": "last"}), list(_KEY), "full")
            merged = merged.select(*_KEY, F.coalesce("n_docs", "n").alias("n_docs"), F.coalesce("last_doc", "last").alias("last_doc"))
        self._put(self.shared.save_sorted(merged, f"run-l{level + 1}", *_KEY, dealt=True), level + 1)
        self.shared.drop(*old)

    def all(self) -> list[DataFrame]:
        """The runs; every known key is in one of them, as its first batch had it."""
        return [r for level in self.levels for r in level]

    def repeated(self) -> DataFrame:
        """(h1, h2, last_doc) of the keys that are in MIN_DOCS documents or more."""
        found = reduce(DataFrame.unionByName, map(self.shared.plain, [*self.all(), *self.again]))
        found = found.groupBy(*_KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return found.filter(F.col("n_docs") >= MIN_DOCS).select(*_KEY, "last_doc")


def dedup(docs: DataFrame, keys: DataFrame, runs: Runs) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; ``keys`` are its key rows.

    The repeated keys are written first: both sides of the join are then plain exchanges, so a key that a third of the
    lines share is split by adaptive execution. Only the positions to drop travel to the texts.
    """
    hot = runs.shared.save(runs.repeated(), "repeated")
    hits = keys.join(hot, list(_KEY)).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    drops = hits.groupBy(F.col("doc_id").alias("id"), F.col("t").alias("of")).agg(F.collect_set("pos").alias("drop"))
    carried = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.xxhash64("text").alias("t"))
    out = rows.join(drops, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("of")), "left").select("row", "drop", lines_of(F.col("row.text")).alias("lines"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get(F.col("lines"), i))
    return out.select(
        *[F.col("row").getField(c).alias(c) for c in carried],
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("drop")).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )


def dedup_table(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """All of ``docs``: its runs are built in batches by a hash of doc_id, then its lines are joined with them."""
    runs = Runs(docs.sparkSession)
    keys = runs.shared.save(key_rows(docs, batches), "keys", "batch")
    for b in range(batches):
        runs.add(keys.filter(F.col("batch") == b))
    return dedup(docs, keys, runs)


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.*, c.last_doc IS NOT NULL AND c.last_doc <> k.doc_id AS gone FROM k LEFT JOIN c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
