"""Audit of filters that interact: what each removes alone, after others, and in every order.

Five filters are evaluated once per document and stored as bits; every order of the five is then counted from how often each set
of bits occurs, never from the documents again.

Filter E asks for texts that are identical to a smaller doc_id's. Its classes are found by partition refinement: rows are split by
their number of code points, then by the hash of one block of text after the other (blocks grow by STEP), and rows that are alone in
their class leave after every split. The full texts of what is left are compared, by grouping rows of a class by the text itself,
so the result is exact whatever the hashes do; rows of a class whose texts differ are told apart by them.

A null text is an empty one. A null doc_id is larger than every other, and rows with the smallest id of a text all pass, so repeated rows do
not fail against each other. A null source is the part ''. A document with several labels is good (toxic) if one of them says so; one
without a label, or without a doc_id, is neither. No documents give no rows; further columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import _let, _words
from .shared import Shared

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT, MAX_UPPER, SYMBOLS = 200, 50, 2, "#$%&*|"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Code points of the first block, how much longer each next one is, and the number of blocks; the last takes the rest of a text.
BLOCK, STEP, BLOCKS = 64, 16, 5
CLASS = ["_chars", *[f"_h{k}" for k in range(BLOCKS)]]
#: So many classes at most are told to every task; more are joined by an exchange.
NAMED = 100_000


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _hash(block: Column) -> Column:
    return F.xxhash64(block)


def block_hash(text: Column, k: int) -> Column:
    """Hash of block k (from 0); a text that ends before it has an empty block."""
    start = sum(BLOCK * STEP**i for i in range(k))
    size = BLOCK * STEP**k if k < BLOCKS - 1 else 1 << 30
    return _hash(F.substring(text, start + 1, size))


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""

    def bits(t: Column) -> Column:
        counts = _let(_words(t), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
        upper = F.length(t) - F.length(F.translate(t, UPPER, ""))
        fails = (
            lambda c: c["n"] < MIN_WORDS,
            lambda c: 100 * c["distinct"].cast("long") < MIN_DISTINCT * c["n"].cast("long"),
            lambda c: 100 * upper.cast("long") > MAX_UPPER * F.length(t).cast("long"),
            lambda c: F.length(F.translate(t, SYMBOLS, "")) < F.length(t),
        )
        return _let(counts, lambda c: sum((F.when(f(c), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)), F.lit(0)))

    return _let(text, bits)


def refine(rows: DataFrame, shared: Shared) -> DataFrame:
    """Classes of two rows or more that their length and blocks do not tell apart.

    A split sums counts before its exchange, and only rows of classes with more than one row go on to the next block.
    """
    keys = CLASS[:1]
    for key in [*CLASS[1:], None]:
        sizes = shared.save(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys), "sizes")
        if key is None:
            return sizes
        rows, keys = shared.save(rows.join(sizes, keys, "left_semi"), "left"), [*keys, key]
    raise AssertionError


def _among(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of the classes; few classes are told to every task, more are met by an exchange."""
    few = classes.count() <= NAMED
    return rows.join(F.broadcast(classes) if few else classes.hint("merge"), CLASS, "left_semi")


def with_duplicates(docs: DataFrame, keep: tuple[str, ...], shared: Shared) -> DataFrame:
    """doc_id, ``keep`` and ``bits``, the failures of all five filters, of every row."""
    names = ["doc_id", *keep]
    named = docs.select(*names, _text().alias("_text"))
    split = [F.length("_text").alias(CLASS[0]), *[block_hash(F.col("_text"), k).alias(c) for k, c in enumerate(CLASS[1:])]]
    facts = shared.save(named.select(*names, failures(F.col("_text")).alias("bits"), *split), "facts")
    groups = refine(facts.select(*CLASS), shared)

    # the full texts of a class; those that a task holds more than once meet before the exchange
    texts = _among(named.select("doc_id", "_text", *split), groups).groupBy(*CLASS, "_text").agg(F.min("doc_id").alias("_first"))
    texts = texts.groupBy(*CLASS).agg(F.min("_first").alias("_first"), F.count("*").alias("_texts"))
    texts = shared.save(texts, "texts")
    apart = texts.filter("_texts > 1").select(*CLASS)
    bits = (F.col("bits") + F.when((F.col("doc_id") > F.col("_first")) | (F.col("doc_id").isNull() & F.col("_first").isNotNull()), BIT["E"]).otherwise(0)).alias("bits")
    if apart.isEmpty():
        return facts.join(texts, CLASS, "left").select(*names, bits)
    # texts that differ in a class: each row meets its own text
    rows = shared.save(_among(named.select(*names, "_text", failures(F.col("_text")).alias("bits"), *split), apart), "apart")
    first = shared.save(rows.groupBy(*CLASS, "_text").agg(F.min("doc_id").alias("_first")), "first")
    told = rows.join(first, [*CLASS, "_text"]).select(*names, bits)
    rest = facts.join(apart.hint("merge"), CLASS, "left_anti").join(texts, CLASS, "left").select(*names, bits)
    return told.unionByName(rest)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic`` (0 or 1) by doc_id."""
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    by_id = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    out = rows.join(by_id, "doc_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def audit(rows: DataFrame) -> DataFrame:
    """Counts of every step of every order of the filters in each ``part``; ``rows`` has part, bits, good and toxic.

    Documents are counted by their bits first, so an order costs at most 128 rows of a part.
    """
    counts = rows.groupBy("part", "bits", "good", "toxic").agg(F.count("*").alias("n"))
    steps = [(order, k) for order in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
    step = F.struct(F.col("o").alias("filter_order"), (F.col("k") + 1).alias("step"), *[_bits(f).alias(a) for a, f in (("before", 0), ("bit", 1))])
    orders = F.array(*[F.lit(o) for o in dict.fromkeys(o for o, _ in steps)])
    each = counts.select("*", F.explode(orders).alias("o")).select("*", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("k")).select("*", step.alias("s")).select("*", "s.*")
    fails, reached = (F.col("bits").bitwiseAND(F.col("bit")) != 0), (F.col("bits").bitwiseAND(F.col("before")) == 0)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    # a document that fails m filters is removed by each of them in 120 / m of the orders
    share = F.when(fails, F.col("n") * F.expr("120 DIV bit_count(bits)")).otherwise(0)
    return each.groupBy("part", "filter_order", "step").agg(
        total(reached & ~fails).alias("kept"),
        total(reached & fails).alias("removed"),
        total(~reached & fails).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"),
        total(reached & fails & (F.col("good") == 1)).alias("good_lost"),
        total(reached & fails & (F.col("toxic") == 1)).alias("toxic_lost"),
        F.sum(share).cast("long").alias("shapley"),
    )


def _bits(one: int):
    """Bits of the filters before step k of the order o, or of its own filter."""
    at = lambda i: F.element_at(F.create_map(*[F.lit(x) for f, b in BIT.items() for x in (f, b)]), i)
    if one:
        return at(F.substring(F.col("o"), F.col("k") + 1, F.lit(1)))
    return F.aggregate(F.slice(F.split("o", ""), F.lit(1), F.col("k")), F.lit(0), lambda acc, f: acc + at(f))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of ``docs`` by the column ``part``."""
    shared = Shared(docs.sparkSession, "audit")
    rows = docs.select("doc_id", "text", F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"))
    return audit(labelled(shared.save(with_duplicates(rows, ("part",), shared), "bits"), labels.select("doc_id", "quality", "toxic")))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS first FROM t
), b AS (
  SELECT doc_id, part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN first < doc_id THEN 16 ELSE 0 END) AS bits
  FROM w
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), c AS (
  SELECT part, bits, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n FROM b LEFT JOIN l USING (doc_id) GROUP BY ALL
), f(f, bit) AS (
  VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bs
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, k AS step, bs[k] AS bit, coalesce(list_sum(bs[1:k - 1]), 0)::INTEGER AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN bits & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN bits & bit <> 0 AND bits & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN bits = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 AND good = 1 THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN bits & bit <> 0 AND bits & before = 0 AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
