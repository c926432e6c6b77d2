"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once; its failure is a bit of ``fail_bits`` and what it measured is a column. A policy is a
versioned mask over those bits: applying one, or asking what one rule alone removes, reads the ledger and never a text.

A null text has no words and fails ``few_words``; so does an empty one. Rows are judged one by one, so repeated rows get
the same verdict each time, an empty table gives an empty ledger, and further columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: bit of each rule
RULES = {"few_words": 0, "repeats": 1, "symbols": 2, "word_length": 3, "dup_lines": 4, "upper_case": 5}
#: versioned policies: the rules whose failure rejects a document
POLICIES = {
    "base": ("few_words", "repeats"),
    "v1": ("few_words", "repeats", "symbols", "word_length", "dup_lines", "upper_case"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def mask(policy: str) -> int:
    return sum(1 << RULES[r] for r in POLICIES[policy])


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)), " "), lambda w: w != "")


def _lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(SPACE))) > 0)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f over a value that is computed once, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more. Windows are compared by 64-bit hashes.

    Sorting (hash, start) puts equal windows side by side; the starts of those, sorted, cover min(WINDOW, step) words each.
    """
    none = F.lit(0).cast("long")

    def repeated(x: Column, i: Column, a: Column) -> Column:
        beside = lambda j: F.coalesce(F.get(a, j)["h"] == x["h"], F.lit(False))
        return beside(i - 1) | beside(i + 1)

    def starts(windows: Column) -> Column:
        by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(by_hash, lambda a: F.array_sort(F.transform(F.filter(a, lambda x, i: repeated(x, i, a)), lambda x: x["i"])))

    def covered(s: Column) -> Column:
        steps = F.transform(s, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, none, lambda acc, x: acc + x)

    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    count = _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), none).otherwise(_let(starts(w), covered)))
    return F.when(F.size(hashes) <= WINDOW, none).otherwise(count)


def _fails(m: Column) -> dict[str, Column]:
    return {
        "few_words": m["n_words"] < 20,
        "repeats": 100 * m["n_repeat_words"] > 30 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
        "dup_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "upper_case": 2 * m["n_upper"] > m["word_chars"],
    }


def judged(text: Column) -> Column:
    """A struct of the measurements and ``fail_bits`` of a text; every rule is evaluated once."""
    long = lambda c, name: c.cast("long").alias(name)

    def measured(t: Column) -> Column:
        rest = (
            long(F.length(F.translate(t, SPACE, "")), "word_chars"),
            long(F.length(t) - F.length(F.translate(t, SYMBOLS, "")), "n_symbols"),
            long(F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")), "n_upper"),
        )

        def of_lines(x: Column) -> Column:
            return F.struct(long(F.size(x), "n_lines"), long(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines"))

        def of_words(h: Column) -> Column:
            return F.struct(long(F.size(h), "n_words"), long(_repeat_words(h), "n_repeat_words"))

        words = _let(F.transform(_words(t), lambda w: F.xxhash64(w)), of_words)
        parts = F.struct(words.alias("w"), _let(_lines(t), of_lines).alias("l"), F.struct(*rest).alias("r"))
        place = {"n_words": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
        return _let(parts, lambda p: F.struct(*[p[place.get(m, "r")][m].alias(m) for m in MEASURES]))

    def with_bits(m: Column) -> Column:
        bits = [F.when(c, F.lit(1 << RULES[r])).otherwise(F.lit(0)) for r, c in _fails(m).items()]
        return F.struct(*[m[x].alias(x) for x in MEASURES], sum(bits[1:], bits[0]).cast("long").alias("fail_bits"))

    return _let(_let(F.coalesce(text, F.lit("")), measured), with_bits)


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the measurements, ``fail_bits`` and ``base_failed`` of every row."""
    rows = docs.select(*keep, F.inline(F.array(judged(F.col(text)))))
    return rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(mask("base")) != 0)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """``kept``: no failed rule of the policy."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(mask(policy)) == 0)


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """One row per rule of a policy: documents that fail it, and those that only it rejects. One pass over the bits."""
    m, names = mask(policy), POLICIES[policy]
    bits = F.col("fail_bits").bitwiseAND(m)
    both = [
        x
        for r in names
        for x in (
            F.count_if(bits.bitwiseAND(1 << RULES[r]) != 0).alias(f"{r}_failed"),
            F.count_if(bits == (1 << RULES[r])).alias(f"{r}_only"),
        )
    ]
    rows_of = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("failed"), F.col(f"{r}_only").alias("only")) for r in names])
    return rows.agg(*both).select(F.inline(rows_of))


def filter_quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns."""
    return docs.filter(judged(F.col("text"))["fail_bits"].bitwiseAND(mask(policy)) == 0)


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), g AS (
  SELECT doc_id, i, list_slice(ws, i, i + 7) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(length(x) - length(regexp_replace(x, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper
  FROM w LEFT JOIN n USING (doc_id)
), b AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m
)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""
