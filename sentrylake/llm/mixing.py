"""Mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents are summed to cells of source x language x topic. Raking scales the cells in turn until the token shares of the
three marginals are the targets. A document is due ``expected`` times, as its cell's weight says: as often as the whole part
says, and once more where a fixed hash of its id is under the fraction. So the sample's tokens follow the targets, rare cells
being repeated instead of the frequent ones being thrown away down to them. The cells are as many as the named categories allow, whatever the corpus: a value without a target of its own
falls in the category ``other``, so the table of cells that the raking loop holds has a size bound given by ``targets``.

Null source, language or text count as ``other``, ``other`` and 0 words. A document without words is kept (it weighs
nothing). Equal rows with equal ids are kept or dropped together. Further columns pass through ``sample`` untouched.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("source", "lang", "topic")
OTHER = "other"
#: Topics are told apart by layout, which every language shares.
TOPICS = ("list", "prose", "short")
#: Production targets: flattened sources, more weight for the smaller languages, mostly prose.
TARGETS: dict[str, dict[str, float]] = {
    "source": {**{f"src{i}": 0.047 for i in range(20)}, OTHER: 0.06},
    "lang": {"en": 0.58, "fr": 0.15, "de": 0.15, "es": 0.11, OTHER: 0.01},
    "topic": {"list": 0.30, "prose": 0.65, "short": 0.05},
}
ROUNDS = 25
#: Tokens of the sample, repeats counted, as a share of the tokens.
BUDGET = 0.9


def topic_of(text: Column) -> Column:
    """``short`` under 400 characters, ``list`` with a line break at least every 400 characters, else ``prose``."""
    n = F.length(text)
    breaks = n - F.length(F.translate(text, "\n", ""))
    return F.when(F.coalesce(n, F.lit(0)) < 400, "short").when(breaks * 400 >= n, "list").otherwise("prose")


def token_count(text: Column) -> Column:
    """Words, counted without making them: places where a word starts."""
    t = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(t, " "), lambda w: w != "")).cast("long")


def categorise(docs: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> dict[str, Column]:
    def of(value: Column, axis: str) -> Column:
        return F.when(value.isin(*[k for k in targets[axis] if k != OTHER]), value).otherwise(F.lit(OTHER))

    return {"source": of(F.col("source"), "source"), "lang": of(F.col("lang"), "lang"), "topic": of(topic_of(F.col("text")), "topic")}


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``weight``: the factor on tokens that meets the marginals.

    All cells go into one row; each round scales by the target share over the present share of each axis in turn. A target
    on a category without tokens is shared out among the others of its axis.
    """
    fields = F.struct(*AXES, "tokens", F.col("tokens").cast("double").alias("w"))
    one = cells.filter("tokens > 0").agg(F.array_sort(F.collect_list(fields)).alias("cells"))

    def let(value: Column, f) -> Column:
        """f over a value that is computed once."""
        return F.element_at(F.transform(F.array(value), f), 1)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    def scale(axis: str):
        names = [F.lit(k) for k in targets[axis]]
        shares = [F.lit(float(v)) for v in targets[axis].values()]

        def of(state: Column) -> Column:
            have = F.transform(
                F.array(*names),
                lambda k: total(F.transform(state, lambda c: F.when(c[axis] == k, c["w"]).otherwise(F.lit(0.0)))),
            )
            return let(have, lambda sums: let(factors(sums), lambda f: F.transform(state, lambda c: put(c, f))))

        def factors(sums: Column) -> Column:
            reach = total(F.zip_with(sums, F.array(*shares), lambda x, y: F.when(x > 0, y).otherwise(F.lit(0.0))))
            every = total(sums)
            by_name = F.zip_with(sums, F.array(*shares), lambda x, y: F.when(x > 0, y / reach * every / x).otherwise(F.lit(1.0)))
            return F.map_from_arrays(F.array(*names), by_name)

        def put(c: Column, f: Column) -> Column:
            kept = [c[x].alias(x) for x in (*AXES, "tokens")]
            return F.struct(*kept, (c["w"] * F.element_at(f, c[axis])).alias("w"))

        return of

    def step(state: Column, _: Column) -> Column:
        for axis in AXES:
            state = let(state, scale(axis))
        return state

    done = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("cells"), step).alias("cells"))
    out = done.select(F.inline("cells"))
    return out.select(*AXES, "tokens", (F.col("w") / F.col("tokens")).alias("weight"))


def repeats(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``expected``: how often a document of the cell is due, weight times the one scale that spends the budget.

    ``p`` is the probability that it is in the sample at all.
    """
    one = raked.agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("weight")).alias("w"), F.collect_list(F.struct(*AXES, "tokens", "weight")).alias("c"))
    cells = one.select((F.lit(budget) * F.col("t") / F.col("w")).alias("scale"), F.inline("c"))
    expected = F.col("weight") * F.col("scale")
    return cells.select(*AXES, "tokens", "weight", expected.alias("expected"), F.least(F.lit(1.0), expected).alias("p"))


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key alone, and that SQL engines agree on."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS, budget: float = BUDGET, seed: int = 5, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with its cell, ``n_tokens``, ``weight``, ``p``, ``expected``, ``copies`` and ``sampled`` (any copies).

    The raked table has at most one row per combination of the targets' categories, so it is broadcast.
    """
    cats = categorise(docs, targets)
    base = docs.select(*carry, *[c.alias(f"_{a}") for a, c in cats.items()], token_count(F.col("text")).alias("n_tokens"))
    cells = base.groupBy(*[F.col(f"_{a}").alias(a) for a in AXES]).agg(F.sum("n_tokens").alias("tokens"))
    probs = repeats(rake(cells, targets), budget).drop("tokens")
    probs = probs.select(*[F.col(a).alias(f"_{a}") for a in AXES], "weight", "p", "expected")
    joined = base.join(F.broadcast(probs), [f"_{a}" for a in AXES], "left")
    joined = joined.withColumn("p", F.coalesce("p", F.lit(1.0))).withColumn("expected", F.coalesce("expected", F.lit(1.0)))
    whole = F.floor("expected")
    once_more = uniform(F.col(carry[0]) if carry[0] != "_row" else F.col("_row.doc_id"), seed) < F.col("expected") - whole
    return joined.withColumn("copies", whole + once_more.cast("long")).withColumn("sampled", F.col("copies") > 0)


def sample(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, each as often as its copies say, with their columns."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "source", "lang", "text")
    kept = mix(packed, carry=("_row",), **how).filter("sampled")
    kept = kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return kept.select(*[F.col("_row").getField(c).alias(c) for c in names])


def _sql(targets: Mapping[str, Mapping[str, float]], budget: float, seed: int) -> str:
    """The mix in SQL: a step of the recursion rakes one axis. Shares are exact in nine digits, as sums differ in the last ones."""
    def category(axis: str) -> str:
        names = ", ".join(f"'{k}'" for k in targets[axis] if k != OTHER)
        return f"CASE WHEN {axis} IN ({names}) THEN {axis} ELSE '{OTHER}' END"

    shares = ", ".join(f"({i}, '{k}', CAST({v} AS DOUBLE))" for i, a in enumerate(AXES) for k, v in targets[a].items())
    on_axis = "CASE r.step % 3 WHEN 0 THEN r.source WHEN 1 THEN r.lang ELSE r.topic END"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
    CASE WHEN coalesce(length(text), 0) < 400 THEN 'short'
      WHEN (length(text) - length(replace(text, chr(10), ''))) * 400 >= length(text) THEN 'list' ELSE 'prose' END AS topic
  FROM documents
), b AS (
  SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, {category("source")} AS source, {category("lang")} AS lang, topic FROM d
), cells AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM b GROUP BY ALL HAVING sum(n_tokens) > 0
), named(axis, name, share) AS (VALUES {shares}), used AS (
  SELECT 0 AS axis, source AS name FROM cells UNION SELECT 1, lang FROM cells UNION SELECT 2, topic FROM cells
), target AS (
  SELECT axis, name, share / sum(share) OVER (PARTITION BY axis) AS share FROM named JOIN used USING (axis, name)
), r AS (
  SELECT 0 AS step, source, lang, topic, tokens, CAST(tokens AS DOUBLE) AS w FROM cells
  UNION ALL
  SELECT r.step + 1, r.source, r.lang, r.topic, r.tokens,
    r.w * t.share * sum(r.w) OVER () / sum(r.w) OVER (PARTITION BY t.name)
  FROM r JOIN target t ON t.axis = r.step % 3 AND t.name = {on_axis} WHERE r.step < {3 * ROUNDS}
), raked AS (
  SELECT source, lang, topic, w / tokens AS weight, w / tokens * {budget} * sum(tokens) OVER () / sum(w) OVER () AS expected
  FROM r WHERE step = {3 * ROUNDS}
), e AS (
  SELECT b.*, weight, coalesce(expected, 1.0) AS expected,
    CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(1 << 52)} AS u
  FROM b LEFT JOIN raked USING (source, lang, topic)
), c AS (
  SELECT *, CAST(floor(expected) AS BIGINT) + CASE WHEN u < expected - floor(expected) THEN 1 ELSE 0 END AS copies FROM e
)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(least(1.0, expected), 9) AS p,
  round(expected, 9) AS expected, CAST(copies AS BIGINT) AS copies, copies > 0 AS sampled
FROM c
"""


SQL = _sql(TARGETS, BUDGET, 5)
