"""Merkle manifest of a dataset: a tree for each group of rows, and one over the groups' roots.

Nodes are kept in an external store: Parquet with one partition for each level, and a node's place in its level as its coordinate.
Leaves are written as they are hashed, then range-sorted into runs and numbered: a run counts its own rows, and the counts of the runs
before it say where it begins. STRIDE levels at a time, a task reads the nodes of the level below in order and writes the levels above them, so the
store is built by about log(rows) / (STRIDE * log 2) passes, and no task holds more than 2 ** STRIDE leaves of a tree. Proofs come from
the top down by merge-scans of the store: the nodes of a block and the proof of the block's own root, joined by coordinate.

A node is the hash of its one or two children's hashes as text; a tree of one leaf is that leaf. Leaves are in the order of
doc_id, null first, and those of one doc_id in the order of their hashes; a null group comes before all others. Repeated rows are leaves of their
own, with the same hash. An empty table has no rows. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Shared, ship, units

STRIDE = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a step of a proof says of the sibling: it stands left, right, or there is none.
LEFT, RIGHT, NONE = "<", ">", ""
_NODE = "tree long, pos long, size long, node string"


def framed(value: Column) -> Column:
    """``-`` of a null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def group_key(group: Column) -> Column:
    """A key that sorts as the groups do, a null one before all others."""
    return F.when(group.isNull(), "-").otherwise(F.concat(F.lit("="), group))


def _runs(rows: DataFrame, group: str, order: tuple[str, ...], shared: Shared) -> tuple[DataFrame, DataFrame]:
    """``rows`` as sorted runs, with their run and their place in it; and for each run of a group what to add to a place to get that in
    the group, and the size of the group."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")
    runs = shared.save(dealt.select("*", F.spark_partition_id().alias("_run"), at), "runs")
    counts = runs.groupBy(group, "_run").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    of = Window.partitionBy(group)  # a row for each run of a group
    before = F.sum("_rows").over(of.orderBy("_run")) - F.col("_rows")
    starts = counts.select(group, "_run", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(of).alias("size"))
    return runs, shared.save(starts, "starts")


def _placed(runs: DataFrame, starts: DataFrame, group: str) -> DataFrame:
    return runs.join(starts, [group, "_run"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_run", "_at", "_shift")


def numbered(rows: DataFrame, group: str, order: tuple[str, ...], shared: Shared) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``tree``, the rank of their group, ``pos``, their place in it, both from 0, and ``size``, its number of rows; and the
    groups with ``tree``."""
    runs, starts = _runs(rows, group, order, shared)
    groups = starts.select(group).distinct().withColumn("_one", F.lit(0))
    ranked = _placed(*_runs(groups, "_one", (group,), shared), "_one").select(group, F.col("pos").alias("tree"))
    ranked = shared.save(ranked, "groups")
    starts = shared.save(starts.join(ranked, group), "starts")
    return _placed(runs, starts, group), ranked


def height(size: Column) -> Column:
    """The level of the root of a tree with so many leaves."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _block(base: int) -> list[Column]:
    """The node STRIDE levels above that a node of level ``base`` or more belongs to."""
    level = F.col("level").cast("int")
    return [F.col("tree"), F.call_function("shiftright", F.col("pos"), F.lit(STRIDE + base) - level).alias("block")]


def _raised(level: int):
    """Nodes above those of a block, up to its root or the root of the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in units(batches, ("tree", "block")):
            tree, size = rows.column("tree")[0].as_py(), rows.column("size")[0].as_py()
            nodes, first, out = rows.column("node").to_pylist(), rows.column("pos")[0].as_py(), []
            for up in range(level + 1, level + STRIDE + 1):
                if (size + (1 << up - 1) - 1) >> up - 1 == 1:
                    break
                nodes, first = [_h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], first >> 1
                out += [(up, tree, first + i, size, node) for i, node in enumerate(nodes)]
            yield pa.RecordBatch.from_pylist([dict(zip(("level", "tree", "pos", "size", "node"), x, strict=True)) for x in out], _STORED)

    return run


_STORED = pa.schema([("level", pa.int32()), ("tree", pa.int64()), ("pos", pa.int64()), ("size", pa.int64()), ("node", pa.string())])


def build(leaves: DataFrame, shared: Shared) -> DataFrame:
    """The store of all nodes of the trees: (level, tree, pos, size, node), a partition for each level."""
    spark, path = leaves.sparkSession, shared.path("nodes")
    top = leaves.agg(F.max("size")).first()[0] or 0
    leaves.select(F.lit(0).alias("level"), "tree", "pos", "size", "node").write.option("compression", "zstd").partitionBy("level").parquet(path)
    store = lambda: spark.read.schema(f"{_NODE}, level int").parquet(path)
    level = 0
    while top > 1 << level:
        below = store().filter((F.col("level") == level) & (height(F.col("size")) > level))
        below = below.select("pos", "size", "node", *_block(level)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        above = below.mapInArrow(_raised(level), f"level int, {_NODE}")
        above.write.mode("append").option("compression", "zstd").partitionBy("level").parquet(path)
        level += STRIDE
    return store()


def _lowered(level: int, kinds: pa.Schema):
    """Of the nodes of level ``level`` in a block the proof: their siblings in the block, then the proof of the block's root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in units(batches, ("tree", "block")):
            up = rows.slice(0, 1)
            rest, subroot, root = (up.column(c)[0].as_py() for c in ("proof", "subroot", "root"))
            rows = rows.slice(1)
            levels, of = rows.column("level").to_numpy(), rows.column("node").to_pylist()
            cuts = [0, *np.flatnonzero(levels[1:] != levels[:-1]) + 1, len(of)]
            nodes = [of[a:b] for a, b in pairwise(cuts)]
            size = rows.column("size")[0].as_py()
            steps = min(STRIDE, (size - 1).bit_length() - level)
            mine = rows.slice(0, len(nodes[0]))
            proofs = []
            for at in range(len(nodes[0])):
                proof = []
                for k in range(steps):
                    beside = at ^ 1
                    proof.append((LEFT if at & 1 else RIGHT) + nodes[k][beside] if beside < len(nodes[k]) else NONE)
                    at >>= 1
                proofs.append(proof + rest)
            n = len(proofs)
            made = {"proof": proofs, "subroot": [subroot] * n, "root": [root] * n}
            columns = [pa.array(made[f.name], f.type) if f.name in made else mine.column(f.name).combine_chunks().cast(f.type) for f in kinds]
            yield from pa.Table.from_arrays(columns, schema=kinds).to_batches()

    return run


def proofs(leaves: DataFrame, store: DataFrame, tops: DataFrame, shared: Shared) -> DataFrame:
    """``leaves`` with ``proof``, the siblings on the way to the last root, and ``subroot`` and ``root`` of ``tops``.

    ``tops`` has for each tree the proof of its root. From the highest levels down, the nodes of a block and the proof of its root are met
    in one sort by coordinate; so are at last the leaves and the lowest nodes.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    top = leaves.agg(F.max("size")).first()[0] or 0
    level = max(0, ((top - 1).bit_length() - 1) // STRIDE * STRIDE) if top else 0
    made = "proof array<string>, subroot string, root string"
    above = None
    while level >= 0:
        here = height(F.col("size"))
        enter = (here > level) & (here <= level + STRIDE) if level else here <= STRIDE
        up = tops.filter(enter).select("tree", F.lit(0).cast("long").alias("block"), "proof", "subroot", "root")
        if above is not None:
            up = up.unionByName(above.select("tree", F.col("pos").alias("block"), "proof", "subroot", "root"))
        inner = store.filter((F.col("level") >= max(level, 1)) & (F.col("level") < level + STRIDE) & (F.col("level") < here))
        rows = inner.unionByName(leaves.withColumn("level", F.lit(0)), allowMissingColumns=True) if level == 0 else inner
        rows = rows.select("*", _block(level)[1]).unionByName(up.withColumn("level", F.lit(-1)), allowMissingColumns=True)
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "level", "pos")
        schema = ", ".join(f"`{c}` {t}" for c, t in (leaves if level == 0 else store).dtypes) + f", {made}"
        kinds = to_arrow_schema(leaves.sparkSession.createDataFrame([], schema).schema)
        above = rows.mapInArrow(_lowered(level, kinds), schema)
        if level:
            above = shared.save(above, "proofs")
        level -= STRIDE
    return above


def steps(proof: Column) -> Column:
    """The hashes of a proof, one after the other."""
    return F.array_join(F.transform(proof, lambda x: F.substring(x, 2, 64)), "")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def step(node: Column, x: Column) -> Column:
        beside = F.substring(x, 2, 64)
        return F.sha2(F.when(x == NONE, node).when(F.startswith(x, F.lit(LEFT)), F.concat(beside, node)).otherwise(F.concat(node, beside)), 256)

    return F.aggregate(proof, leaf, step)


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """``order``, ``leaf``, ``subroot``, ``root`` and ``proof`` of every row; with ``tampered``, other values of some fields, also
    ``changed``, the leaf that those would give."""
    ship(docs.sparkSession)
    shared = Shared(docs.sparkSession, "merkle")
    values = {c: F.col(f"`{c}`") for c in fields}
    made = [leaf_hash(*values.values()).alias("node")]
    if tampered:
        made.append(leaf_hash(*(values | tampered).values()).alias("changed"))
    hashed = shared.save(docs.select(F.col(f"`{order}`").alias("_order"), group_key(F.col(f"`{group}`")).alias("_group"), *made), "hashed")
    leaves, groups = numbered(hashed, "_group", ("_order", "node"), shared)
    leaves = shared.save(leaves.drop("_group"), "leaves")
    store = build(leaves, shared)
    # the groups' roots are the leaves of one tree more
    roots = store.filter(F.col("level") == height(F.col("size"))).select("tree", "size", F.col("node").alias("subroot"))
    n = groups.count()
    upper = shared.save(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n).cast("long").alias("size"), F.col("subroot").alias("node"), F.col("size").alias("leaves")), "roots")
    over = build(upper, shared)
    root = over.filter(F.col("level") == height(F.col("size"))).select("tree", "size", F.array().cast("array<string>").alias("proof"), F.col("node").alias("subroot"), F.col("node").alias("root"))
    tops = shared.save(proofs(upper, over, root, shared).select(F.col("pos").alias("tree"), F.col("leaves").alias("size"), "proof", F.col("node").alias("subroot"), "root"), "tops")
    out = proofs(leaves, store, tops, shared)
    return out.select(F.col("_order").alias(order), F.col("node").alias("leaf"), *(["changed"] if tampered else []), "subroot", "root", "proof")


def verify(rows: DataFrame) -> DataFrame:
    """``rows`` of ``manifest`` with ``folded_root``, from ``changed`` where there is one, and ``verified``."""
    leaf = "changed" if "changed" in rows.columns else "leaf"
    return rows.withColumn("folded_root", fold(F.col(leaf), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, sha256(concat(a, n, z)) AS leaf, CASE WHEN crc THEN sha256(concat(a, m, z)) ELSE sha256(concat(a, n, z)) END AS changed
  FROM (
    SELECT doc_id, lang, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 7 = 0, FALSE) AS crc,
      concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(CAST(source AS VARCHAR)), ':', source) END, CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(CAST(lang AS VARCHAR)), ':', lang) END) AS a, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END AS n, CASE WHEN n_chars + 1 IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars + 1 AS VARCHAR)), ':', n_chars + 1) END AS m, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(CAST(text AS VARCHAR)), ':', text) END AS z
    FROM documents
  )
), l AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY lang) AS size,
    CAST(dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS BIGINT) AS tree
  FROM d
), t(tree, level, pos, size, node) AS (
  SELECT tree, 0, pos, size, leaf FROM l
  UNION ALL
  SELECT tree, level + 1, pos // 2, size, sha256(string_agg(node, '' ORDER BY pos)) FROM t
  WHERE (size + (1 << level) - 1) >> level > 1 GROUP BY tree, level, pos // 2, size
), r AS (
  SELECT tree, node AS subroot, count(*) OVER () AS size FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY level DESC) AS k FROM t) WHERE k = 1
), u(level, pos, size, node) AS (
  SELECT 0, tree, size, subroot FROM r
  UNION ALL
  SELECT level + 1, pos // 2, size, sha256(string_agg(node, '' ORDER BY pos)) FROM u
  WHERE (size + (1 << level) - 1) >> level > 1 GROUP BY level, pos // 2, size
), w AS (
  SELECT l.tree, l.pos, k AS step, CASE WHEN t.node IS NULL THEN '' WHEN (l.pos >> k) % 2 = 1 THEN '<' || t.node ELSE '>' || t.node END AS beside
  FROM (SELECT tree, pos, size, unnest(range(0, CAST(ceil(log2(size) - 1e-12) AS BIGINT))) AS k FROM l) l
  LEFT JOIN t ON t.tree = l.tree AND t.level = k AND t.pos = xor(l.pos >> k, 1)
), v AS (
  SELECT r.tree, k AS step, CASE WHEN u.node IS NULL THEN '' WHEN (r.tree >> k) % 2 = 1 THEN '<' || u.node ELSE '>' || u.node END AS beside
  FROM (SELECT tree, unnest(range(0, CAST(ceil(log2(size) - 1e-12) AS BIGINT))) AS k FROM r) r
  LEFT JOIN u ON u.level = k AND u.pos = xor(r.tree >> k, 1)
), p AS (
  SELECT l.doc_id, leaf, changed, subroot, (SELECT arg_max(node, level) FROM u) AS root, coalesce(a.path, []) || coalesce(b.path, []) AS path
  FROM l JOIN r USING (tree)
  LEFT JOIN (SELECT tree, pos, list(beside ORDER BY step) AS path FROM w GROUP BY ALL) a ON a.tree = l.tree AND a.pos = l.pos
  LEFT JOIN (SELECT tree, list(beside ORDER BY step) AS path FROM v GROUP BY ALL) b ON b.tree = l.tree
), f AS (
  SELECT *, list_reduce(list_prepend(changed, path), lambda x, y: sha256(CASE WHEN y = '' THEN x WHEN y[1] = '<' THEN y[2:] || x ELSE x || y[2:] END)) AS folded_root FROM p
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM f
"""
