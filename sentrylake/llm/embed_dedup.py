"""Near duplicates among embeddings by an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a grid of cells, and every vector is filed in the cell of its
nearest codewords. A query visits cells in the order of their distance bound (multi-sequence traversal over the two halves'
sorted bounds) until the bound passes the radius that the cosine allows. A vector filed under a codeword lies behind all planes that
separate it from the others, so the bound is a true one and nothing within the radius is missed: the target recall is 1. What is
found is verified by the cosine in double precision.

Only vectors with the same label are compared. The codebooks are fitted on the SAMPLE vectors of smallest hash; every vector
is filed and every vector is a query. Equal vectors are one class with a count. A cell's vectors and its queries are cut into
chunks, and each pair of chunks is a matrix product in one task, whose pairs are counted there and never become rows.

Only vectors of one length are compared. The grid has the commonest length of the sample; others are filed by their first so many
components, or by sums of neighbouring ones scaled so that no distance grows, which keeps the bound true.

Vectors that are null, zero, or hold a null or non-finite component link with nothing, as do those without a label or vec_id; others link whatever their norms, however huge or tiny.
Rows that repeat a vec_id count as vectors of their own. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import roots
from .shared import Shared, ship, units

COSINE = 0.98
#: A grid has up to CODEWORDS ** 2 cells, for a label of a thousand million vectors.
SAMPLE, STEPS, CELL_VECTORS, CODEWORDS = 4096, 12, 1024, 1024
CHUNK = 1024


def kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 6) -> np.ndarray:
    """Codewords of the rows of x; at most as many as there are different rows."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(steps):
        near = squared(x, centres).argmin(1)
        used = np.unique(near)
        centres = np.stack([x[near == c].mean(0) for c in used])
    return np.unique(centres, axis=0)


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


class MultiIndex:
    def __init__(self, unit_vectors: np.ndarray, k: int):
        self.length = unit_vectors.shape[1]
        self.cut = self.length // 2
        self.books = [kmeans(h, k) for h in self.halves(unit_vectors)]
        self.apart = [np.sqrt(squared(b, b)) for b in self.books]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.cut], x[:, self.cut :]

    @property
    def cells(self) -> int:
        return len(self.books[0]) * len(self.books[1])

    def look(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The cell of each row, and for each half the squared bounds on its distance to what is filed under each codeword."""
        near, bounds = [], []
        for h, book, apart in zip(self.halves(x), self.books, self.apart, strict=True):
            d = squared(h, book)
            near.append(d.argmin(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                planes = (d[:, :, None] - d[:, None, :]) / (2 * apart[None])
            planes[:, range(len(book)), range(len(book))] = 0
            bounds.append(np.maximum(planes.max(2), 0) ** 2)
        return near[0] * len(self.books[1]) + near[1], bounds

    def visits(self, bounds: list[np.ndarray], radius2: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells within the radius. With both halves sorted, the cells that ``traverse`` would take
        before it stops are a staircase: for each codeword of the first half a run of the second half's."""
        first, second = bounds
        order = second.argsort(1)
        run = np.take_along_axis(second, order, 1)
        rest = radius2 - first
        fits = (run[:, None, :] <= rest[:, :, None]).sum(2)
        row, a = np.nonzero(fits)
        n = fits[row, a]
        row, a = np.repeat(row, n), np.repeat(a, n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        return row, a * second.shape[1] + order[row, step]


def traverse(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Multi-sequence traversal for one query: (bound, codeword, codeword) of all cells in ascending order of the bound."""
    a, b = first.argsort(kind="stable"), second.argsort(kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield bound, int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors. Each is first scaled by a power of two, which rounds nothing, so that no norm overflows or vanishes."""
    flat = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    flat = np.ldexp(flat, -np.frexp(np.abs(flat).max(1, initial=0))[1][:, None])
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def classes_of(vectors: DataFrame, shared: Shared) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows with their class key, and one row per class of equal vectors with one label."""
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select("vec_id", "label", "embedding", F.coalesce(sound, F.lit(False)).alias("ok"), F.size("embedding").alias("d"))
    rows = rows.withColumn("k1", F.xxhash64("embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding"))
    classes = rows.filter("ok").groupBy("label", "d", "k1", "k2").agg(
        F.min("vec_id").alias("cid"), F.count("*").alias("copies"), F.min(F.struct("vec_id", "embedding"))["embedding"].alias("embedding")
    )
    return rows.drop("embedding"), shared.save(classes, "classes")


def projected(x: np.ndarray, d: int) -> np.ndarray:
    """The rows with d components, none of them further apart than before."""
    have = x.shape[1]
    if have <= d:
        return np.pad(x, ((0, 0), (0, d - have)))
    begin = np.unique(np.arange(d) * have // d)
    return np.add.reduceat(x, begin, axis=1) / np.sqrt(np.diff(np.r_[begin, have]))


def fit(classes: DataFrame) -> MultiIndex:
    """The grid has so many cells that one holds about CELL_VECTORS vectors of the largest label: a row sent to one more cell costs
    as much as hundreds of comparisons within it."""
    n = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    k = int(np.clip(round((n / CELL_VECTORS) ** 0.5), 1, CODEWORDS))
    few = classes.orderBy(F.xxhash64("cid"), "cid").limit(max(SAMPLE, 16 * k)).select("d", "embedding").toArrow()
    d = np.bincount(few.column("d").to_numpy()).argmax()
    return MultiIndex(_matrix(few.filter(pa.array(few.column("d").to_numpy() == d)).column("embedding").combine_chunks()), k)


def filed(classes: DataFrame, index: MultiIndex, cosine: float) -> DataFrame:
    """(label, d, cell, query, cid, copies, embedding): each class where it is filed, and as a query in each cell it visits."""
    sent = classes.sparkSession.sparkContext.broadcast(index)
    radius2 = 2 - 2 * cosine + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        step = max(16, (1 << 23) // max(len(b) for b in m.books) ** 2)
        for batch in batches:
            length = batch.column("d").to_numpy()
            for d in np.unique(length).tolist():
                same = batch.filter(pa.array(length == d))
                for at in range(0, same.num_rows, min(step, 2048)):
                    part = same.slice(at, min(step, 2048))
                    cell, bounds = m.look(projected(_matrix(part.column("embedding")), m.length))
                    row, visited = m.visits(bounds, radius2)
                    rows = pa.array(np.r_[np.arange(part.num_rows), row])
                    query = np.r_[np.zeros(part.num_rows, bool), np.ones(len(row), bool)]
                    yield pa.RecordBatch.from_arrays(
                        [*[part.column(c).take(rows) for c in ("label", "d")], pa.array(np.r_[cell, visited]), pa.array(query), *[part.column(c).take(rows) for c in ("cid", "copies", "embedding")]],
                        names=["label", "d", "cell", "query", "cid", "copies", "embedding"],
                    )

    kinds = dict(classes.dtypes)
    return classes.select("label", "d", "cid", "copies", "embedding").mapInArrow(
        run, f"label {kinds['label']}, d int, cell long, query boolean, cid {kinds['cid']}, copies long, embedding {kinds['embedding']}"
    )


def compare(rows: DataFrame, cosine: float) -> DataFrame:
    """(cid, low, links) from every pair of a chunk of filed vectors and a chunk of queries."""

    def unit(t: pa.Table) -> pa.RecordBatch:
        query = np.asarray(t.column("query").combine_chunks())
        cid, copies = np.asarray(t.column("cid")), np.asarray(t.column("copies"))
        x = _matrix(t.column("embedding").combine_chunks())
        nodes, place = np.unique(cid, return_inverse=True)
        q, b = np.flatnonzero(query), np.flatnonzero(~query)
        close = (x[q] @ x[b].T >= cosine) & (cid[q][:, None] != cid[b][None])
        links = np.zeros(len(nodes), np.int64)
        links[place[q]] = close @ copies[b]
        i, j = np.nonzero(close)
        label = roots(len(nodes), place[q][i], place[b][j])
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label]), pa.array(links)], names=["cid", "low", "links"])

    keys = ("label", "d", "cell", "bi", "qi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(unit, units(batches, keys))

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(rows.dtypes)["cid"]
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, f"cid {kind}, low {kind}, links long")


def dedup(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each of ``vectors``."""
    spark = vectors.sparkSession
    ship(spark)
    shared = Shared(spark, "embeddings")
    rows, classes = classes_of(vectors, shared)
    if classes.isEmpty():
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    placed = shared.save(filed(classes, fit(classes), cosine), "placed")
    sizes = placed.groupBy("label", "d", "cell").agg(F.count_if(~F.col("query")).alias("b"), F.count_if("query").alias("q")).filter("b > 0 AND b + q > 2")
    sizes = shared.save(sizes.select("label", "d", "cell", F.ceil(F.col("b") / CHUNK).cast("int").alias("nb"), F.ceil(F.col("q") / CHUNK).cast("int").alias("nq")), "sizes")
    h = F.xxhash64("cid")
    chunked = placed.join(sizes, ["label", "d", "cell"])
    mine = F.when(F.col("query"), F.pmod(h, F.col("nq"))).otherwise(F.pmod(h, F.col("nb"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("nb")).otherwise(F.col("nq")) - 1)).alias("other")
    chunked = chunked.select("label", "d", "cell", "query", "cid", "copies", "embedding", mine.alias("mine"), other)
    chunked = chunked.select(
        "label", "d", "cell", "query", "cid", "copies", "embedding",
        F.when(F.col("query"), F.col("other")).otherwise(F.col("mine")).alias("bi"), F.when(F.col("query"), F.col("mine")).otherwise(F.col("other")).alias("qi"),
    )
    found = shared.save(compare(chunked, cosine), "found")
    linked = found.filter("cid <> low").select(F.col("cid").alias("a"), F.col("low").alias("b"))
    root = components(linked, shared).withColumnRenamed("node", "cid")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("label", "d", "k1", "k2", "cid", "copies").join(links, "cid", "left").join(root, "cid", "left")
    known = known.select("label", "d", "k1", "k2", F.coalesce("root", "cid").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.lit(True).alias("ok"))
    known = shared.save(known, "known")
    out = rows.join(known, ["label", "d", "k1", "k2", "ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
