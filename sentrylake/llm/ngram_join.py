"""Exact Jaccard self-join of word n-gram sets, size-aware: light sets enumerate subsets, heavy sets scan inverted lists.

Two sets of n and m shingles with similarity t or more share at least ceil(t * max(n, m)) of them, and one subset of
exactly ceil(t / (1 + t) * (n + m)). Light sets (n up to a boundary) enumerate those fixed-size subsets, so that linked
ones meet at a common subset. Heavy sets meet in inverted lists: of a set's shingles in one global order (those
found to be frequent last, the others by hash) the first n - ceil(t * n) + k are listed, and linked sets have at least
k(min(n, m)) of them in common; pairs with fewer are dropped before any set is moved. The boundary is the largest size up to which
enumerating costs less than scanning lists of the measured mean length.

Lists of frequent shingles are not expanded to pairs: the few sets that consist of such shingles (groups of near copies)
get one edge to each. Candidate pairs and those edges form candidate groups; a group is cut into chunks, and every pair of chunks is one
task that scans the chunks' inverted lists and counts all overlaps exactly. So no row per pair of a group is made, equal sets are
joined once as one class, and all links are found: ``n_links`` counts them.

A set is known by a hash of its sorted shingle hashes; sets are told apart by 128 bits of hash. Texts without words (null, empty, white space) have
n_shingles 0 and link with nothing. Rows with a null doc_id link with nothing and have a null component_id. Repeated rows
are copies. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Shared, ship, units
from .words import grams, hash_column, mix, signed, slices

#: A shingle with so many listings is frequent; at most HOT of them are broadcast (8 bytes each).
FREQUENT, HOT, ROUNDS = 64, 1 << 17, 2
#: A list that is longer than this after all is not expanded to pairs.
LONGEST_LIST = 512
#: Sets and shingles of a chunk, about.
CHUNK_SETS, CHUNK_SHINGLES = 256, 1 << 18
ENUMERATED = 4096
_NODE = np.uint64(0x5851F42D4C957F2D)


class Threshold:
    """Similarity of at least percent / 100, in whole numbers."""

    def __init__(self, percent: int):
        self.p = percent

    def least(self, n: int) -> int:
        """Shingles that a set of n shares at least with any set linked to it."""
        return -(-self.p * n // 100)

    def common(self, n: int, m: int) -> int:
        return -(-self.p * (n + m) // (100 + self.p))

    def extra(self, n: int) -> int:
        """k: listings in common that linked sets have at least, the smaller having n shingles."""
        return min(1 + n // 32, self.least(n))

    def listed(self, n: int) -> int:
        return n - self.least(n) + self.extra(n)

    def largest(self, n: int) -> int:
        return 100 * n // self.p

    def subset_sizes(self, n: int, boundary: int) -> list[int]:
        sizes = range(max(1, self.least(n)), min(self.largest(n), boundary) + 1)
        return sorted({self.common(n, m) for m in sizes if self.common(n, m) <= min(n, m)})

    def boundary(self, mean_list: float) -> int:
        b = 0
        while b < 64:
            n = b + 1
            cost = sum(comb(n, o) for o in self.subset_sizes(n, n + n // 2))
            if cost > ENUMERATED or cost > self.listed(n) * (1 + mean_list):
                break
            b = n
        return b


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than ``size`` words are one shingle."""
    h, counts = hash_column(texts, lower=True)
    g = grams(h, size)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(g[at : at + n - size + 1]))
        elif n:
            out.append(mix(np.array([xxhash.xxh64_intdigest(h[at : at + n].tobytes(), seed=n)], np.uint64)))
        else:
            out.append(h[:0])
        at += n
    return out


def _hash64(s: np.ndarray, seed: int) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed=seed)).view(np.int64))


class Ids:
    """The id of a set: a hash, and where different sets have the same one, another. ``clashes`` are those hashes."""

    def __init__(self, clashes: frozenset[int] = frozenset()):
        self.clashes = clashes

    def of(self, s: np.ndarray) -> int:
        first = _hash64(s, 0)
        return self.second(s) if first in self.clashes else first

    @staticmethod
    def second(s: np.ndarray) -> int:
        return _hash64(s, 1)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch):
            yield part, shingle_sets(part.column("text"), size)


def identify(docs: DataFrame, size: int, ids: Ids) -> DataFrame:
    """(doc_id, n, sid, second) of every row; sid is null without words, ``second`` tells sets with one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batches(batches, size):
            made = ([len(s) for s in sets], [ids.of(s) if len(s) else None for s in sets], [ids.second(s) if len(s) else None for s in sets])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(v, pa.int64()) for v in made]], names=["doc_id", "n", "sid", "second"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, sid long, second long")


def classes_of(docs: DataFrame, size: int, shared: Shared) -> tuple[DataFrame, DataFrame, Ids]:
    """(rows, sets, ids): each row with its set, and one row per different set. Ids that two sets share are given up, so that no
    sets are taken for one another below 128 bits; of n sets about n * n / 2 ** 65 share one, so these few are collected."""
    ids = Ids()
    while True:
        rows = shared.save(identify(docs, size, ids), "rows")
        named = rows.filter("doc_id IS NOT NULL AND sid IS NOT NULL").groupBy("sid")
        sets = shared.save(named.agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.count("*").alias("copies"), (F.min("second") != F.max("second")).alias("clash")), "sets")
        found = frozenset(r.sid for r in sets.filter("clash").select("sid").collect()) - ids.clashes
        if not found:
            return rows.drop("second"), sets.drop("clash"), ids
        shared.drop(rows, sets)
        ids = Ids(ids.clashes | found)


def _in_order(s: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, int]:
    """The set in the global order, and how many of it are not frequent. ``hot``: (hash, rank) columns sorted by hash."""
    if not len(hot):
        return s, len(s)
    at = np.minimum(np.searchsorted(hot["h"], s), len(hot) - 1)
    is_hot = hot["h"][at] == s
    if not is_hot.any():
        return s, len(s)
    late = s[is_hot][np.argsort(hot["rank"][at[is_hot]])]
    return np.concatenate([s[~is_hot], late]), len(s) - len(late)


_RANKED = np.dtype([("h", np.uint64), ("rank", np.int32)])


def frequent(docs: DataFrame, size: int, t: Threshold) -> tuple[np.ndarray, float]:
    """The frequent shingles with their rank by frequency, and the mean length of the other lists.

    Listings of all documents are counted; as the order changes with what is found, further rounds count anew. Which ones
    are found sets the order and so the cost, never the result.
    """
    spark = docs.sparkSession
    found: dict[int, int] = {}
    mean = 1.0
    for round_ in range(ROUNDS):
        hot = spark.sparkContext.broadcast(ranked(found))

        def run(batches: Iterator[pa.RecordBatch], hot=hot) -> Iterator[pa.RecordBatch]:
            for _, sets in _batches(batches, size):
                rows = []
                for s in sets:
                    if len(s):
                        o, cold = _in_order(s, hot.value)
                        rows.append(o[: min(cold, t.listed(len(s)))])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(rows)))], names=["k"])

        counts = docs.select("text").mapInArrow(run, "k long").groupBy("k").agg(F.count("*").alias("c"))
        usual = F.when(F.col("c") < FREQUENT, F.col("c"))
        kept = F.struct("c", "k")
        if round_ == 0:
            shared = Shared(spark, "listings")
            counts = shared.save(counts.filter("c > 1"), "counts")
            total = counts.agg(F.coalesce(F.sum(usual * usual), F.lit(0)), F.coalesce(F.sum(usual), F.lit(0))).first()
            mean = total[0] / max(total[1], 1)
        new = counts.filter(F.col("c") >= FREQUENT).orderBy(F.col("c").desc(), "k").limit(HOT).collect()
        if round_ == 0:
            shared.drop(counts)
        if not new:
            break
        found |= {r["k"]: r["c"] for r in new}
    return ranked(found), mean


def ranked(found: dict[int, int]) -> np.ndarray:
    top = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:HOT][::-1]
    out = np.empty(len(top), _RANKED)
    out["h"] = np.array([k for k, _ in top], np.int64).view(np.uint64)
    out["rank"] = np.arange(len(top))
    return np.sort(out, order="h")


def listings(docs: DataFrame, size: int, t: Threshold, hot_rows: np.ndarray, boundary: int, known: Ids) -> DataFrame:
    """(k, sid, n, edge): a listing of a set under a shingle, or (edge) a set's link to a node that may join it to others."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _batches(batches, size):
            keys, ids, sizes, edges = [], [], [], []

            def put(k: np.ndarray, sid: int, n: int, edge: bool) -> None:
                keys.append(k)
                ids.append(np.full(len(k), sid))
                sizes.append(np.full(len(k), n, np.int32))
                edges.append(np.full(len(k), edge))

            for s in sets:
                n = len(s)
                if not n:
                    continue
                sid = known.of(s)
                if n <= boundary:
                    subsets = [xxhash.xxh64_intdigest(np.array(c, np.uint64).tobytes(), seed=1) for o in t.subset_sizes(n, boundary) for c in combinations(s.tolist(), o)]
                    put(np.array(subsets, np.uint64) ^ _NODE, sid, n, True)
                if t.largest(n) > boundary:
                    o, cold = _in_order(s, hot.value)
                    to = t.listed(n)
                    put(o[: min(cold, to)], sid, n, False)
                    if to > cold:
                        put(o[cold:to] ^ _NODE, sid, n, True)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(edges))],
                    names=["k", "sid", "n", "edge"],
                )

    return docs.select("text").mapInArrow(run, "k long, sid long, n int, edge boolean")


def candidates(lists: DataFrame, t: Threshold) -> DataFrame:
    """(a, b, need, edge): pairs of sets of one list, or the edges of lists that are too long for that.

    Rows come sorted by list and size, so a list is a run, and pairs are runs compared with themselves moved on by 1, 2, ...
    """
    p = t.p

    def pairs(k: np.ndarray, sid: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (sid[1:] != sid[:-1])
        k, sid, n = k[fresh], sid[fresh], n[fresh]
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        length = np.repeat(np.diff(np.r_[first, len(k)]), np.diff(np.r_[first, len(k)]))
        long = length > LONGEST_LIST
        a, b, need, edge = [signed(k[long].view(np.uint64) ^ _NODE)], [sid[long]], [np.zeros(long.sum(), np.int32)], [np.ones(long.sum(), bool)]
        ok = (length > 1) & ~long
        k, sid, n = k[ok], sid[ok], n[ok]
        step = 1
        while step < len(k):
            same = k[step:] == k[:-step]
            if not same.any():
                break
            at = np.flatnonzero(same & (n[step:].astype(np.int64) * p <= n[:-step].astype(np.int64) * 100))
            x, y = sid[at], sid[at + step]
            a.append(np.minimum(x, y))
            b.append(np.maximum(x, y))
            need.append(np.minimum(1 + n[at] // 32, -(-p * n[at].astype(np.int64) // 100)).astype(np.int32))
            edge.append(np.zeros(len(at), bool))
            step += 1
        out = [np.concatenate(v) for v in (a, b, need, edge)]
        if len(out[0]):
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["a", "b", "need", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            now = tuple(np.asarray(batch.column(c)) for c in ("k", "sid", "n"))
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last list may go on in the next batch
            held.append(tuple(v[:cut] for v in now))
            if cut:
                yield from pairs(*[np.concatenate(v) for v in zip(*held, strict=True)])
                held = []
            held.append(tuple(v[cut:] for v in now))
        if held:
            yield from pairs(*[np.concatenate(v) for v in zip(*held, strict=True)])

    spark = lists.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = lists.filter(~F.col("edge")).select("k", "sid", "n").repartition(n, "k").sortWithinPartitions("k", "n", "sid")
    return sorted_.mapInArrow(run, "a long, b long, need int, edge boolean")


def overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, common shingles) of all i < j that share any, by scanning each set's inverted lists."""
    sizes = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    sorted_owner = owner[order]
    first = np.r_[True, tokens[order][1:] != tokens[order][:-1]]
    begin = np.flatnonzero(first)
    length = np.diff(np.r_[begin, len(order)])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    at, out = 0, []
    for i, n in enumerate(sizes.tolist()):
        mine = place[at : at + n]
        at += n
        mine = mine[length[mine] > 1]
        if not len(mine):
            continue
        size = length[mine]
        index = np.repeat(begin[mine] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        count = np.bincount(sorted_owner[index], minlength=len(sets))
        j = np.flatnonzero(count[i + 1 :]) + i + 1
        out.append((np.full(len(j), i), j, count[j]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def roots(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number in the component of each of m nodes."""
    label = np.arange(m)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    return label


def verify(groups: DataFrame, size: int, t: Threshold, ids: Ids) -> DataFrame:
    """(sid, low, links): of each set of a chunk pair, the copies linked with it there and one set of its component.

    ``groups``: root, i, j, chunk, chunks, sid, copies, text; rows of one (root, i, j) are a unit. A group's units are dealt to the
    tasks in turn.
    """

    def unit(rows: pa.Table) -> pa.RecordBatch:
        sets = shingle_sets(rows.column("text").combine_chunks(), size)
        sid, copies, chunk = (np.asarray(rows.column(c)) for c in ("sid", "copies", "chunk"))
        ok = np.array([bool(len(s)) and ids.of(s) == x for s, x in zip(sets, sid.tolist(), strict=True)])
        _, keep = np.unique(np.where(ok, sid, -1), return_index=True)
        keep = np.sort(keep[ok[keep]])
        sets, sid, copies, chunk = [sets[x] for x in keep], sid[keep], copies[keep], chunk[keep]
        links, label = np.zeros(len(sid), np.int64), np.arange(len(sid))
        if len(sets) > 1:
            order = np.argsort(sid)
            sets, sid, copies, chunk = [sets[x] for x in order], sid[order], copies[order], chunk[order]
            n = np.array([len(s) for s in sets])
            a, b, c = overlaps(sets)
            two = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
            linked = (100 * c >= t.p * (n[a] + n[b] - c)) & ((chunk[a] != chunk[b]) | (not two))
            a, b = a[linked], b[linked]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            label = roots(len(sid), a, b)
        return pa.RecordBatch.from_arrays([pa.array(sid), pa.array(sid[label]), pa.array(links)], names=["sid", "low", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(unit, units(batches, ("root", "i", "j")))

    spark = groups.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turn = F.xxhash64("root") + (F.col("j") * (F.col("j") + 1) / 2).cast("long") + F.col("i")  # i <= j: every number once
    dealt = groups.repartitionById(n, F.pmod(turn, F.lit(n)).cast("int")).sortWithinPartitions("root", "i", "j")
    return dealt.mapInArrow(run, "sid long, low long, links long")


def join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, n_links, component_id), a row for each of ``docs``.

    n_links counts the other rows linked directly; component_id is the smallest doc_id that links reach.
    """
    spark = docs.sparkSession
    ship(spark)
    shared, t = Shared(spark, "ngrams"), Threshold(percent)
    docs = docs.select("doc_id", "text")
    rows, sets, ids = classes_of(docs, size, shared)
    named = docs.filter(F.col("doc_id").isNotNull())
    hot, mean_list = frequent(named, size, t)
    lists = shared.save(listings(named, size, t, hot, t.boundary(mean_list), ids), "lists")
    cand = candidates(lists, t)
    near = cand.filter(~F.col("edge")).groupBy("a", "b").agg(F.count("*").alias("c"), F.min("need").alias("need")).filter("c >= need").select("a", "b")
    nodes = lists.filter("edge").select(F.col("k").alias("a"), F.col("sid").alias("b")).distinct()
    nodes = shared.save(nodes, "nodes")
    # a node that only one set has joins nothing
    shared_nodes = shared.save(nodes.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1").select("a"), "shared-nodes")
    edges = near.unionByName(nodes.join(shared_nodes, "a"))
    edges = edges.unionByName(cand.filter("edge").select("a", "b"))
    group_of = shared.save(components(edges, shared), "groups")
    shared.drop(lists, nodes, shared_nodes)
    member = sets.join(group_of.withColumnRenamed("node", "sid"), "sid")
    sizes = member.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    cut = F.greatest(F.ceil(F.col("m") / CHUNK_SETS), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int")
    sizes = shared.save(sizes.select("root", cut.alias("chunks")), "sizes")
    chunk = F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int")
    member = shared.save(member.join(sizes, "root").select("root", "sid", "copies", F.col("first_id").alias("doc_id"), "chunks", chunk.alias("chunk")), "members")
    # the texts are dealt by doc_id at every size: whether the members fit a broadcast says nothing about the next table
    both = member.join(named.hint("merge"), "doc_id").select("root", "sid", "copies", "chunk", "chunks", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    groups = both.select("root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "chunks", "sid", "copies", "text")
    found = shared.save(verify(groups, size, t, ids), "found")
    linked = found.filter("sid <> low").select(F.col("sid").alias("a"), F.col("low").alias("b"))
    root_of = shared.save(components(linked, shared), "roots").select(F.col("node").alias("sid"), "root")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = sets.join(root_of, "sid", "left").join(links, "sid", "left").select("sid", "first_id", "copies", "links", F.coalesce("root", "sid").alias("root"))
    classes = shared.save(classes, "classes")
    smallest = shared.save(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    classes = classes.join(smallest, "root").select("sid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    classes = shared.save(classes, "classes")
    out = rows.join(classes, "sid", "left")
    named_row = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(named_row, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(named_row, F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
