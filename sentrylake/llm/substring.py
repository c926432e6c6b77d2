"""Substring deduplication with a compressed FM-index per shard.

A window is WINDOW consecutive words; the windows whose words also start earlier (smaller doc_id, or earlier in the same
text) are repeats. Every window has a smallest hashed GRAM-gram, its anchor, so equal windows have equal anchors, and the run of
windows with one anchor place is a segment. Segments with equal words are one, kept at its earliest place, so a passage that very many
documents share is one row a chunk. What is left to compare are anchors with different segments, mostly the edges of shared passages.

A shard holds all different segments of some anchors. They are concatenated and indexed: suffix order by WINDOW words, a wavelet
matrix over the words' numbers (packed bits with counts for rank), and the earliest place of each suffix instead of the suffix
array. The windows of the shard's segments are searched backwards; the number of words matched is the matching
statistic, cut off at WINDOW, and where it reaches WINDOW the interval of suffixes gives the earliest place.

An anchor with more than HEAVY different segments (or HEAVY_HERE in one chunk) is dealt window by window instead, by the windows' own
hashes, so that its different surroundings spread over all buckets. Chunks ask buckets, see ``chunks``: first which segments are known
and which anchors are shared, then the shards about their windows. Only numbers come back.

Null texts have no words. doc_id is a whole number; a row without one is reported without removal and is nobody's repeat.
Rows with equal ids stand in the order in which they were read, so of equal rows one keeps its words. Words are compared by 64-bit
hashes, segments and windows by 128 bits. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import answered, batch, bucket_count, bucket_edges, chunked, deal, pack_counts, pack_keys, pack_numbers, pieces, unpack_counts, unpack_keys, unpack_numbers, whole
from .shared import Shared, ship
from .words import byte_texts, grams, hash_column, mix

WINDOW, GRAM = 20, 8
HEAVY, HEAVY_HERE = 2048, 64
#: Bytes of text in a chunk, and of text whose segments meet in a bucket; words that one index holds, about.
CHUNK, BUCKET = 12 << 20, 24 << 20
SHARD_WORDS = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: What a bucket says of a segment.
ALONE, REPEAT, INDEXED, WINDOWED = range(4)


def anchors(h: np.ndarray, counts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor place: (anchor hash, first window, windows, text); texts lie end to end."""
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(h) - window + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    g = grams(h, gram)
    span = window - gram + 1
    # the place of the smallest gram of each window, the last one of equals; by doubling
    place, width = np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        a, b = place[:-step], place[step:]
        place = np.where(g[b] <= g[a], b, a)
        width += step
    place = place[:n]
    inside = np.flatnonzero(text[:n] == text[window - 1 :])
    place = place[inside]
    if not len(inside):
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (inside[1:] != inside[:-1] + 1)])
    # anchors are the smallest of their neighbours: hashed again, so that they spread over all buckets
    return mix(g[place[first]] + _STEP), inside[first], np.diff(np.r_[first, len(inside)]), text[inside[first]]


class RunHashes:
    """Hashes of runs of words, by differences of running sums."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h) + 1
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self.up = np.multiply.accumulate(up)
        self.sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(down)[:-1])]

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        end = start + size
        return mix((self.sums[end] - self.sums[start]) * self.up[end - 1] + size.astype(np.uint64))


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of n."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where rows that are sorted by the columns begin to be others."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, new])


class Segments:
    """The segments of the texts of a piece, and which of them are different; every pass makes the same ones."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        ids = whole(rows.column("doc_id")).cast(pa.int64())
        self.h, self.counts = hash_column(whole(rows.column("text")))
        self.first_row = rows.column("_row")[0].as_py()
        a, start, n, text = anchors(self.h, self.counts, window, gram)
        ok = ids.is_valid().to_numpy(zero_copy_only=False)[text]
        self.anchor, self.start, self.n, self.text = a[ok], start[ok], n[ok], text[ok]
        self.doc = ids.fill_null(0).to_numpy()[self.text]
        self.begin = (np.cumsum(self.counts) - self.counts)[self.text]
        self.window = window
        self.hash = RunHashes(self.h, _BASES[0]).of(self.start, self.n + window - 1)
        order = np.lexsort((self.doc, self.hash, self.anchor))
        first = firsts(self.anchor[order], self.hash[order])
        #: the earliest segment of each different one, in the order of anchor and hash, and the number of each segment's one
        self.earliest = order[first]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        keys = self.anchor[self.earliest]
        by_anchor = firsts(keys)
        many = np.diff(np.r_[by_anchor, len(keys)])
        #: anchors with too many different segments are asked once, with a mark
        self.heavy_here = np.repeat(many > HEAVY_HERE, many)
        self.asked = np.sort(np.r_[np.flatnonzero(~self.heavy_here), by_anchor[many > HEAVY_HERE]])

    def told(self, flags: np.ndarray) -> np.ndarray:
        """What is said of each different segment, from the answers to ``asked``."""
        said = np.full(len(self.earliest), WINDOWED)
        said[self.asked] = flags
        said[self.heavy_here] = WINDOWED
        return said

    def windows(self, said: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of segments dealt window by window: (places, their numbers) of all, and (hash, second hash, segment) of the different ones."""
        of = np.flatnonzero(said[self.number] == WINDOWED)
        at = spread(self.start[of], self.n[of])
        of = np.repeat(of, self.n[of])
        size = np.full(len(at), self.window)
        w1, w2 = (RunHashes(self.h, b).of(at, size) for b in _BASES)
        order = np.lexsort((self.doc[of], w2, w1))
        first = firsts(w1[order], w2[order])
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        early = order[first]
        return at, number, early, w1[early], w2[early], of[early]


def ask_segments(chunks: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """The different segments of each piece, to the buckets of their anchors."""
    edges = bucket_edges(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            s = Segments(rows, window, gram)
            chunk, at = rows.column("_chunk")[0].as_py(), s.earliest[s.asked]
            mark = s.heavy_here[s.asked].astype(np.int64)
            made = []
            for i, x in deal(s.anchor[at], edges):
                e = at[x]
                made.append((i, chunk, s.first_row, len(e), pack_keys(s.anchor[e]), s.hash[e].tobytes(), pack_numbers(s.doc[e]), pack_numbers(s.text[e]), pack_counts(mark[x])))
            # a piece without segments is known by an empty row
            yield batch(made or [(chunk % buckets, chunk, s.first_row, 0, b"", b"", b"", b"", pack_counts(s.n[:0]))], "bucket _chunk piece n keys hashes docs rows marks", "llllbbbbb")

    return chunks.mapInArrow(run, "bucket long, _chunk long, piece long, n long, keys binary, hashes binary, docs binary, rows binary, marks binary")


def _joined(rows: pa.Table, f, *names: str) -> np.ndarray:
    """The unpacked numbers of a column of all rows."""
    columns = [rows.column(c).to_pylist() for c in (*names, "n")]
    return np.concatenate([f(*x) for x in zip(*columns, strict=True)])


def _row_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Chunk and row of everything asked."""
    n = rows.column("n").to_numpy()
    row = _joined(rows, unpack_numbers, "rows") + np.repeat(rows.column("piece").to_numpy(), n)
    return np.repeat(rows.column("_chunk").to_numpy(), n), row


def _answers(rows: pa.Table, kind: int, values: np.ndarray, pack) -> pa.Table:
    n = rows.column("n").to_pylist()
    parts = np.split(values, np.cumsum(n)[:-1])
    made = [(c, p, b, kind, k, pack(v)) for c, p, b, k, v in zip(rows.column("_chunk").to_pylist(), rows.column("piece").to_pylist(), rows.column("bucket").to_pylist(), n, parts, strict=True)]
    return pa.Table.from_batches([batch(made, "_chunk piece bucket kind n data", "lllllb")])


_ANSWERS = "_chunk long, piece long, bucket long, kind long, n long, data binary"


def tell_segments(asked: DataFrame, heavy: int) -> DataFrame:
    """Of each segment asked: alone with its anchor, a repeat, to be indexed, or to be dealt window by window."""

    def run(rows: pa.Table) -> pa.Table:
        anchor = _joined(rows, unpack_keys, "keys")
        hash_ = _joined(rows, lambda d, n: np.frombuffer(d, np.uint64, n), "hashes")
        doc, mark = _joined(rows, unpack_numbers, "docs"), _joined(rows, unpack_counts, "marks")
        chunk, row = _row_of(rows)
        order = np.lexsort((row, chunk, doc, hash_, anchor))
        a, first = anchor[order], firsts(anchor[order], hash_[order])
        by_anchor = firsts(a)
        size = np.diff(np.r_[by_anchor, len(a)])
        is_first = np.zeros(len(a), np.int64)
        is_first[first] = 1
        different = np.repeat(np.add.reduceat(is_first, by_anchor), size) if len(a) else is_first
        marked = np.repeat(np.maximum.reduceat(mark[order], by_anchor), size) if len(a) else is_first
        flags = np.where(is_first == 0, REPEAT, np.where(different > 1, INDEXED, ALONE))
        flags = np.where((marked > 0) | (different > heavy), WINDOWED, flags)
        out = np.empty(len(a), np.int64)
        out[order] = flags
        return _answers(rows, 0, out, pack_counts)

    return asked.groupBy("bucket").applyInArrow(run, _ANSWERS)


def _told(found: pa.Table, kind: int, unpack) -> np.ndarray:
    """The answers of one kind in the order of what was asked."""
    kinds, bucket, n = (found.column(c).to_numpy() for c in ("kind", "bucket", "n"))
    mine = np.flatnonzero(kinds == kind)
    mine = mine[np.argsort(bucket[mine])]
    data = found.column("data")
    return np.concatenate([*(unpack(data[i].as_py(), int(n[i])) for i in mine.tolist()), np.zeros(0, np.int64)])


def ask_windows(chunks: DataFrame, answers: DataFrame, buckets: int, window: int, gram: int) -> DataFrame:
    """The words of segments to be indexed (even buckets), and windows by themselves (odd ones)."""
    edges = bucket_edges(buckets)
    names = "bucket _chunk piece n keys hashes docs rows starts sizes words"

    def piece(found: pa.Table, rows: pa.Table) -> pa.Table:
        s = Segments(rows, window, gram)
        chunk = rows.column("_chunk")[0].as_py()
        said = s.told(_told(found, 0, unpack_counts))
        made = []
        at = s.earliest[said == INDEXED]
        for i, x in deal(s.anchor[at], edges):
            e = at[x]
            size = s.n[e] + window - 1
            words = s.h[spread(s.start[e], size)]
            made.append((2 * i, chunk, s.first_row, len(e), pack_keys(s.anchor[e]), b"", pack_numbers(s.doc[e]), pack_numbers(s.text[e]), pack_numbers(s.start[e] - s.begin[e]), pack_numbers(size), words.tobytes()))
        _, _, _, w1, w2, of = s.windows(said)
        for i, x in deal(w1, edges):
            made.append((2 * i + 1, chunk, s.first_row, len(of[x]), pack_keys(w1[x]), w2[x].tobytes(), pack_numbers(s.doc[of[x]]), pack_numbers(s.text[of[x]]), b"", b"", b""))
        return pa.Table.from_batches([batch(made, names, "llllbbbbbbb")])

    kinds = ", ".join(f"{c} {'long' if i < 4 else 'binary'}" for i, c in enumerate(names.split()))
    return answered(chunks, answers, kinds, piece)


def tell_windows(asked: DataFrame, window: int) -> DataFrame:
    """Of each segment: bits of the windows that start earlier elsewhere; of each window alone: whether it is the earliest."""

    def run(rows: pa.Table) -> pa.Table:
        key, doc = _joined(rows, unpack_keys, "keys"), _joined(rows, unpack_numbers, "docs")
        chunk, row = _row_of(rows)
        if rows.column("bucket")[0].as_py() % 2:
            other = _joined(rows, lambda d, n: np.frombuffer(d, np.uint64, n), "hashes")
            order = np.lexsort((row, chunk, doc, other, key))
            out = np.zeros(len(order), np.int64)
            out[order[firsts(key[order], other[order])]] = 1
            return _answers(rows, 2, out, pack_counts)
        start, size = _joined(rows, unpack_numbers, "starts"), _joined(rows, unpack_numbers, "sizes")
        words = np.concatenate([np.frombuffer(d, np.uint64) for d in rows.column("words").to_pylist()])
        place = np.lexsort((row, chunk, doc))
        text = np.empty(len(place), np.int64)  # texts in the order of their places
        text[place] = np.repeat(np.arange(len(f := firsts(doc[place], chunk[place], row[place]))), np.diff(np.r_[f, len(place)]))
        order = np.argsort(key, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        bits = np.zeros(len(order), np.int64)
        held = np.cumsum(size[order])
        cuts = firsts(key[order])
        # whole anchors to an index, about SHARD_WORDS words to each
        shard = (held - size[order])[cuts] // SHARD_WORDS
        to = [*cuts[firsts(shard)].tolist(), len(order)]
        for a, b in zip(to[:-1], to[1:], strict=True):
            o = order[a:b]
            flags = repeats_in_shard(words[spread(begin[a:b], size[o])], size[o], text[o], start[o], window)
            n = size[o] - window + 1
            value = flags.astype(np.int64) << spread(np.zeros(len(n), np.int64), n)
            bits[o] = np.add.reduceat(value, np.cumsum(n) - n)
        return _answers(rows, 1, bits, pack_numbers)

    return asked.groupBy("bucket").applyInArrow(run, _ANSWERS)


class Bits:
    """A row of bits, packed, with the number of ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words))].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """rank of a symbol in a sequence of numbers below 2 ** levels."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.rows: list[tuple[int, Bits, int]] = []
        for level in range(levels - 1, -1, -1):
            bit = (sequence >> level & 1).astype(np.uint8)
            self.rows.append((level, Bits(bit), int(len(bit) - bit.sum())))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of each symbol before lo and before hi, less the rank where the symbol's block begins."""
        zero = np.zeros(len(symbol), np.int64)
        for level, bits, zeros in self.rows:
            one = (symbol >> level & 1).astype(bool)
            a, b, c = bits.rank(lo), bits.rank(hi), bits.rank(zero)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
            zero = np.where(one, zeros + c, zero - c)
        return lo - zero, hi - zero


class FMIndex:
    """Over a sequence of symbols of 1 and more (0 ends a segment); suffixes are ordered by their first ``depth`` symbols."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n = len(sequence)
        rank, width = sequence.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width < depth:
            after = np.zeros(n, np.int64)
            after[:-width] = rank[width:] + 1
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
            rank = np.empty(n, np.int64)
            rank[order] = new
            width *= 2
            if new[-1] == n - 1:
                break
        self.order = order
        top = int(sequence.max()) + 1
        self.begin = np.r_[0, np.cumsum(np.bincount(sequence, minlength=top))]
        self.last = WaveletMatrix(sequence[order - 1], max(1, top.bit_length()))
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the rows of ``patterns``, read from their ends: words matched, and the suffixes lo to hi."""
        m, depth = patterns.shape
        lo, hi, matched = np.zeros(m, np.int64), np.full(m, self.n), np.zeros(m, np.int64)
        live = np.arange(m)
        for j in range(depth - 1, -1, -1):
            symbol = patterns[live, j]
            a, b = self.last.step(symbol, lo[live], hi[live])
            a, b = a + self.begin[symbol], b + self.begin[symbol]
            on = b > a
            live = live[on]
            lo[live], hi[live] = a[on], b[on]
            matched[live] += 1
        return matched, lo, hi

    def keep(self, when: np.ndarray) -> None:
        """From now on the index knows the rank in time of each suffix, and no longer where it stands."""
        self.when = np.r_[when[self.order], np.iinfo(np.int64).max]
        del self.order

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(self.when, np.stack([lo, hi], 1).ravel())[::2]


def repeats_in_shard(flat: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """For each window of the segments, whose words stand in ``flat`` one after the other, whether it also starts earlier in this shard."""
    _, number = np.unique(flat, return_inverse=True)
    ends = np.cumsum(size + 1)
    sequence = np.zeros(len(flat) + len(size), np.int64)
    inner = np.ones(len(sequence), bool)
    inner[ends - 1] = False
    sequence[inner] = number + 1
    index = FMIndex(sequence, window)
    segment = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(sequence)) - np.repeat(ends - size - 1, size + 1)
    at_word = start[segment] + place
    at = np.lexsort((at_word, doc[segment]))
    when = np.empty(len(sequence), np.int64)
    same = (doc[segment][at][1:] == doc[segment][at][:-1]) & (at_word[at][1:] == at_word[at][:-1])
    when[at] = np.r_[0, np.cumsum(~same)]  # a place that two segments cover counts once
    index.keep(when)
    first = np.flatnonzero(place <= size[segment] - window)
    earlier = np.zeros(len(first), bool)
    for i in range(0, len(first), 1 << 16):
        some = first[i : i + (1 << 16)]
        matched, lo, hi = index.search(sequence[some[:, None] + np.arange(window)])
        full = np.flatnonzero((matched >= window) & (hi - lo > 1))
        if len(full):
            earlier[i + full] = index.earliest(lo[full], hi[full]) < when[some[full]]
    return earlier


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that no repeat covers, joined by single spaces, as bytes."""
    spark = docs.sparkSession
    ship(spark)
    shared = Shared(spark, "substrings")
    chunks = shared.save(chunked(docs.select("doc_id", "text"), CHUNK), "chunks")
    buckets = bucket_count(chunks, BUCKET)
    segments = shared.save(tell_segments(ask_segments(chunks, buckets, window, gram), heavy), "segments")
    windows = shared.save(tell_windows(ask_windows(chunks, segments, buckets, window, gram), window), "windows")

    def piece(found: pa.Table, rows: pa.Table) -> pa.Table:
        s = Segments(rows, window, gram)
        said = s.told(_told(found, 0, unpack_counts))
        is_first = np.zeros(len(s.number), bool)
        is_first[s.earliest] = True
        all_gone = np.flatnonzero((said[s.number] == REPEAT) | ((said[s.number] != WINDOWED) & ~is_first))
        at, number, early, w1, _, _ = s.windows(said)
        one_gone = ~_told(found, 2, unpack_counts).astype(bool)[number]
        one_gone[np.setdiff1d(np.arange(len(at)), early)] = True
        indexed = s.earliest[said == INDEXED]
        bits = np.repeat(_told(found, 1, unpack_numbers), s.n[indexed])
        places = spread(s.start[indexed], s.n[indexed])
        bit = bits >> spread(np.zeros(len(indexed), np.int64), s.n[indexed]) & 1
        single = np.r_[at[one_gone], places[bit.astype(bool)]]
        begin = np.r_[s.start[all_gone], single]
        end = np.r_[s.start[all_gone] + s.n[all_gone] + window - 1, single + window]
        edge = np.bincount(begin, minlength=len(s.h) + 1) - np.bincount(end, minlength=len(s.h) + 1)
        gone = np.cumsum(edge)[:-1] > 0
        removed, kept_text, done = [], [], 0
        for text, n in zip(byte_texts(whole(rows.column("text"))), s.counts.tolist(), strict=True):
            words, mine = (text or b"").split(), gone[done : done + n]
            done += n
            removed.append(int(mine.sum()))
            kept_text.append(b" ".join([words[j] for j in np.flatnonzero(~mine).tolist()] if removed[-1] else words))
        return pa.Table.from_arrays([whole(rows.column("doc_id")), pa.array(s.counts), pa.array(removed, pa.int64()), pa.array(kept_text, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = dict(docs.dtypes)["doc_id"]
    return answered(chunks, segments.unionByName(windows), f"doc_id {kind}, n_words long, n_removed long, kept binary", piece)
