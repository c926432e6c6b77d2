"""Language-model scores from a weighted backoff automaton of words.

The counts of all training documents give a smoothed model of n-grams of up to ORDER words; every n-gram that occurs is in
it, at every size of the corpus. A context u v that occurs is a state. Its arc for w has the weight of

    p(w | u v) = (c(u v w) + PRIOR * p(w | v)) / (c(u v) + PRIOR)

if u v w occurs; for all other words its failure arc leads to the state v at the cost PRIOR / (c(u v) + PRIOR), which is the same
formula with c(u v w) = 0. The empty context has ADD added to every count and one unknown word. So every weight is made from
counts of n-grams that stand in the text itself, and the probabilities of a state sum to one.

The model is never in one place. Texts are written in chunks; a chunk sends the sorted hashes of its distinct n-grams, as gaps of
few bytes, in one piece to each bucket of hashes, with their counts in its training rows. A bucket adds the counts up
and answers each piece with the sums alone, in the order of its keys. With them a chunk has the part of the automaton that its texts
can visit, and walks it from left to right: the state after each word is the longest context that occurs, known from the
counts, so a step is taken for all places of a chunk at once.

Words are as in ``words`` with A-Z lower-cased, and every text ends with one end token, a null or empty text being that
token alone. Without training rows all probabilities are one. Every row is scored by itself, also when ids repeat or are
null. An empty table gives an empty result. N-grams are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import answered, batch, bucket_count, bucket_edges, chunked, deal, pack_counts, pack_keys, pieces, unpack_counts, unpack_keys, whole
from .shared import Shared, ship
from .words import hash_column, mix

#: PRIOR was chosen by the likelihood of held-out texts.
ORDER, ADD, PRIOR = 3, 0.1, 16.0
#: not the hash of any word
END = np.uint64(0x9D39247E33776D41)
#: Bytes of text in a chunk, and of text whose n-grams meet in a bucket.
CHUNK, BUCKET = 12 << 20, 24 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each with its end, and the number of tokens of each text."""
    h, counts = hash_column(column, lower=True)
    out = np.full(len(h) + len(column), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts + 1) - 1] = False
    out[inner] = h
    return out, counts + 1


def grams(h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the keys of the n-grams of all texts, and the place of each one's last token. A word's key is its hash."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    keys, last = h, np.arange(len(h))
    for n in range(1, ORDER + 1):
        yield keys, last
        whole = np.zeros(len(h), np.uint64)
        whole[last] = keys
        last = np.flatnonzero(place >= n)
        keys = mix(mix(whole[last - 1] + _STEP) * np.uint64(3) + whole[last])


def _asked(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, _chunk, piece, n, keys, counts): the distinct n-grams of each piece of a chunk, dealt by their hashes."""
    edges = bucket_edges(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in pieces(batches):
            chunk, piece = rows.column("_chunk")[0].as_py(), rows.column("_row")[0].as_py()
            h, counts = tokens(whole(rows.column("text")))
            learned = np.repeat(~whole(rows.column("held_out")).fill_null(True).to_numpy(zero_copy_only=False), counts)
            for n, (keys, last) in enumerate(grams(h, counts)):
                if not len(keys):
                    continue
                order = np.argsort(keys)
                keys = keys[order]
                first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                c = np.add.reduceat(learned[last[order]].astype(np.int64), first)
                keys = keys[first]
                made = [(i * ORDER + n, chunk, piece, s.stop - s.start, pack_keys(keys[s]), pack_counts(c[s])) for i, s in deal(keys, edges)]
                yield batch(made, "bucket _chunk piece n keys counts", "llllbb")

    return chunks.select("text", "held_out", "_chunk", "_row").mapInArrow(run, "bucket long, _chunk long, piece long, n long, keys binary, counts binary")


def _summed(asked: DataFrame) -> DataFrame:
    """(_chunk, piece, bucket, n, counts, n_words, n_tokens): each piece's keys' counts in all training rows; a row without a chunk has a bucket's words."""

    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("n").to_pylist()
        k = np.concatenate([unpack_keys(d, n) for d, n in zip(rows.column("keys").to_pylist(), size, strict=True)])
        c = np.concatenate([unpack_counts(d, n) for d, n in zip(rows.column("counts").to_pylist(), size, strict=True)])
        order = np.argsort(k, kind="stable")
        k = k[order]
        fresh = np.r_[True, k[1:] != k[:-1]]
        total = np.add.reduceat(c[order], np.flatnonzero(fresh))
        c[order] = total[np.cumsum(fresh) - 1]
        bucket = rows.column("bucket")[0].as_py()
        made = [pack_counts(x) for x in np.split(c, np.cumsum(size)[:-1])]
        out = [(*x, None, None) for x in zip(rows.column("_chunk").to_pylist(), rows.column("piece").to_pylist(), [bucket] * len(made), size, made, strict=True)]
        if bucket % ORDER == 0:
            out.append((None, None, bucket, 0, None, int((total > 0).sum()), int(total.sum())))
        return pa.Table.from_batches([batch(out, "_chunk piece bucket n counts n_words n_tokens", "llllbll")])

    return asked.groupBy("bucket").applyInArrow(run, "_chunk long, piece long, bucket long, n long, counts binary, n_words long, n_tokens long")


class Automaton:
    """The part of the automaton that the n-grams of some texts visit, from the counts of those n-grams.

    ``orders`` has, for each order, the number of each n-gram of the texts, the place of its last token, and the counts by number.
    """

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_places: int, n_tokens: int, n_words: int):
        self.n_places = n_places
        self.steps: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        shorter = count = None
        for number, last, c in orders:
            any_place = np.empty(len(c), np.int64)
            any_place[number] = last  # a place of each n-gram
            if shorter is None:
                p, fail = (c + ADD) / (n_tokens + ADD * (n_words + 1)), np.zeros(n_places)
                at_place = np.zeros(n_places)
            else:
                below = count[any_place - 1] + PRIOR  # what the context is seen, and the prior
                p = (c + PRIOR * shorter[any_place]) / below
                fail = np.log10(PRIOR / (count + PRIOR))
                at_place = shorter.copy()
            at_place[last] = p[number]
            here = np.zeros(n_places)
            here[last] = c[number]
            self.steps.append((number, last, c > 0, np.log10(p), fail))
            shorter, count = at_place, here

    def walk(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place: whether its token is known, its weight at the empty context, and its weight from the state before it.

        From the longest context on, a place takes its arc or adds the failure arc's weight and tries the next context.
        """
        total, open_ = np.zeros(self.n_places), np.ones(self.n_places, bool)
        for number, last, arc, weight, fail in reversed(self.steps[1:]):
            here = last[open_[last]]
            number = number[open_[last]]
            taken = arc[number]
            total[here[taken]] += weight[number[taken]]
            open_[here[taken]] = False
            total[here[~taken]] += fail[here[~taken] - 1]
        number, _, known, weight, _ = self.steps[0]
        total[open_] += weight[number[open_]]
        return known[number], weight[number], total


def _score(chunks: DataFrame, answers: DataFrame, n_tokens: int, n_words: int, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns with n_tokens, n_known, train_tokens, base_score and score of every row."""
    fields = ", ".join(f"`{c}` {t}" for c, t in chunks.select(*keep).dtypes)

    def piece(found: pa.Table, rows: pa.Table) -> pa.Table:
        h, counts = tokens(whole(rows.column("text")))
        bucket, size, data = found.column("bucket").to_numpy(), found.column("n").to_numpy(), found.column("counts")
        orders = []
        for n, (keys, last) in enumerate(grams(h, counts)):
            distinct, number = np.unique(keys, return_inverse=True)
            mine = np.flatnonzero(bucket % ORDER == n)
            mine = mine[np.argsort(bucket[mine])]
            assert size[mine].sum() == len(distinct), "a piece has other n-grams than it asked for"
            parts = [unpack_counts(data[i].as_py(), int(size[i])) for i in mine.tolist()]
            orders.append((number.astype(np.int32), last, np.concatenate([*parts, np.zeros(0, np.int64)])))
        known, base, total = Automaton(orders, len(h), n_tokens, n_words).walk()
        starts = np.cumsum(counts) - counts
        made = [counts, np.add.reduceat(known.astype(np.int64), starts), np.full(len(counts), n_tokens), np.add.reduceat(base, starts), np.add.reduceat(total, starts)]
        return pa.Table.from_arrays([*[rows.column(c) for c in keep], *map(pa.array, made)], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    answers = answers.filter("_chunk IS NOT NULL").select("_chunk", "piece", "bucket", "n", "counts")
    return answered(chunks, answers, f"{fields}, n_tokens long, n_known long, train_tokens long, base_score double, score double", piece)


def score_table(docs: DataFrame, held_out: Column, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the rows that are not held out and score all; ``held_out`` is carried along."""
    ship(docs.sparkSession)
    shared = Shared(docs.sparkSession, "lm")
    chunks = shared.save(chunked(docs.select(*keep, held_out.alias("held_out"), "text"), CHUNK), "chunks")
    answers = shared.save(_summed(_asked(chunks, bucket_count(chunks, BUCKET))), "answers")
    n_tokens, n_words = answers.filter("_chunk IS NULL").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    return _score(chunks, answers, n_tokens, n_words, (*keep, "held_out"))
