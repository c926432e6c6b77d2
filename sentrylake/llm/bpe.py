"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is one token that ends its encoding: the longest candidate whose neighbour, the last
token of the prefix before it, may stand beside it (``Tables.fit``). So an encoding is a row of last tokens, one a byte; appending
bytes only extends the row, and after an edit the row is right again as soon as it meets the old one.

Texts are cut into pieces by the tokenizer's pattern and each piece is encoded alone, without special tokens. A null text
is an empty one and has no tokens. Repeated pieces of up to CACHE_BYTES bytes are looked up, at most CACHE of them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship
from .words import slices

CACHE, CACHE_BYTES, KNOWN_FITS = 400_000, 48, 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tables:
    """What encoding needs of a vocabulary: its tokens, how each splits in two, and which pairs merge into one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.length = {i: len(b) for b, i in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.own: dict[bytes, int] = {}  # tokens that are the encoding of their own bytes
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1:
                self.split[i] = (i, i)
                self.own[b] = i
                continue
            for at in range(1, len(b)):
                left, right = self.own.get(b[:at]), self.own.get(b[at:])
                if left is not None and right is not None and left < i and right < i and self.fit(left, right):
                    self.split[i] = (left, right)
                    self.merged[left, right] = i
                    self.own[b] = i
                    break
        #: A tree of the tokens read from their ends: (node << 8 | byte) -> node, and the token at a node or -1.
        self.tree: dict[int, int] = {}
        self.token_at = [-1]
        for b, i in self.own.items():
            node = 0
            for byte in reversed(b):
                step = node << 8 | byte
                node = self.tree.get(step, -1)
                if node < 0:
                    node = self.tree[step] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = i
        self.known_fits: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        """``fit``, looked up where it was asked before (at most KNOWN_FITS answers are kept)."""
        key = left << 32 | right
        known = self.known_fits.get(key)
        if known is None:
            known = self.fit(left, right)
            if len(self.known_fits) < KNOWN_FITS:
                self.known_fits[key] = known
        return known

    def fit(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together.

        The merges are undone from the later one to the earlier on either side of the border; the tokens that then touch
        must not have a merge that would have come before the one that was undone.
        """
        limit, split, merged = 1 << 60, self.split, self.merged
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, part = left, split[left][1]
                if part != left:
                    left = part
                    continue
                limit, part = right + 1, split[right][0]
                if part == right:
                    return True
                right = part
            else:
                limit, part = right + 1, split[right][0]
                if part != right:
                    right = part
                    continue
                limit, part = left, split[left][1]
                if part == left:
                    return True
                left = part


class Prefixes:
    """The last token of every prefix of a piece; ``append`` and ``replace`` keep it exact."""

    def __init__(self, tables: Tables, piece: bytes = b""):
        self.tables, self.piece, self.last = tables, b"", []
        self.append(piece)

    def _grow(self, to: int, stop=None) -> None:
        """Last tokens of the prefixes up to length ``to``, or until ``stop`` says so.

        The longest token that ends at a byte and fits is the only one that does both.
        """
        t, piece, last = self.tables, self.piece, self.last
        step, token_at, known, fits = t.tree.get, t.token_at, t.known_fits.get, t.fits
        for end in range(len(last), to):
            node, at, found = 0, end, []
            while at >= 0:
                node = step(node << 8 | piece[at])
                if node is None:
                    break
                token = token_at[node]
                if token >= 0:
                    found.append((at, token))
                at -= 1
            while True:
                at, token = found.pop()
                if at == 0:
                    break
                left = last[at - 1]
                fit = known(left << 32 | token)
                if fit or fit is None and fits(left, token):
                    break
            last.append(token)
            if stop is not None and stop():
                return

    def append(self, more: bytes) -> None:
        self.piece += more
        self._grow(len(self.piece))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` for bytes start to stop; returns how many prefixes were computed anew.

        Behind the edit the old row holds again once ``longest`` prefixes in a row agree with it: a last token depends on
        nothing further back.
        """
        old, shift, far = self.last, len(new) - (stop - start), self.tables.longest
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last, edited, same = old[:start], start + len(new), 0

        def met() -> bool:
            nonlocal same
            end = len(self.last)
            same = same + 1 if end > edited and old[end - 1 - shift] == self.last[-1] else 0
            return same >= far

        self._grow(len(self.piece), met)
        done = len(self.last) - start
        self.last.extend(old[len(self.last) - shift :])
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.tables.bytes_of[out[-1]])
        return out[::-1]


class _Lookup:
    """Whole numbers to numbers, asked for in arrays; open addressing over a table of ``1 << bits`` places."""

    def __init__(self, bits: int):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.used = 0

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def put(self, keys: np.ndarray, values: list[int]) -> None:
        """Keys that are not in it yet."""
        last = (1 << self.bits) - 1
        for key, at, value in zip(keys.tolist(), self._place(keys).tolist(), values, strict=True):
            while self.keys[at] != -1:
                at = at + 1 & last
            self.keys[at], self.values[at] = key, value
        self.used += len(values)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is missing."""
        at, last = self._place(keys), (1 << self.bits) - 1
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], -1)
        more = np.flatnonzero((there != keys) & (there != -1))
        while len(more):
            at[more] = at[more] + 1 & last
            there = self.keys[at[more]]
            hit = there == keys[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (there != -1)]
        return out


class Rows:
    """The rows of last tokens of many pieces at once, one prefix length after the other."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.tree = _Lookup(max(8, len(tables.tree).bit_length() + 1))
        self.tree.put(np.fromiter(tables.tree, np.int64, len(tables.tree)), list(tables.tree.values()))
        self.token_at = np.array(tables.token_at, np.int64)
        self.known = _Lookup(KNOWN_FITS.bit_length() + 1)

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        out = self.known.get(keys)
        new = np.unique(keys[out < 0])
        if len(new):
            if self.known.used + len(new) > KNOWN_FITS:
                self.known.clear()
                new = np.unique(keys)
            self.known.put(new, [self.tables.fit(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()])
            out = self.known.get(keys)
        return out == 1

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
        size = np.array([len(pieces[i]) for i in order])
        width = int(size[0]) if len(size) else 0
        text = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width).T.astype(np.int64)
        last = np.zeros((width, len(order)), np.int64)
        for end in range(1, width + 1):
            rows = np.arange(int(np.searchsorted(-size, -end, "right")))
            token, node, found = np.full(len(rows), -1), np.zeros(len(rows), np.int64), []
            for start in range(end - 1, -1, -1):
                node = self.tree.get(node << 8 | text[start, rows])
                rows, node = rows[node >= 0], node[node >= 0].astype(np.int64)
                if not len(rows):
                    break
                at = self.token_at[node]
                found.append((start, rows[at >= 0], at[at >= 0]))
            for start, rows, at in reversed(found):
                free = token[rows] < 0
                rows, at = rows[free], at[free]
                if start and len(rows):
                    fit = self._fits(last[start - 1, rows], at)
                    rows, at = rows[fit], at[fit]
                token[rows] = at
            last[end - 1, : len(token)] = token
        out: list[list[int]] = [[]] * len(order)
        length, columns = self.tables.length, last.T.tolist()
        for i, row in zip(order, columns, strict=True):
            end, ids = len(pieces[i]), []
            while end:
                ids.append(row[end - 1])
                end -= length[ids[-1]]
            out[i] = ids[::-1]
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.tables, self.find = Tables(ranks), regex.compile(pattern).findall
        self.rows = Rows(self.tables)
        self._kept: dict[str, tuple[str, bytes]] = {}

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.tables.ranks.get(piece)  # a piece that is a token is that token
        return [whole] if whole is not None else Prefixes(self.tables, piece).tokens()

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Short pieces together, long ones each in a row of its own."""
        raw = [p.encode() for p in pieces]
        whole = self.tables.ranks.get
        many = [i for i, b in enumerate(raw) if len(b) <= CACHE_BYTES and whole(b) is None]
        short = dict(zip(many, self.rows.encode([raw[i] for i in many]), strict=True))
        return [short[i] if i in short else self.encode_piece(b) for i, b in enumerate(raw)]

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.encode_pieces(self.find(text)) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tables.bytes_of.__getitem__, ids))

    def written(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Of each text the ids as decimal numbers between single spaces, and the bytes that they decode to."""
        found = [self.find(t) for t in texts]
        new = list({p for ps in found for p in ps}.difference(self._kept))
        made = {p: (" ".join(map(str, ids)), self.decode(ids)) for p, ids in zip(new, self.encode_pieces(new), strict=True)}
        if len(self._kept) + len(made) <= CACHE:
            self._kept.update(made)
            made = self._kept
        else:
            made = made | {p: self._kept[p] for ps in found for p in set(ps) if p in self._kept}
        for ps in found:
            pairs = list(map(made.__getitem__, ps))
            yield " ".join([a for a, _ in pairs]), b"".join([b for _, b in pairs])


_encoders: dict[int, Encoder] = {}


def _encoder(key: int, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(ranks, pattern)
    return _encoders[key]


def encode_table(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """``keep`` columns with ``n_tokens`` and, as ``digests`` says, the ids and decoded bytes or their SHA-256.

    The ranks are read on the driver and broadcast; a vocabulary has a fixed size.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    key = hash((path, pattern))
    one = docs.select(*keep, F.col("text").alias("_text"))
    fields = [one.schema[c] for c in keep]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, ArrayType, IntegerType, LongType, StringType, StructField, StructType

    extra = (
        [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
        if digests
        else [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())]
    )
    schema = StructType([*fields, *extra])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(key, ranks.value, pattern)
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                texts = [t or "" for t in part.column("_text").to_pylist()]
                if digests:
                    both = list(enc.written(texts))
                    n = [ids.count(" ") + 1 if ids else 0 for ids, _ in both]
                    a = [hashlib.sha256(ids.encode()).hexdigest() for ids, _ in both]
                    b = [hashlib.sha256(back).hexdigest() for _, back in both]
                else:
                    a = [enc.encode(t) for t in texts]
                    n, b = [len(ids) for ids in a], [enc.decode(ids) for ids in a]
                cols = [part.column(c) for c in keep] + [pa.array(v, arrow.field(len(keep) + i).type) for i, v in enumerate((n, a, b))]
                yield pa.RecordBatch.from_arrays([c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(cols)], schema=arrow)

    return one.mapInArrow(run, schema)
