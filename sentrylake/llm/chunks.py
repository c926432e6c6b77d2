"""Chunks of texts that ask buckets of hashes, and get answers in the order of what they asked.

Texts are written once, neighbouring rows in chunks of some megabytes. What a task reads of a chunk in one piece sends its
distinct keys, sorted, as one packed row to each bucket, and the bucket answers with one packed row whose values stand in the same
order. So keys travel once and never come back, and there is one row for each piece and bucket instead of one for each key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import signed, slices


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """The rows with ``_chunk``, which neighbouring rows of about ``size`` bytes of text share, ``_row``, their order, and ``_bytes``."""
    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held = row = 0
        for batch in batches:
            for part in slices(batch, limit=size):
                now = part.column("text").nbytes
                if held and held + now > size:
                    chunk, held = chunk + 1, 0
                held += now
                n = part.num_rows
                more = [np.full(n, chunk), np.arange(row, row + n), np.full(n, now // n)]
                row += n
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, more)], names=[*part.schema.names, "_chunk", "_row", "_bytes"])

    return docs.mapInArrow(run, f"{fields}, _chunk long, _row long, _bytes long")


def bucket_count(chunks: DataFrame, size: int) -> int:
    """So many buckets that one meets the keys of about ``size`` bytes of text."""
    return max(1, -(-chunks.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0] // size))


def bucket_edges(buckets: int) -> np.ndarray:
    """Where each bucket but the first begins in the range of hashes."""
    return np.array([-(-(i << 64) // buckets) for i in range(1, buckets)], np.uint64)


def deal(keys: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each bucket that has some of the sorted keys, and which."""
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if b > a:
            yield i, slice(a, b)


def whole(column: pa.ChunkedArray) -> pa.Array:
    """One array of a column."""
    made = column.combine_chunks()
    return made if isinstance(made, pa.Array) else pa.concat_arrays(made.chunks)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a chunk that a task reads one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        number = batch.column("_chunk").to_numpy()
        cuts = np.flatnonzero(number[1:] != number[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True):
            if a == b:
                continue
            if held and held[0].column("_chunk")[0].as_py() != number[a]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def answered(chunks: DataFrame, answers: DataFrame, fields: str, f: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """f(answers, rows) of every piece, as a table of ``fields``. Each piece has an answer (column ``piece``, its first _row)."""

    def run(found: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row")
        row, of = rows.column("_row").to_numpy(), found.column("piece").to_numpy()
        first = np.unique(of)
        cuts = [*np.searchsorted(row, first).tolist(), len(row)]
        return pa.concat_tables([f(found.filter(pa.array(of == p)), rows.slice(a, b - a)) for p, a, b in zip(first.tolist(), cuts[:-1], cuts[1:], strict=True)])

    return answers.groupBy("_chunk").cogroup(chunks.drop("_bytes").groupBy("_chunk")).applyInArrow(run, fields)


def _narrow(v: np.ndarray) -> bytes:
    """A byte that says how wide a number is, the numbers' lower bytes, and their uppermost ones, which differ little, coded."""
    width = max(1, (int(v.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(v.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + planes[:-1].tobytes() + zlib.compress(planes[-1], 1)


def _wide(data: bytes, n: int) -> np.ndarray:
    width, low = data[0], 1 + (data[0] - 1) * n
    out = np.zeros((n, 8), np.uint8)
    out[:, : width - 1] = np.frombuffer(data, np.uint8, low - 1, 1).reshape(width - 1, n).T
    out[:, width - 1] = np.frombuffer(zlib.decompress(data[low:]), np.uint8)
    return out.view(np.uint64).ravel()


def pack_keys(k: np.ndarray) -> bytes:
    """Sorted hashes: the first one, and gaps of as many bytes as the largest needs."""
    return k[:1].tobytes() + (_narrow(np.diff(k)) if len(k) > 1 else b"")


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    if n < 2:
        return np.frombuffer(data, np.uint64, n)
    return np.cumsum(np.r_[np.frombuffer(data, np.uint64, 1), _wide(data[8:], n - 1)], dtype=np.uint64)


def pack_numbers(v: np.ndarray) -> bytes:
    """Whole numbers: the smallest, and the others above it in as many bytes as needed."""
    low = v.min(initial=np.iinfo(np.int64).max)
    return int(low).to_bytes(8, "little", signed=True) + (_narrow(v.astype(np.int64).view(np.uint64) - np.uint64(int(low) & (1 << 64) - 1)) if len(v) else b"")


def unpack_numbers(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    low = np.frombuffer(data, np.uint64, 1)
    return signed(_wide(data[8:], n) + low)


def pack_counts(c: np.ndarray) -> bytes:
    """A byte for each count, and the counts from 255 on in full after them."""
    return zlib.compress(np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype(np.int64).tobytes(), 1)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    c = np.frombuffer(data, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(data, np.int64, offset=n)
    return c


def batch(rows: list[tuple], names: str, kinds: str) -> pa.RecordBatch:
    """A batch of rows; ``kinds`` has a letter for each column: l long, b binary."""
    of = {"l": pa.int64(), "b": pa.binary()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(v, of[k]) for v, k in zip(columns, kinds, strict=True)], names=names.split())
