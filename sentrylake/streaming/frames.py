"""Frames of connections whose bytes come in pieces, batch by batch: what is not whole yet is the connection's state."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrylake.session import ship
from sentrylake.sources.frames import LIMIT, Frames

if TYPE_CHECKING:
    import pyarrow as pa

SCHEMA = "connection {}, pos long, n int, frame binary"
#: So many rows or bytes are given out at once, and so many bytes of pieces are sorted in memory.
ROWS, BYTES = 10_000, 8 << 20
SORTED = 64 << 20


def ordered(batches: Iterable[pa.RecordBatch], by: str, most: int = SORTED) -> Iterator[tuple]:
    """The rows of batches by ``by``, equal ones as they came. Beyond ``most`` bytes they are sorted runs in files of the task's temporary folder, merged
    as they are read, so that memory holds ``most`` bytes and a batch of each run."""
    import pyarrow as pa

    waiting, size, runs = [], 0, []

    def run() -> pa.Table:
        table = pa.Table.from_batches(waiting)
        places = pa.array(range(len(table)), pa.int64())
        order = pa.table({"by": table[by], "place": places}).sort_by([("by", "ascending"), ("place", "ascending")])
        return table.take(order["place"])

    def rows(found: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in found:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    def read(file) -> Iterator[tuple]:
        file.seek(0)
        with pa.ipc.open_stream(file) as stream:
            yield from rows(stream)

    with tempfile.TemporaryDirectory() as at:
        for batch in batches:
            waiting.append(batch)
            size += batch.nbytes
            if size >= most:
                file = tempfile.TemporaryFile(dir=at)  # noqa: SIM115  it is read below
                with pa.ipc.new_stream(file, batch.schema) as out:
                    out.write_table(run(), max_chunksize=1000)
                runs.append(file)
                waiting, size = [], 0
        last = rows(run().to_batches(1000)) if waiting else iter(())
        if not runs:
            yield from last
            return
        place = batch.schema.names.index(by)
        yield from heapq.merge(*map(read, runs), last, key=lambda row: row[place])
        for file in runs:
            file.close()


class OpenFrames(StatefulProcessor):
    """(connection, pos, n, payload, closed) in the order of ``pos``; frame n that a piece completes has the piece's pos. The pieces of a
    connection in a micro-batch are sorted on disk where they are many."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", "rest binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        import pyarrow as pa

        piece = pa.schema([("pos", pa.int64()), ("payload", pa.binary()), ("closed", pa.bool_())])
        frames = Frames(bytes(self.waiting.get()[0]) if self.waiting.exists() else b"", self.limit)
        out, held = [], 0
        for pos, payload, closed in ordered((pa.RecordBatch.from_pandas(x[["pos", "payload", "closed"]], piece, preserve_index=False) for x in rows), "pos"):
            found = frames.feed(payload) if payload is not None else []
            if closed:
                found += frames.flush()
            out += [(key[0], pos, n, f) for n, f in enumerate(found)]
            held += sum(map(len, found))
            if len(out) >= ROWS or held >= BYTES:
                yield self._made(out)
                out, held = [], 0
        if frames.rest:
            self.waiting.update((frames.rest,))
        elif self.waiting.exists():
            self.waiting.clear()
        yield self._made(out)

    @staticmethod
    def _made(out: list[tuple]):
        import pandas as pd

        return pd.DataFrame(out, columns=["connection", "pos", "n", "frame"])

    def close(self) -> None:
        pass


def frame_stream(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Frames of streamed pieces (connection, pos, payload binary, closed). A connection's state is less than ``limit`` bytes and a count.

    Pieces of a connection must come in its order from batch to batch. Start the query within ``connections.rocksdb``.
    """
    ship(pieces.sparkSession)
    kind = dict(pieces.dtypes)["connection"]
    rows = pieces.select("connection", "pos", "payload", "closed").groupBy("connection")
    return rows.transformWithStateInPandas(OpenFrames(limit), SCHEMA.format(kind), "append", "none")
