"""Spark data source ``tail``: the complete lines of growing files, as a batch or as a stream that resumes at its offsets.

``register(spark)`` once a session, then ``spark.readStream.format("tail").option("path", "/logs/*.log").load()`` gives
(path, pos, raw, n_bytes): the file, the byte at which a line begins, its bytes with the LF or CRLF, and its whole length.

* A line counts once its LF is there; blank lines are left out, but not those that are cut. Bytes of a line beyond ``maxLineBytes`` are cut off, ``n_bytes`` tells.
* The offset of a stream holds the inode and the end of the last complete line of each file, so it lives in Spark's checkpoint. A path
  with another inode, or a file shorter than its offset, is read from its first byte. The pattern should not match rotated names.
* ``startAt`` is ``begin`` or ``end``; with ``end`` a path that is met for the first time is followed from its end.
* A file is cut into tasks of ``chunkBytes``; the driver reads no more of it than it takes to find the last LF.
* A batch whose file was rotated away before its task read it looks for the inode in the same folder, and fails where it is gone;
  ``failOnDataLoss=false`` gives no lines instead.

Paths are those of a file system that driver and executors mount. For object stores Spark's own text source is the one to use.
"""

from __future__ import annotations

import glob
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, pos long, raw binary, n_bytes long"
_ARROW = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("raw", pa.binary()), ("n_bytes", pa.int64())])
_BLOCK, _BATCH = 1 << 16, 1 << 22

#: File -> [inode, end of the last complete line].
Ends = dict[str, list[int]]


@dataclass
class Piece(InputPartition):
    """Lines of a file that begin within [start, stop); ``first`` tells that a line begins at ``start``, ``end`` is where the last one ends."""

    path: str
    inode: int
    start: int
    stop: int
    first: bool
    end: int


def last_line_end(file, size: int, floor: int = 0) -> int:
    """Where the last complete line ends, read backwards from ``size``; ``floor`` if no LF follows it."""
    at = size
    while at > floor:
        low = max(floor, at - _BLOCK)
        file.seek(low)
        hit = file.read(at - low).rfind(b"\n")
        if hit >= 0:
            return low + hit + 1
        at = low
    return floor


def pieces(path: str, inode: int, start: int, end: int, chunk: int) -> list[Piece]:
    return [Piece(path, inode, at, min(at + chunk, end), at == start, end) for at in range(start, end, chunk)]


class _Tail:
    """What the batch and the stream reader share: options, listing, and the lines of a piece."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("tail: the option path is missing")
        self.patterns = [p.removeprefix("file://") for p in options["path"].split(",")]
        remote = [p for p in self.patterns if "://" in p]
        if remote:
            raise ValueError(f"tail: {remote[0]} is not on a mounted file system; read it with Spark's text source")
        self.start_at = options.get("startat", "begin")
        if self.start_at not in ("begin", "end"):
            raise ValueError(f"tail: startAt is begin or end, not {self.start_at}")
        self.chunk, self.limit = int(options.get("chunkbytes", 1 << 23)), int(options.get("maxlinebytes", 1 << 23))
        if self.chunk < 1 or self.limit < 1:
            raise ValueError("tail: chunkBytes and maxLineBytes are at least 1")
        self.lossy = options.get("failondataloss", "true").lower() == "false"

    def ends(self, known: Ends) -> Ends:
        """The files there are, each with the end of its last complete line; paths in ``known`` that are gone for now stay."""
        out = dict(known)
        for path in sorted({p for pattern in self.patterns for p in glob.glob(pattern, recursive=True)}):
            try:
                with open(path, "rb") as file:
                    found = os.fstat(file.fileno())
                    inode, was = known.get(path, (None, 0))
                    floor = was if inode == found.st_ino and found.st_size >= was else 0
                    out[path] = [found.st_ino, last_line_end(file, found.st_size, floor)]
            except (FileNotFoundError, IsADirectoryError):
                continue
        return out

    def _open(self, piece: Piece):
        try:
            file = open(piece.path, "rb")
            if os.fstat(file.fileno()).st_ino == piece.inode:
                return file
            file.close()
        except FileNotFoundError:
            pass
        folder = os.path.dirname(piece.path) or "."
        if os.path.isdir(folder):
            for entry in os.scandir(folder):
                if entry.inode() == piece.inode and entry.is_file():
                    return open(entry.path, "rb")
        if self.lossy:
            return None
        raise FileNotFoundError(f"tail: {piece.path} was rotated away before bytes {piece.start} to {piece.stop} were read")

    def lines(self, piece: Piece) -> Iterator[tuple[int, bytes, int]]:
        file = self._open(piece)
        if file is None:
            return
        with file:
            at = piece.start
            if not piece.first:
                file.seek(at - 1)
                at -= 1
                while at < piece.stop:
                    part = file.readline(min(_BLOCK, piece.stop - at))
                    at += len(part)
                    if part.endswith(b"\n") or not part:
                        break
                else:
                    return
            file.seek(at)
            while at < piece.stop:
                raw = file.readline(self.limit)
                size = len(raw)
                part = raw
                while part and not part.endswith(b"\n"):
                    part = file.readline(_BLOCK)
                    size += len(part)
                if not raw or at + size > piece.end:
                    if self.lossy:
                        return
                    raise EOFError(f"tail: {piece.path} was cut short while bytes {piece.start} to {piece.stop} were read")
                if raw.strip() or size > len(raw):
                    yield at, raw, size
                at += size

    def batches(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for pos, raw, size in self.lines(piece):
            rows.append({"path": piece.path, "pos": pos, "raw": raw, "n_bytes": size})
            held += len(raw)
            if held >= _BATCH or len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class TailReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tail = _Tail(options)

    def partitions(self) -> list[Piece]:
        return [p for path, (inode, end) in self.tail.ends({}).items() for p in pieces(path, inode, 0, end, self.tail.chunk)] or [Piece("", 0, 0, 0, True, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.tail.batches(partition) if partition.path else iter(())


class TailStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.tail = _Tail(options)
        self.known: Ends = {}

    def initialOffset(self) -> dict:
        return {"files": self.tail.ends({}) if self.tail.start_at == "end" else {}}

    def latestOffset(self) -> dict:
        self.known = self.tail.ends(self.known)
        return {"files": self.known}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, (inode, stop) in end["files"].items():
            was = start["files"].get(path)
            if was is None:
                at = stop if self.tail.start_at == "end" else 0
            else:
                at = was[1] if was[0] == inode and was[1] <= stop else 0
            out += pieces(path, inode, at, stop, self.tail.chunk)
        return out or [Piece("", 0, 0, 0, True, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.tail.batches(partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        """Nothing to release: what is read stays in its files."""


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema) -> TailStreamReader:
        return TailStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Make ``format("tail")`` known to a session. This module travels with the source, since the process in which Spark lists the files of a
    stream imports no package that was sent to the executors."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(TailSource)
