"""Tables in the folder that driver and executors share, and shipping of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors when PYTHONPATH does not already do so."""
    if str(_ROOT) in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = _ROOT / __name__.split(".")[0]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session (tests) may do without: a temporary folder of this machine
    is no shared one on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Shared:
    """Tables written to the shared folder, so that lineage ends there and a lost executor loses nothing.

    ``save`` writes a DataFrame and returns a fresh read of it; ``save_sorted`` does so bucketed and sorted by keys; ``drop`` deletes
    tables that no result needs. What results need stays until the folder of the session is deleted.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        self._tables: dict[int, str] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    @contextmanager
    def _cleaned(self) -> Iterator[None]:
        """The lineage ends with this write, so what it shuffles may go when it is done."""
        before = self.spark.conf.get(_CLEAN, None)
        if before is None:
            yield
            return
        self.spark.conf.set(_CLEAN, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_CLEAN, before)

    def save(self, df: DataFrame, name: str, *partitions: str) -> DataFrame:
        path = self.path(name)
        with self._cleaned():
            df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def save_sorted(self, df: DataFrame, name: str, *keys: str, dealt: bool = False) -> DataFrame:
        """One file for each bucket of the keys' hashes, so that joins by the keys need no exchange. ``dealt``: a join of such tables.

        Not for unions: Spark 4.1 takes a union of bucketed scans for dealt by the keys also where it reads them otherwise,
        and sums over it are wrong. ``plain`` is the table for those.
        """
        path, table = self.path(name), f"shared_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = (df if dealt else df.repartition(n, *keys)).sortWithinPartitions(*keys)
        with self._cleaned():
            rows.write.option("compression", "zstd").option("path", path).bucketBy(n, *keys).sortBy(*keys).saveAsTable(table)
        out = self.spark.table(table)
        self._paths[id(out)], self._tables[id(out)] = path, table
        return out

    def plain(self, table: DataFrame) -> DataFrame:
        return self.spark.read.schema(table.schema).parquet(self._paths[id(table)])

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if table := self._tables.pop(id(t), None):
                self.spark.sql(f"DROP TABLE {table}")
            if path := self._paths.pop(id(t), None):
                self.delete(path)

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def units(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key as one table; rows of a key stand together."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([np.asarray(batch.column(c)) for c in keys])
        cuts = np.flatnonzero((now[:, 1:] != now[:, :-1]).any(0)) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
            if key is not None and key != tuple(now[:, a]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = tuple(now[:, a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
