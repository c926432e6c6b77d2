"""The connections of a stream that are open: kept by key in buckets, used once, forgotten after a time.

The state of a connection is what its teardown needs, the ends and the direction, so memory is bounded by the connections that were built
within the time to live. That time is the stream's own: a timer forgets a connection when the watermark is so far beyond it, so a replay gives
the same rows. The state is kept by the RocksDB store: use ``rocksdb`` around the start of the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrylake.operators.connections import BUILT, KEY
from sentrylake.session import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000
#: Groups of keys that share a state and a call of Python, so that both cost little for each key.
BUCKETS = 1024


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start within use the RocksDB store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class OpenConnections(StatefulProcessor):
    """Of the records of one bucket of keys, in the order of ``pos`` within a micro-batch, the teardowns with their direction.

    A bucket's open connections are one list, read and written once a micro-batch; its one timer is that of the connection that is forgotten first.
    """

    def __init__(self, columns: list[str], time: str, ttl_ms: int):
        self.columns, self.time, self.ttl_ms = columns, time, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "host string, connection string, ends string, direction string, until long")

    def _held(self) -> dict[tuple, tuple]:
        return {tuple(x[:2]): tuple(x[2:]) for x in self.open.get()}

    def _hold(self, held: dict[tuple, tuple]) -> int | None:
        """Stores what is open; returns when the first of it is forgotten."""
        if held:
            self.open.put([(*key, *x) for key, x in held.items()])
        else:
            self.open.clear()
        return min((x[2] for x in held.values()), default=None)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        import pandas as pd

        held, changed = self._held(), False
        timer = min((x[2] for x in held.values()), default=None)
        rows = pd.concat(list(rows)).sort_values(["pos", "verb"], kind="stable")
        until = rows[self.time].to_numpy("datetime64[ms]").astype("int64") + self.ttl_ms
        keys = zip(*(rows[c] for c in KEY), strict=True)
        ways = rows["direction"].astype(object).where(rows["direction"].notna(), None)
        down = (rows["verb"] != BUILT).to_numpy()
        out = []
        for name, ends, way, ended, last in zip(keys, rows["ends"], ways, down, until.tolist(), strict=True):
            if not ended:
                held[name], changed = (ends, way, last), True
                continue
            found = held.get(name)
            takes = found is not None and found[0] == ends
            out.append(found[1] if takes else None)
            if takes:
                del held[name]
                changed = True
        if changed:
            self._at(timer, self._hold(held))
        yield rows[down].assign(direction=pd.Series(out, dtype=object, index=rows.index[down]) if out else None)[self.columns]

    def _at(self, before: int | None, after: int | None) -> None:
        if before == after:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if after is not None:
            self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        import pandas as pd

        now = timerValues.getCurrentWatermarkInMs()
        after = self._hold({k: x for k, x in self._held().items() if x[2] > now})
        if after is not None:
            self.handle.registerTimer(after)
        yield pd.DataFrame([], columns=self.columns)

    def close(self) -> None:
        pass


def directed_stream(rows: DataFrame, time: str = "time", late: str = "1 minute", ttl_ms: int = HOUR, buckets: int = BUCKETS) -> DataFrame:
    """The teardowns of streamed records, which have the event time ``time``, with the direction that they take.

    A connection that was built more than ``ttl_ms`` before the watermark lends no direction. ``buckets`` are part of the checkpoint: a
    stream that starts again must have as many.
    """
    ship(rows.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    keyed = rows.withWatermark(time, late).withColumn("_bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets))).groupBy("_bucket")
    return keyed.transformWithStateInPandas(OpenConnections(rows.columns, time, ttl_ms), schema, "append", "eventTime")
