"""Events that an output did not take: kept in segments on the shared file system, claimed by rename, sent again in waves.

``waiting/<segment>/wave=<n>`` holds what waits; a replay renames a segment to ``claimed/<segment>``, so new dead letters never meet a running
replay. A wave, some rows of every partition, is sent as one DataFrame under a key of its own. What it did not deliver is written as a
new segment named after the wave, then the wave is marked as settled: a crash between any two steps repeats at most the sending of
the waves under way (one, or ``at_once``), under the same keys, and no row is lost or kept twice. A segment whose waves are all settled leaves only its name in ``settled``, so
an append that comes again is known. One replay runs at a time, by a lease that a crashed one lets expire.
"""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .delivery import AUTOMATIC, REJECTED

KINDS = (*AUTOMATIC, REJECTED)
WAVE = 10_000
LEASE = 600.0
#: What every entry has beside the event's own columns.
ABOUT = ("kind", "reason", "attempts", "at")


class DeadLetters:
    def __init__(self, spark: SparkSession, path: str, wave: int = WAVE, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.wave, self.clock = spark, path.rstrip("/"), wave, clock
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._lock = Lock()

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *[p for p in parts if p]]))

    def _names(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _rename(self, old: tuple[str, ...], new: tuple[str, ...]) -> bool:
        self._fs.mkdirs(self._path(*new[:-1]))
        return bool(self._fs.rename(self._path(*old), self._path(*new)))

    def _touch(self, *parts: str) -> None:
        self._fs.mkdirs(self._path(*parts[:-1]))
        self._fs.create(self._path(*parts), True).close()

    def _waves(self, state: str, segment: str) -> list[int]:
        """Waves of a segment that are not settled, in order."""
        settled = set(self._names("marks", segment))
        return sorted(w for n in self._names(state, segment) if n.startswith("wave=") and str(w := int(n[5:])) not in settled)

    # keeping

    def _known(self, name: str) -> bool:
        return any(self._fs.exists(self._path(state, name)) for state in ("waiting", "claimed", "settled"))

    def append(self, entries: DataFrame, segment: str | None = None, counted: Observation | None = None) -> bool:
        """Keep entries: an event's columns with ABOUT. ``segment`` names them, so that the same append again, as after a failed
        micro-batch, does nothing; False then. ``counted`` observes the number n of entries that are known to be one wave at most."""
        name = segment or uuid.uuid4().hex
        if self._known(name):
            return False
        if counted is not None:
            entries.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/new/{name}/wave=0")
            return bool(counted.get["n"]) and self._rename(("new", name), ("waiting", name))
        each = -(-self.wave // max(1, entries.rdd.getNumPartitions()))
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        rows = entries.withColumn("wave", F.floor(place / each).cast("int"))
        rows.repartition("wave").write.mode("overwrite").partitionBy("wave").parquet(f"{self.root}/new/{name}")
        return self._rename(("new", name), ("waiting", name))

    def entries(self) -> DataFrame | None:
        """All that waits or is claimed and not settled; None where nothing is."""
        found = [f"{self.root}/{state}/{s}/wave={w}" for state in ("waiting", "claimed") for s in self._names(state) for w in self._waves(state, s)]
        return self.spark.read.option("mergeSchema", "true").parquet(*found) if found else None

    def summary(self) -> DataFrame | None:
        """(kind, waiting, oldest, newest, reason): per kind, with its commonest reason."""
        rows = self.entries()
        if rows is None:
            return None
        by_reason = rows.groupBy("kind", "reason").agg(F.count("*").alias("n"), F.min("at").alias("oldest"), F.max("at").alias("newest"))
        most = F.max_by("reason", F.struct("n", "reason"))
        return by_reason.groupBy("kind").agg(F.sum("n").alias("waiting"), F.min("oldest").alias("oldest"), F.max("newest").alias("newest"), most.alias("reason"))

    # sending again

    def _lease(self) -> bool:
        """Take or keep the right to replay."""
        at, now = self._path("lease"), int(self.clock() * 1000)
        if self._fs.exists(at):
            if now - self._fs.getFileStatus(at).getModificationTime() < LEASE * 1000:
                return False
            self._fs.delete(at, False)  # of a replay that is gone
        self._fs.mkdirs(self._path(""))
        try:
            self._fs.create(at, False).close()
        except Exception:  # noqa: BLE001  another replay was faster
            return False
        self._keep()
        return True

    def _keep(self) -> None:
        self._fs.setTimes(self._path("lease"), int(self.clock() * 1000), -1)

    def replay(self, send: Callable[[DataFrame, str], DataFrame | None], key: str, kinds: tuple[str, ...] = AUTOMATIC, limit: int | None = None, stop: Callable[[], bool] = lambda: False, at_once: int = 1) -> dict:
        """Send waiting entries of ``kinds``: first those of a replay that was cut off, then what waits now.

        ``send(rows, wave)`` returns the rows (``key``, reason) that were refused, or None; if it raises, the destination takes nothing and
        the wave stays. Refused entries and those of other kinds wait on. ``limit`` is met at the end of a wave. Up to ``at_once`` waves of a
        segment are under way together, where the destination takes calls of several threads and there is no ``limit``.
        """
        said = {"state": "done", "delivered": 0, "refused": 0, "skipped": 0, "error": None}
        if not self._lease():
            return said | {"state": "busy"}
        try:
            for segment in [*self._names("claimed"), *self._names("waiting")]:
                if segment not in self._names("claimed") and not self._rename(("waiting", segment), ("claimed", segment)):
                    continue
                waves = self._waves("claimed", segment)
                if not waves:
                    self._finish(segment)
                    continue
                due = F.coalesce(F.col("kind").isin(*kinds), F.lit(False))
                shape = self.spark.read.parquet(f"{self.root}/claimed/{segment}/wave={waves[0]}").schema  # waves of a segment were written together
                counts = self._counts(segment, shape, due)

                def one(w: int) -> str | None:
                    self._keep()
                    rows = self.spark.read.schema(shape).parquet(f"{self.root}/claimed/{segment}/wave={w}")  # noqa: B023
                    n, skipped = counts.get(w, (0, 0))  # noqa: B023
                    try:
                        refused = send(rows.filter(due), f"{segment}-{w}") if n else None  # noqa: B023
                    except Exception as e:  # noqa: BLE001  whatever a destination raises, the wave is tried another time
                        return f"{type(e).__name__}: {e}"[:500]
                    total = self._settle(segment, w, rows, due, refused, key, skipped)  # noqa: B023
                    with self._lock:
                        said["skipped"] += skipped
                        said["refused"] += total - skipped
                        said["delivered"] += n - (total - skipped)
                    return None

                def over() -> str | None:
                    return "stopped" if stop() else "limit reached" if limit is not None and said["delivered"] >= limit else None

                state, error = self._each(waves, one, over, 1 if limit is not None else at_once)
                if state:
                    return said | {"state": state, "error": error}
                self._finish(segment)
        finally:
            self._fs.delete(self._path("lease"), False)
        return said

    def _counts(self, segment: str, shape: StructType, due: Column) -> dict[int, tuple[int, int]]:
        """Of every wave of a claimed segment, how many entries are due and how many are not, in one job."""
        rows = self.spark.read.schema(StructType([*shape.fields, StructField("wave", IntegerType())])).parquet(f"{self.root}/claimed/{segment}")
        return {r[0]: (r[1], r[2] - r[1]) for r in rows.groupBy("wave").agg(F.count_if(due), F.count("*")).collect()}

    def _each(self, waves: list[int], one: Callable[[int], str | None], over: Callable[[], str | None], at_once: int) -> tuple[str | None, str | None]:
        """``one`` of every wave until one fails or it is ``over``; what is under way then ends first. Why it stopped, and the error."""
        if at_once <= 1:
            for w in waves:
                if state := over():
                    return state, None
                if error := one(w):
                    return "stopped", error
            return None, None
        under_way, state, errors = deque(), None, []
        with ThreadPoolExecutor(at_once) as pool:
            for w in waves:
                if len(under_way) >= at_once and (error := under_way.popleft().result()):
                    errors.append(error)
                state = "stopped" if errors else over()
                if state:
                    break
                under_way.append(pool.submit(one, w))
            errors += [e for e in [f.result() for f in under_way] if e]
        return ("stopped" if errors else state), (errors[0] if errors else None)

    def _settle(self, segment: str, wave: int, rows: DataFrame, due: Column, refused: DataFrame | None, key: str, skipped: int) -> int:
        """Keeps what a wave did not deliver and marks it; the number kept. A wave is small, so this is one task without a shuffle."""
        name, total = f"{segment}-{wave}", 0
        kept = rows.filter(~due)
        if refused is not None:
            why = refused.select(F.col(key), F.substring("reason", 1, 500).alias("_why")).coalesce(1).dropDuplicates([key])
            again = rows.filter(due).coalesce(1).join(why.hint("shuffle_hash"), key).withColumns({"kind": F.lit(REJECTED), "reason": F.col("_why"), "attempts": F.col("attempts") + 1}).drop("_why")
            kept = kept.unionByName(again)
        kept = kept.select(*rows.columns)
        if self._known(name):  # by a replay that was cut off behind it
            total = kept.count()
        elif skipped or refused is not None:
            seen = Observation()  # counted as it is written
            self.append(kept.observe(seen, F.count("*").alias("n")), name, seen)
            total = seen.get["n"]
        self._touch("marks", segment, str(wave))
        return total

    def _finish(self, segment: str) -> None:
        self._touch("settled", segment)
        self._fs.delete(self._path("claimed", segment), True)
        self._fs.delete(self._path("marks", segment), True)
