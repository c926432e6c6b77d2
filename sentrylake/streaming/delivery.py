"""Delivery of micro-batches to an output: retries with growing waits, dead letters, replay."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDELIVERABLE, REJECTED, QUEUE_FULL = "undeliverable", "rejected", "queue_full"
AUTOMATIC = (UNDELIVERABLE, QUEUE_FULL)
LONGEST_WAIT = 60.0


class Rejected(Exception):
    """The destination refused the events; sending them again as they are is no use."""


def deliver(batch: DataFrame, batch_id: int, send: Callable[[DataFrame, int], DataFrame | None], dead: Callable[[DataFrame], None], attempts: int = 6, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, key: str = "event_id") -> str:
    """Send a batch; what fails ``attempts`` times or is refused goes to ``dead`` with its kind and reason.

    ``send`` gets the batch's id, so that an output can drop a batch that it has seen: delivery is at least once. Where an output refuses
    some events only, ``send`` returns them (``key``, reason); those alone are dead letters.
    """
    wait = first_wait
    for attempt in range(1, attempts + 1):
        try:
            refused = send(batch, batch_id)
            if refused is None:
                return "delivered"
            why = refused.select(F.col(key), F.substring("reason", 1, 500).alias("reason")).dropDuplicates([key])
            dead(_about(batch.join(why, key), REJECTED, F.col("reason"), attempt, batch_id))
            return "partly_delivered"
        except Rejected as e:
            kind, reason = REJECTED, str(e)
            break
        except Exception as e:  # noqa: BLE001  any failure of a destination is retried, then kept
            kind, reason = UNDELIVERABLE, str(e)
            if attempt < attempts:
                sleep(min(wait, LONGEST_WAIT))
                wait *= 2
    dead(_about(batch, kind, F.lit(reason[:500]), attempt, batch_id))
    return "dead_lettered"


def _about(rows: DataFrame, kind: str, reason: Column, attempts: int, batch_id: int) -> DataFrame:
    return rows.withColumns({"kind": F.lit(kind), "reason": reason, "attempts": F.lit(attempts), "batch_id": F.lit(batch_id).cast("long")})


def replayable(dead: DataFrame, delivered: DataFrame, kinds: tuple[str, ...] = AUTOMATIC, key: str = "event_id") -> DataFrame:
    """Dead letters of these kinds whose events have not been delivered since, each once."""
    return dead.filter(F.col("kind").isin(*kinds)).join(delivered.select(key), key, "left_anti").dropDuplicates([key])
