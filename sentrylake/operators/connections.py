"""Direction of firewall connections whose end is logged without it.

A device writes both ends of a connection, the outer one first, when it builds the connection and when it tears it down, but only the first
line says who opened it. A teardown takes the direction of the last connection built before it under the same key of the same host,
if the ends are the same and no earlier teardown has taken it. ``directed`` does so over a table, ``streaming.connections`` over a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import text as tx

BUILT, TEARDOWN = "built", "teardown"
#: What identifies a connection, and what the direction is found from.
KEY = ("host", "connection")
RECORD = (*KEY, "pos", "verb", "ends", "direction")


def told(event: Column) -> Column:
    """Whether a parsed event, as a struct, is the begin or the end of a connection."""
    return event["connection_verb"].isNotNull() & event["connection_ends"].isNotNull()


def records(events: DataFrame, pos: str, *keep: str) -> DataFrame:
    """The built and torn down connections among parsed events: RECORD and ``keep``. ``pos`` orders the lines of a host.

    Connections are known by their number, or, as those of ICMP often have none, by their ends.
    """
    found = events.filter(F.col("connection_verb").isNotNull() & F.col("connection_ends").isNotNull())
    key = F.coalesce(F.concat(F.lit("#"), "connection_id"), F.col("connection_ends"))
    host = F.coalesce("device_hostname", F.lit(""))
    return found.select(
        host.alias("host"), key.alias("connection"), F.col(pos).alias("pos"), F.col("connection_verb").alias("verb"), F.col("connection_ends").alias("ends"),
        F.when(F.col("connection_verb") == BUILT, F.col("direction")).alias("direction"), *keep,
    )


def directed(rows: DataFrame) -> DataFrame:
    """The teardowns of ``rows`` with the ``direction`` that they take, null where there is none.

    The history of one key on one host is one partition of a window; what a host's numbers see in their time is small.
    """
    order = Window.partitionBy(*KEY).orderBy("pos", "verb")
    built = F.last(F.when(F.col("verb") == BUILT, F.struct("pos", "ends", "direction")), ignorenulls=True)
    down = rows.withColumn("_built", built.over(order)).filter(F.col("verb") == TEARDOWN)
    fits = F.coalesce(F.col("_built.ends") == F.col("ends"), F.lit(False))
    turn = F.row_number().over(Window.partitionBy(*KEY, "_built.pos", "_fits").orderBy("pos"))
    down = down.withColumn("_fits", fits).withColumn("_turn", turn)
    return down.withColumn("direction", F.when(F.col("_fits") & (F.col("_turn") == 1), F.col("_built.direction"))).drop("_built", "_fits", "_turn")


def sides(ends: Column, direction: Column) -> Column:
    """Source and destination of ends ``outer/port inner/port``; without a direction both are null. A name that stands for an address is a
    host name."""
    end = lambda i: F.when(direction.isin("inbound", "outbound"), F.get(F.split(ends, " "), F.when(direction == "inbound", i).otherwise(1 - i)))

    def parts(side: str, x: Column) -> list[Column]:
        name = F.get(F.split(x, "/"), F.lit(0))
        port = F.get(F.split(x, "/"), F.lit(1))
        return [tx.as_ip(name).alias(f"{side}_ip"), F.when(tx.as_ip(name).isNull(), name).alias(f"{side}_hostname"), F.when(tx.as_port(port).isNotNull(), port).try_cast("int").alias(f"{side}_port")]

    return F.struct(*parts("src", end(0)), *parts("dst", end(1)))
