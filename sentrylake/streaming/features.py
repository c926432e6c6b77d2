"""All window features of a stream, as the table has them.

A watermarked window sums what a window says on its own and gathers its distinct names; it is given out once, when the watermark has passed its
end. What needs the windows before it, the destinations that an entity had not met and the number of its windows, is the state of a second
operator, by entity. Closed windows of an entity come in order, so the state only grows by new destinations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sentrylake.operators.features import WINDOW_MS, denied, entity
from sentrylake.session import ship

#: What a window says on its own, in the order of the columns.
SUMS = (
    "events long", "denied long", "auth_failures long", "auth_successes long", "findings long", "unverified long", "received long", "bytes_in long", "bytes_out long", "first_sequence long",
    "last_sequence long", "distinct_src_ips long", "distinct_dst_ips long", "distinct_dst_ports long",
)


def closed_windows(events: DataFrame, kind: str = "src_ip", width: int = WINDOW_MS, late: str = "30 seconds") -> DataFrame:
    """(entity, window_start_ms, SUMS, dsts) of windows of streamed events whose end the watermark has passed."""
    auth = F.col("class_uid") == 3002
    dst = F.coalesce("dst_ip", "dst_hostname")
    rows = events.select("*", entity(kind).alias("entity"), dst.alias("dst"), F.timestamp_millis("time").alias("_at")).filter("entity IS NOT NULL")
    count = lambda c, name: F.count_if(c).alias(name)
    windows = rows.withWatermark("_at", late).groupBy(F.window("_at", f"{width} milliseconds").alias("_w"), "entity").agg(
        F.count("*").alias("events"), count(denied(), "denied"), count(auth & (F.col("status_id") == 2), "auth_failures"), count(auth & (F.col("status_id") == 1), "auth_successes"),
        count(F.col("class_uid") == 2004, "findings"), count(~F.coalesce("fields_verified", F.lit(False)), "unverified"), count(F.col("time_source") == "received", "received"),
        F.sum("bytes_in").cast("long").alias("bytes_in"), F.sum("bytes_out").cast("long").alias("bytes_out"), F.min("sequence_num").cast("long").alias("first_sequence"),
        F.max("sequence_num").cast("long").alias("last_sequence"), F.size(F.collect_set("src_ip")).cast("long").alias("distinct_src_ips"),
        F.collect_set("dst").alias("dsts"), F.size(F.collect_set("dst_port")).cast("long").alias("distinct_dst_ports"),
    )
    out = windows.withColumns({"window_start_ms": F.unix_millis("_w.start"), "distinct_dst_ips": F.size("dsts").cast("long")})
    return out.select("entity", "window_start_ms", *[c.split()[0] for c in SUMS], "dsts")


class Met(StatefulProcessor):
    """Of closed windows of one entity, in their order, the destinations that are new to it and the number of its windows before."""

    columns = ("entity", "window_start_ms", *[c.split()[0] for c in SUMS], "new_dst_ips", "history_windows")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getMapState("met", "dst string", "window_start_ms long")
        self.windows = handle.getValueState("windows", "n long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        import pandas as pd

        n = self.windows.get()[0] if self.windows.exists() else 0
        out = []
        for row in pd.concat(list(rows)).sort_values("window_start_ms").to_dict("records"):
            new = 0
            for dst in row.pop("dsts"):
                if not self.met.containsKey((dst,)):
                    self.met.updateValue((dst,), (row["window_start_ms"],))
                    new += 1
            out.append({**row, "new_dst_ips": new, "history_windows": n})
            n += 1
        self.windows.update((n,))
        made = pd.DataFrame(out, columns=list(self.columns))
        yield made.astype({c: "Int64" for c in self.columns if c != "entity"})

    def close(self) -> None:
        pass


def feature_stream(events: DataFrame, kind: str = "src_ip", width: int = WINDOW_MS, late: str = "30 seconds") -> DataFrame:
    """The columns of ``features.window_features`` for every closed window. Start the query within ``connections.rocksdb``."""
    ship(events.sparkSession)
    schema = f"entity string, window_start_ms long, {', '.join(SUMS)}, new_dst_ips long, history_windows long"
    rows = closed_windows(events, kind, width, late).groupBy("entity").transformWithStateInPandas(Met(), schema, "append", "none")
    at = F.timestamp_millis("window_start_ms")
    return rows.select(
        F.lit(kind).alias("entity_type"), *[c for c in Met.columns if c != "history_windows"],
        (F.col("denied") / F.col("events")).alias("deny_ratio"), F.when(F.col("distinct_dst_ips") > 0, F.col("new_dst_ips") / F.col("distinct_dst_ips")).alias("new_dst_share"),
        F.hour(at).cast("long").alias("hour_of_day"), F.weekday(at).cast("long").alias("day_of_week"), "history_windows",
    )
