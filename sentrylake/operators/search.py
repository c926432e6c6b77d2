"""Filters, paging and search over stored events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(events: DataFrame) -> DataFrame:
    return events.filter(F.col("superseded_by").isNull())


def explore(events: DataFrame, source_id: int | None = None, severity: str | None = None, class_uid: int | None = None, ip: str | None = None) -> DataFrame:
    """Current events that meet every condition given; ``ip`` may be either end."""
    out = current(events)
    for name, value in (("source_id", source_id), ("severity", severity), ("class_uid", class_uid)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out if ip is None else out.filter((F.col("src_ip") == ip) | (F.col("dst_ip") == ip))


def time_range(events: DataFrame, since_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """since <= time < until."""
    out = events if since_ms is None else events.filter(F.col("time") >= since_ms)
    return out if until_ms is None else out.filter(F.col("time") < until_ms)


def up_to_newest(events: DataFrame, minutes: int) -> DataFrame:
    """Events of the last minutes before the newest one; the newest time is a one-row table."""
    newest = events.agg(F.max("time").alias("_newest"))
    return events.join(F.broadcast(newest), F.col("time") >= F.col("_newest") - max(1, minutes) * 60_000).drop("_newest")


def not_own(events: DataFrame, pack: str = "baseline") -> DataFrame:
    """Without the detector's own events; rows without a parser stay."""
    return events.filter(F.col("parser_pack").isNull() | (F.col("parser_pack") != pack))


def like(events: DataFrame, term: str, columns: tuple[str, ...] = ("raw_text",)) -> DataFrame:
    """Substring search, case-insensitive, with % and _ in the term as wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{term}%"), F.lit(False))
    return events.filter(hit)


def words(text: Column) -> Column:
    """Search tokens: runs of letters and digits, lower-cased, Latin marks folded."""
    folded = F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def index(events: DataFrame, key: str = "event_id", text: str = "raw_text") -> DataFrame:
    """Inverted index: (word, key, pos)."""
    return events.select(key, F.posexplode(words(F.col(text))).alias("pos", "word")).select("word", key, "pos")


def match(indexed: DataFrame, term: str, key: str = "event_id") -> DataFrame:
    """Keys whose text has the term's words next to each other, the last one as a prefix."""
    spark = indexed.sparkSession
    parts = spark.range(1).select(words(F.lit(term)).alias("w")).first()["w"]
    if not parts:
        return indexed.select(key).limit(0)
    wanted = F.lit(False)
    for i, w in enumerate(parts):
        wanted = wanted | (F.col("word").startswith(w) if i == len(parts) - 1 else F.col("word") == w)
    places = [(F.col("word").startswith(w) if i == len(parts) - 1 else F.col("word") == w, i) for i, w in enumerate(parts)]
    at = F.array_compact(F.array(*[F.when(c, F.struct((F.col("pos") - i).alias("start"), F.lit(i).alias("i"))) for c, i in places]))
    rows = indexed.filter(wanted).select(key, F.inline(at))
    return rows.groupBy(key, "start").agg(F.count_distinct("i").alias("n")).filter(F.col("n") == len(parts)).select(key).distinct()


def page(events: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return events.orderBy(F.col("sequence_num").desc()).offset(offset).limit(limit)


def keyset_page(events: DataFrame, after: int, limit: int = 500) -> DataFrame:
    return events.filter(F.col("sequence_num") > after).orderBy("sequence_num").limit(limit)


# RFC 1918, carrier-grade NAT, loopback, link-local.
_PRIVATE = (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16))


def ipv4_number(ip: Column) -> Column:
    part = lambda i: F.try_element_at(F.split(ip, r"\."), F.lit(i)).try_cast("long")
    return part(1) * 16777216 + part(2) * 65536 + part(3) * 256 + part(4)


def is_private(ip: Column) -> Column:
    """Private, shared, loopback or link-local; for IPv6 the loopback, fc00::/7 and fe80::/10."""
    number, hit = ipv4_number(ip), F.lit(False)
    for net, bits in _PRIVATE:
        a, b, c, d = map(int, net.split("."))
        low = (a << 24) + (b << 16) + (c << 8) + d
        hit = hit | number.between(low, low + (1 << 32 - bits) - 1)
    six = F.lower(ip)
    return F.when(F.contains(ip, F.lit(":")), (six == "::1") | six.rlike("^f[cd]") | six.rlike("^fe[89ab]")).otherwise(F.coalesce(hit, F.lit(False)))
