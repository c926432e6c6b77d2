"""Column functions on raw text: decoding, masking, fingerprints, value checks, times.

All are Catalyst expressions; a value that fails its check is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IANA protocol numbers and the words that stand for a verdict, a severity or a protocol.
PROTOCOL_NAMES = {"1": "ICMP", "2": "IGMP", "6": "TCP", "17": "UDP", "47": "GRE", "50": "ESP", "51": "AH", "58": "IPV6-ICMP", "89": "OSPF", "132": "SCTP"}
PROTOCOL_WORDS = ("tcp", "udp", "icmp", "icmpv6", "ipv6-icmp", "gre", "esp", "ah", "sctp", "igmp", "ospf")
ALLOW_WORDS = (
    "allow", "allowed", "accept", "accepted", "permit", "permitted", "pass", "passed", "built", "forward", "forwarded", "open", "opened", "established",
)
DENY_WORDS = (
    "deny", "denied", "drop", "dropped", "block", "blocked", "reject", "rejected", "refuse", "refused", "reset", "discard", "discarded", "prevent",
    "prevented", "quarantine", "quarantined", "tcp_denied",
)
SEVERITY_WORDS = {
    "Critical": ("emergency", "emerg", "alert", "critical", "crit", "fatal", "very-high"),
    "High": ("high", "error", "err", "major"),
    "Medium": ("medium", "warning", "warn", "moderate"),
    "Low": ("minor", "low", "notice"),
    "Informational": ("informational", "information", "info", "debug"),
}
NOT_USERS = ("-", "n/a", "na", "none", "null", "unknown", "success", "succeeded", "failure", "failed", "fail", "true", "false", "yes", "no", "ok", "0", "1")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
IPV6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:.]*::)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?:" + IPV4 + ")?"


def decode(raw: Column) -> Column:
    """A struct (text, encoding): UTF-8 where the bytes are valid, else Latin-1, so that nothing is lost."""
    text = F.decode(raw, "ISO-8859-1")
    utf8 = F.is_valid_utf8(raw.cast("string"))
    return F.struct(F.when(utf8, raw.cast("string")).otherwise(text).alias("text"), F.when(utf8, "utf-8").otherwise("latin-1").alias("encoding"))


def framing(raw: Column) -> Column:
    """A struct (body, framing): exactly one line end removed."""
    text = F.decode(raw, "ISO-8859-1")
    end = F.when(text.endswith("\r\n"), "\r\n").when(text.endswith("\n"), "\n").otherwise("")
    body = F.encode(F.substring(text, F.lit(1), F.length(text) - F.length(end)), "ISO-8859-1")
    return F.struct(body.alias("body"), F.when(end == "\r\n", "CRLF").when(end == "\n", "LF").otherwise("").alias("framing"))


def as_ip(value: Column) -> Column:
    s = F.regexp_replace(F.trim(value), r"^\[|\]$", "")
    return F.when(value.rlike(f"^(?:{IPV4})$"), value).when(s.rlike(f"^(?:{IPV4})$"), s).when(s.rlike(f"^(?:{IPV6})$"), F.lower(s))


def as_port(value: Column) -> Column:
    s = F.trim(value)
    n = F.when(s.rlike(r"^\d{1,9}$"), s.cast("int"))
    return F.when(n <= 65535, n)


def _lookup(value: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in groups.items():
        out = F.when(value.isin(*words), F.lit(name)).otherwise(out)
    return out


def as_protocol(value: Column) -> Column:
    s = F.lower(F.trim(value))
    named = F.create_map(*[F.lit(x) for k, v in PROTOCOL_NAMES.items() for x in (k, v)])
    return F.when(s.rlike(r"^\d+$"), F.try_element_at(named, s)).when(s.isin(*PROTOCOL_WORDS), F.upper(s))


def as_action(value: Column) -> Column:
    """allowed or denied when the words of only one kind are there."""
    words = F.split(F.lower(value), "[^a-z_]+")
    allow, deny = (F.arrays_overlap(words, F.array(*map(F.lit, w))) for w in (ALLOW_WORDS, DENY_WORDS))
    return F.when(allow & ~deny, "allowed").when(deny & ~allow, "denied")


def as_severity(value: Column) -> Column:
    return _lookup(F.lower(F.trim(value)), SEVERITY_WORDS)


def cef_severity(value: Column) -> Column:
    s = F.trim(value)
    n = s.try_cast("int")
    return F.when(s.rlike(r"^\d+$"), F.when(n <= 3, "Low").when(n <= 6, "Medium").when(n <= 8, "High").otherwise("Critical")).otherwise(as_severity(s))


def as_user(value: Column) -> Column:
    s = F.trim(value)
    odd = as_ip(s).isNotNull() | F.lower(s).isin(*NOT_USERS, *ALLOW_WORDS, *DENY_WORDS) | s.rlike(r"^\d*$")
    return F.when(~odd, s)


def as_signature(value: Column) -> Column:
    s = F.trim(value)
    return F.when(~s.rlike(r"^\d*$"), s)


# Fixed order: quoted runs, addresses of all kinds, hexadecimal and mixed words, then numbers.
_MASKS = (
    (r"\"[^\"]*\"|'[^']*'", "<Q>"),
    (r"\b[a-zA-Z][a-zA-Z0-9+.-]*://\S+", "<URL>"),
    (rf"(?<![\d.]){IPV4}(?![\d.])", "<IP>"),
    (r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "<MAC>"),
    (r"\b(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b", "<HOST>"),
    (r"\b0x[0-9A-Fa-f]+\b", "<HEX>"),
    (r"\b(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]+\b", "<X>"),
    (r"\d+", "<N>"),
)


def mask(text: Column) -> Column:
    for pattern, name in _MASKS:
        text = F.regexp_replace(text, pattern, name)
    return text


def mask_words(text: Column, most: int | None = None) -> Column:
    """The text's tokens with values masked; verdict and protocol words are values too."""
    tokens = F.regexp_extract_all(text, F.lit(r'((?:[^\s"]|"[^"]*"?)+)'), F.lit(1))
    if most is not None:
        tokens = F.slice(tokens, 1, most)

    def one(m: Column) -> Column:
        low = F.trim(F.lower(m), F.lit(",.:;()[]"))
        return F.when(low.isin(*ALLOW_WORDS, *DENY_WORDS), "<ACTION>").when(low.isin(*PROTOCOL_WORDS), "<PROTO>").otherwise(m)

    # Two passes, as a lambda would mask a token once for each use; without any of these characters no mask fits.
    return F.transform(F.transform(tokens, lambda t: F.when(t.rlike("[\"'.:0-9-]"), mask(t)).otherwise(t)), one)


def text_fingerprint(text: Column, app: Column, most: int = 24) -> Column:
    basis = F.concat_ws("|", F.lit("text"), F.regexp_replace(F.coalesce(app, F.lit("")), r"\d+", "<N>"), F.array_join(mask_words(text, most), " "))
    return F.substring(F.sha1(basis), 1, 12)


def keyed_fingerprint(kind: Column, delimiter: Column, app: Column, keys: Column) -> Column:
    names = F.array_join(F.transform(F.slice(keys, 1, 14), lambda k: F.lower(k)), "|")
    return F.substring(F.sha1(F.concat(kind, F.lit("|"), F.coalesce(delimiter, F.lit("None")), F.lit("|"), F.regexp_replace(F.coalesce(app, F.lit("")), r"\d+", "<N>"), F.lit("|"), names)), 1, 12)


def shape(text: Column) -> Column:
    """Digits as 9 and letters as a: one value per layout."""
    return F.translate(F.translate(text, "0123456789", "9999999999"), "ABCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz", "a" * 51)


# The layouts of times that are tried, in order.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]'Z'", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z", "MMM d yyyy HH:mm:ss",
)


def epoch_millis(value: Column) -> Column:
    """Seconds, milli-, micro- or nanoseconds by magnitude; null for what is no number."""
    n = F.when(F.trim(value).rlike(r"^\d{9,19}(\.\d+)?$"), F.trim(value).cast("double"))
    scaled = F.when(n < 1e11, n * 1000).when(n < 1e14, n).when(n < 1e17, n / 1e3).otherwise(n / 1e6)
    return F.floor(scaled).cast("long")


def read_time(value: Column, now_ms: int) -> Column:
    """Epoch milliseconds, UTC where no zone is given. A yearless time gets the year of ``now``, or the one before where that
    lies more than two days ahead; outside 2000 to now + 2 days it is null."""
    tried = [F.try_to_timestamp(value, F.lit(f)) for f in TIME_FORMATS]
    year = F.year(F.timestamp_millis(F.lit(now_ms)))
    yearless = lambda y: F.try_to_timestamp(F.concat(y.cast("string"), F.lit(" "), F.regexp_replace(F.trim(value), r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    limit = now_ms + 2 * 86_400_000
    this = F.unix_millis(yearless(year))
    short = F.when(this <= limit, this).otherwise(F.unix_millis(yearless(year - 1)))
    ms = F.coalesce(epoch_millis(value), F.unix_millis(F.coalesce(*tried)), short)
    return F.when(ms.between(946684800000, limit), ms)


def ist(ms: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), "Asia/Kolkata"), "yyyy-MM-dd'T'HH:mm:ss'+05:30'")


def normal_severity(value: Column) -> Column:
    """1 Informational to 5 Critical, from a number or words; null counts as 1."""
    s = F.lower(F.trim(value))
    n = s.try_cast("double")
    by_number = F.when(n >= 4.5, 5).when(n >= 3.5, 4).when(n >= 2.5, 3).when(n >= 1.5, 2).otherwise(1)
    has = lambda *w: s.rlike("|".join(w))
    by_word = F.when(has("crit", "emerg", "alert", "fatal"), 5).when(has("err", "high", "severe"), 4).when(has("warn", "med"), 3).when(has("low", "notice"), 2).otherwise(1)
    return F.when(value.isNull(), 1).when(n.isNotNull(), by_number).otherwise(by_word)


def normal_action(value: Column) -> Column:
    """A struct (disposition, action); the first kind of word found in this order decides."""
    s = F.lower(F.trim(value))
    kinds = (("allow|accept|pass|permit|success", "allowed", "allow"), ("deny|denied|block|reject", "denied", "deny"), ("drop|discard", "dropped", "drop"), ("alert|detect|warn", "alert", "alert"))
    d, a = s, s
    for words, disposition, action in reversed(kinds):
        d, a = F.when(s.rlike(words), disposition).otherwise(d), F.when(s.rlike(words), action).otherwise(a)
    return F.struct(d.alias("disposition"), a.alias("action"))
