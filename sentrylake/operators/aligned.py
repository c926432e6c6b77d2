"""Layouts of lines without keys, learned by aligning the tokens of a format's samples.

Words that every sample holds once, in one order, are anchors. Between two anchors tokens are aligned by their place, from the left and from
the right, as far as all samples agree on their kind; what varies in number between is a wildcard. A token that never changes is literal, any other is
a slot. Delimited lines are aligned by column. What stands before a slot, or else its values, propose its role; a role by place alone is for a reviewer.

A format's samples are learned from in one task, SAMPLE lines at most: those of smallest hash, kept by a rank that Spark limits before the
exchange. HELD of them are held out and tell how far the layout reads lines that it was not learned from. The layout is data (a
``learned.Spec``) and its use a column expression.
"""

from __future__ import annotations

import ipaddress
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import text as tx
from sentrylake.session import ship

from .infer import SOURCE, TARGET, key_role

#: Lines of a format that are learned from or held out, and the share of these that is held out.
SAMPLE, HELD = 2000, 0.4
#: Shares of samples that must hold an anchor, agree on a token's kind, or have valid values.
ANCHOR, AGREE, VALID = 0.95, 0.95, 0.95
DELIMITERS, LEAST_COLUMNS, MOST_PROSE = ",;|\t", 4, 0.25
#: Kinds of tokens, the first that fits; the same patterns in Python and in Java.
KINDS = {
    "time": r"\d{4}[-/]\d\d?[-/]\d\d?[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?|[A-Z][a-z][a-z] +\d{1,2} (?:\d{4} )?\d\d:\d\d:\d\d|\d\d:\d\d:\d\d",
    "mac": r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}",
    "ip": r"(?:\d{1,3}\.){3}\d{1,3}(?![A-Za-z0-9_.])|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}",
    "quoted": r'"[^"]*"',
    "num": r"\d+(?![A-Za-z0-9_.])",
    "word": r"[A-Za-z0-9_](?:[A-Za-z0-9_.\-]*[A-Za-z0-9_])?",
    "mark": r"[^A-Za-z0-9_\s]",
}
_TOKEN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))


@dataclass
class Item:
    """A place of a layout: a literal, a slot with the values of the samples, or a wildcard; and whether white space stands before it."""

    text: str | None = None
    kinds: tuple[str, ...] = ()
    values: list[str] = field(default_factory=list)
    space: str = ""

    @property
    def slot(self) -> bool:
        return self.text is None and bool(self.kinds)


def _valid(check: Callable[[str], bool], values: list[str]) -> bool:
    return bool(values) and sum(map(check, values)) >= VALID * len(values)


def _is_ip(v: str) -> bool:
    try:
        ipaddress.ip_address(v)
    except ValueError:
        return False
    return True


def _is_port(v: str) -> bool:
    return v.isdigit() and len(v) < 6 and int(v) < 65536


CHECKS: dict[str, Callable[[str], bool]] = {
    "ip": _is_ip, "port": _is_port, "protocol": lambda v: v.lower() in tx.PROTOCOL_WORDS, "action": lambda v: v.lower() in (*tx.ALLOW_WORDS, *tx.DENY_WORDS),
    "severity": lambda v: v.lower() in {w for words in tx.SEVERITY_WORDS.values() for w in words}, "number": lambda v: v in tx.PROTOCOL_NAMES,
}


def _tokens(line: str) -> list[tuple[str, str, bool]]:
    """(text, kind, whether white space stands before it)."""
    return [(m.group(), m.lastgroup, m.start() > 0 and line[m.start() - 1].isspace()) for m in _TOKEN.finditer(line)]


def anchors(lines: list[list[tuple]]) -> list[str]:
    """Words that nearly all lines hold once and in this order, without those that are values."""
    once, places = Counter(), {}
    for tokens in lines:
        count = Counter(t for t, kind, _ in tokens if kind == "word")
        for at, (t, kind, _) in enumerate(tokens):
            if kind == "word" and count[t] == 1:
                once[t] += 1
                places.setdefault(t, []).append(at)
    words = [w for w, n in once.items() if n >= ANCHOR * len(lines) and not any(CHECKS[c](w) for c in ("protocol", "action", "severity")) and not w.isdigit()]
    out: list[str] = []
    for word in sorted(words, key=lambda w: (sum(places[w]) / len(places[w]), w)):
        ordered = lambda tokens: (at := {t: i for i, (t, _, _) in enumerate(tokens)}).get(out[-1], -1) < at.get(word, -1)
        if not out or sum(map(ordered, lines)) >= ANCHOR * len(lines):
            out.append(word)
    return out


def _columns(rows: list[list[tuple]]) -> list[Item]:
    """Tokens between two anchors, one row a line, as items."""
    least, most = min(map(len, rows)), max(map(len, rows))

    def agreed(at: Callable[[list], tuple]) -> bool:
        return Counter(at(r)[1] for r in rows).most_common(1)[0][1] >= AGREE * len(rows)

    left = least if least == most else next((i for i in range(least) if not agreed(lambda r: r[i])), least)  # noqa: B023
    right = 0 if least == most else next((i for i in range(least - left) if not agreed(lambda r: r[-1 - i])), least - left)  # noqa: B023
    ends = [*((lambda r, i=i: r[i]) for i in range(left)), *((lambda r, i=i: r[-1 - i]) for i in reversed(range(right)))]
    items = [_item([at(r) for r in rows]) for at in ends]
    return items if least == most else [*items[:left], Item(space="s"), *items[left:]]


def _item(tokens: list[tuple]) -> Item:
    spaces, texts = {s for _, _, s in tokens}, {t for t, _, _ in tokens}
    space = "s" if len(spaces) > 1 else "S" if spaces == {True} else ""
    value = any(check(t) for t in texts for check in CHECKS.values()) or tokens[0][1] in ("time", "mac")
    if len(texts) == 1 and not value:
        return Item(text=tokens[0][0], space=space)
    return Item(kinds=tuple(k for k in KINDS if any(k == kind for _, kind, _ in tokens)), values=[t for t, _, _ in tokens], space=space)


def align(lines: list[str]) -> list[Item]:
    """The layout of the lines that hold all anchors in order."""
    rows = [_tokens(x) for x in lines]
    fixed = anchors(rows)
    gaps: list[list[list[tuple]]] = [[] for _ in range(len(fixed) + 1)]
    before: list[list[bool]] = [[] for _ in fixed]
    for tokens in rows:
        at = {t: i for i, (t, _, _) in enumerate(tokens)}
        places = [at.get(w, -1) for w in fixed]
        if -1 in places or sorted(places) != places:
            continue
        for gap, a, b in zip(gaps, [-1, *places], [*places, len(tokens)], strict=True):
            gap.append(tokens[a + 1 : b])
        for said, p in zip(before, places, strict=True):
            said.append(tokens[p][2])
    out: list[Item] = []
    for i, gap in enumerate(gaps):
        if gap:
            out += _columns(gap)
        if i < len(fixed) and gap:
            out.append(Item(text=fixed[i], space="s" if len(set(before[i])) > 1 else "S" if before[i][0] else ""))
    return out


def pattern(items: list[Item]) -> str:
    """The expression of a layout, with a group for each slot."""
    out = ["^"]
    for i, x in enumerate(items):
        if x.text is None and not x.kinds:
            out.append(r"[\s\S]*?")
            continue
        out.append({"S": r"\s+", "s": r"\s*", "": r"\s*" if i == 0 else ""}[x.space])
        out.append(re.sub(r"([^A-Za-z0-9_])", r"\\\1", x.text) if x.text is not None else f"({'|'.join(KINDS[k] for k in x.kinds)})")
    return "".join(out) + r"\s*$"


def propose(items: list[Item]) -> list[tuple[str, int, float, bool]]:
    """(role, number of the slot, confidence, for a reviewer) of the slots whose meaning is known, each role once."""
    number = {id(x): n for n, x in enumerate(x for x in items if x.slot)}
    found: dict[int, tuple[str, float, bool]] = {}
    addresses: list[int] = []  # places of address items
    last_word, last_slot = "", None
    for at, x in enumerate(items):
        if not x.slot:
            last_word = x.text.lower() if x.text and x.text[0].isalpha() else last_word
            continue
        n, marks = number[id(x)], ""
        for y in reversed(items[:at]):
            if y.text is None or y.text[0].isalnum():
                break
            marks = y.text + marks
        word = items[at - len(marks) - 1].text if at > len(marks) else None
        named = key_role(word) if word and word[0].isalpha() and marks in ("=", ":", "=\"") else None
        side = "src" if last_word in SOURCE else "dst" if last_word in TARGET else None
        if _valid(CHECKS["ip"], x.values):
            addresses.append(at)
            if named and named[0].endswith("_ip"):
                found[n] = (*named, False)
            elif marks in ("->", "=>", ">"):
                found[n] = ("dst_ip", 0.85, False)
                if last_slot is not None and len(addresses) > 1:
                    found.setdefault(number[id(items[addresses[-2]])], ("src_ip", 0.85, False))
            elif side:
                found[n] = (f"{side}_ip", 0.85, False)
        elif _valid(CHECKS["port"], x.values):
            owner = next((a for a in reversed(addresses) if a < at), None)
            if named and named[0].endswith("_port"):
                found[n] = (*named, False)
            elif owner is not None and ((marks in (":", "/") and items[at - len(marks) - 1] is items[owner]) or (last_word == "port" and last_slot == owner)):
                found[n] = ("port of", owner, False)
        elif _valid(CHECKS["protocol"], x.values):
            found[n] = ("protocol", 0.85, False)
        elif _valid(CHECKS["action"], x.values) and (len(set(x.values)) > 1 or (named and named[0] == "action")):  # one word may be no verdict
            found[n] = ("action", 0.85, False)
        elif named and named[0] == "severity" and _valid(CHECKS["severity"], x.values):
            found[n] = (*named, False)
        elif last_word in ("user", "username", "account", "login") and not x.kinds[0] == "mark":
            found[n] = ("user", 0.8, False)
        last_word, last_slot = "", at
    roles = {found[number[id(items[a])]][0] for a in addresses if number[id(items[a])] in found}
    rest = [number[id(items[a])] for a in addresses if number[id(items[a])] not in found]
    for role, n in zip([r for r in ("src_ip", "dst_ip") if r not in roles], rest, strict=False):
        found[n] = (role, 0.6, True)
    out: dict[str, tuple[str, int, float, bool]] = {}
    for n, (role, sure, review) in sorted(found.items()):
        if role == "port of":
            owner = found.get(number[id(items[sure])])
            if owner is None:
                continue
            role, sure, review = owner[0].replace("_ip", "_port"), owner[1], owner[2]
        if role not in out or out[role][2] < sure:
            out[role] = (role, n, sure, review)
    return list(out.values())


def cells_pattern(delimiter: str) -> str:
    d = re.escape(delimiter)
    return rf'{d}("(?:[^"]|"")*"|[^{d}]*)'


def delimiter_of(lines: list[str]) -> str | None:
    """The delimiter that cuts nearly all lines into one number of columns, quotes observed, most of which are no prose."""
    best = None
    for d in DELIMITERS:
        table = [re.findall(cells_pattern(d), d + x) for x in lines]
        width, n = Counter(map(len, table)).most_common(1)[0]
        prose = sum(len(_TOKEN.findall(c)) > 1 and len(c.split()) > 1 and not re.fullmatch(KINDS["time"], c.strip()) and c.strip()[0] != '"' for row in table for c in row)
        if prose > MOST_PROSE * sum(map(len, table)):
            continue
        if width >= LEAST_COLUMNS and n >= ANCHOR * len(lines) and (best is None or width > best[0]):
            best = (width, d)
    return best[1] if best else None


def propose_columns(columns: list[list[str]]) -> list[tuple[str, int, float, bool]]:
    """Roles of columns by their values alone. A number that never changes is no protocol: it may be a version."""
    out, ips, ports = [], iter(("src_ip", "dst_ip")), []
    seen: set[str] = set()
    for i, values in enumerate(columns):
        values = [v for v in values if v not in ("", "-")]
        of = lambda role: _valid(CHECKS[role], values)  # noqa: B023, E731
        if of("ip"):
            role = next(ips, None)
            out += [(role, i, 0.6, True)] if role else []
        elif of("protocol") or (of("number") and 1 < len(set(values)) <= 4 and "protocol" not in seen):
            out.append(("protocol", i, 0.85 if of("protocol") else 0.7, not of("protocol")))
        elif of("action"):
            out.append(("action", i, 0.85, False))
        elif of("severity"):
            out.append(("severity", i, 0.7, True))
        elif of("port") and {"src_ip", "dst_ip"} <= seen:
            ports.append((len(set(values)) / len(values), i))
        seen |= {r for r, *_ in out}
    if len(ports) >= 2:  # a client's ports differ from line to line, a service has few
        (_, service), (_, client) = min(ports[:2]), max(ports[:2])
        out += [("src_port", client, 0.7, True), ("dst_port", service, 0.7, True)]
    first: dict[str, tuple[str, int, float, bool]] = {}
    for row in out:
        first.setdefault(row[0], row)
    return list(first.values())


def learn_lines(lines: list[str], name: str):
    """The spec of a format from its sample lines."""
    from .learned import REVIEW, Slot, Spec

    delimiter = delimiter_of(lines)
    if delimiter:
        table = [re.findall(cells_pattern(delimiter), delimiter + x) for x in lines]
        width = Counter(map(len, table)).most_common(1)[0][0]
        columns = [[unquote(r[i]) for r in table if len(r) == width] for i in range(width)]
        slots, spec = propose_columns(columns), Spec(name, "delimited", keys=[str(width)], template=delimiter)
    else:
        items = align(lines)
        slots, spec = propose(items), Spec(name, "aligned", template=pattern(items))
    spec.slots = [Slot(role, str(n), sure, review or sure < REVIEW) for role, n, sure, review in slots]
    return spec


def unquote(cell: str) -> str:
    cell = cell.strip()
    return cell[1:-1].replace('""', '"') if len(cell) > 1 and cell[0] == cell[-1] == '"' else cell


def values_of(spec, line: Column) -> Column:
    """The values of a spec's slots or columns, as an array; null where the line has not its layout."""
    from sentrylake.functions import formats as fm

    if spec.kind == "aligned":
        return fm.groups(line, spec.template)
    cells = F.regexp_extract_all(F.concat(F.lit(spec.template), line), F.lit(cells_pattern(spec.template)), F.lit(1))
    plain = F.transform(cells, lambda c: F.when(F.trim(c).rlike('^"[\\s\\S]*"$'), F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(F.trim(c)))
    return F.when(F.size(cells) == int(spec.keys[0]), plain)


def _read(spec, line: str) -> list[str] | None:
    if spec.kind == "aligned":
        m = re.match(spec.template, line)
        return list(m.groups()) if m else None
    row = re.findall(cells_pattern(spec.template), spec.template + line)
    return list(map(unquote, row)) if len(row) == int(spec.keys[0]) else None


def learn_formats(lines: DataFrame) -> DataFrame:
    """(format, spec, learned_from, held_out, recognised, clean) of lines (format, line): a spec for each format, as JSON, and the shares of
    held-out lines that it recognises and of which all slots are valid."""
    ship(lines.sparkSession)
    rank = F.row_number().over(Window.partitionBy("format").orderBy(F.xxhash64("line"), "line"))
    few = lines.select("format", "line").withColumn("_n", rank).filter(F.col("_n") <= SAMPLE).drop("_n")

    def learn(pdf):
        import pandas as pd

        unique = sorted(set(pdf["line"].dropna()), key=lambda x: (hash_of(x), x))
        cut = len(unique) - int(HELD * len(unique))
        train, held = unique[:cut], unique[cut:]
        if not train:
            return pd.DataFrame([], columns=["format", "spec", "learned_from", "held_out", "recognised", "clean"])
        spec = learn_lines(train, str(pdf["format"].iloc[0]))
        rows = [_read(spec, x) for x in held]
        check = lambda s, v: CHECKS["ip" if s.role.endswith("_ip") else "port" if s.role.endswith("_port") else s.role](v) if s.role in ("src_ip", "dst_ip", "src_port", "dst_port", "action") else bool(v)
        clean = [r for r in rows if r is not None and all(check(s, r[int(s.at)]) for s in spec.slots)]
        share = lambda x: len(x) / len(held) if held else 0.0
        return pd.DataFrame([(spec.name, spec.to_json(), len(train), len(held), share([r for r in rows if r is not None]), share(clean))], columns=["format", "spec", "learned_from", "held_out", "recognised", "clean"])

    return few.groupBy("format").applyInPandas(learn, "format string, spec string, learned_from long, held_out long, recognised double, clean double")


def hash_of(line: str) -> int:
    """A number that has nothing to do with what the line says."""
    import zlib

    return zlib.crc32(line[::-1].encode())
