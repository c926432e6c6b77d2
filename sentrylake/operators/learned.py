"""Parsers learned from samples: slots profiled over a sample, proposed as a spec, reviewed, and run as expressions.

A spec is data: for keyed formats a map of role to key, for text a template whose masked words are slots. It is compiled to
Column expressions, so applying it stays in the JVM.
"""

from __future__ import annotations

import json
import random
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import text as tx

from . import aligned
from .infer import CHECKS, key_role

VALID, PRESENT, REVIEW, LEAST = 0.95, 0.9, 0.8, 10
GATE = 0.9


@dataclass
class Slot:
    role: str
    at: str  # a key, or a slot's number in a template
    confidence: float
    needs_review: bool = False
    transform: str = ""  # a conversion of ``streaming.specs``


@dataclass
class Spec:
    name: str
    kind: str  # kv, text, or aligned and delimited (see ``aligned``)
    keys: list[str] = field(default_factory=list)
    template: str = ""
    slots: list[Slot] = field(default_factory=list)
    status: str = "candidate"

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Spec:
        raw = json.loads(text)
        return Spec(**{**raw, "slots": [Slot(**s) for s in raw["slots"]]})


def split(lines: list[str], seed: int = 7) -> tuple[list[str], list[str]]:
    """70 % to learn from and 30 % held out, of unique lines; nothing is held out under LEAST lines."""
    unique = sorted(set(lines))
    if len(unique) < LEAST:
        return unique, []
    random.Random(seed).shuffle(unique)
    cut = round(len(unique) * 0.7)
    return unique[:cut], unique[cut:]


_SLOT = re.compile(r"<(?:Q|URL|IP|MAC|HOST|HEX|X|N|ACTION|PROTO|\*)>")
_CAPTURE = {"<Q>": "(\"[^\"]*\"|'[^']*')", "<IP>": f"({tx.IPV4})", "<N>": r"(\d+)", "<URL>": r"(\S+)"}


def template_regex(template: str) -> tuple[str, list[str]]:
    """The regex of a masked template with a group for each slot, and the slots' kinds."""
    out, kinds, last = [], [], 0
    for m in _SLOT.finditer(template):
        literal = template[last : m.start()]
        out.append(r"\s+".join(re.escape(p) for p in literal.split(" ")))
        out.append(_CAPTURE.get(m.group(), r"(\S+?)"))
        kinds.append(m.group())
        last = m.end()
    out.append(r"\s+".join(re.escape(p) for p in template[last:].split(" ")))
    return "^" + "".join(out) + "$", kinds


def learn(lines: DataFrame, name: str) -> Spec:
    """A spec from the sample lines of one format (column ``line``), profiled in one pass."""
    keyed = lines.select(fm.kv(F.col("line"), least=3).alias("m"))
    total, with_pairs = keyed.agg(F.count("*"), F.count("m")).first()
    if total and with_pairs >= PRESENT * total:
        pairs = keyed.select(F.explode("m").alias("key", "value"))
        checks = [F.avg(F.when(c(F.col("value")).isNotNull(), 1.0).otherwise(0.0)).alias(r) for r, c in CHECKS.items()]
        rows = pairs.groupBy("key").agg(F.count("*").alias("n"), *checks).collect()
        keys = sorted(r["key"] for r in rows if r["n"] >= PRESENT * total)
        best: dict[str, Slot] = {}
        for r in sorted(rows, key=lambda r: r["key"]):
            role = key_role(r["key"])
            if role and r["key"] in keys and (role[0] == "time" or r[role[0]] >= VALID) and (role[0] not in best or role[1] > best[role[0]].confidence):
                best[role[0]] = Slot(role[0], r["key"], role[1], role[1] < REVIEW)
        return Spec(name, "kv", keys=keys, slots=list(best.values()))
    masked = lines.select(F.array_join(tx.mask_words(F.col("line")), " ").alias("t")).groupBy("t").count().orderBy(F.col("count").desc(), "t").first()
    template = masked["t"] if masked else ""
    _, kinds = template_regex(template)
    roles, slots = iter(("src_ip", "dst_ip")), []
    for i, kind in enumerate(kinds):
        role = {"<IP>": next(roles, None)}.get(kind) if kind == "<IP>" else {"<ACTION>": "action", "<PROTO>": "protocol"}.get(kind)
        if role:
            slots.append(Slot(role, str(i), 0.75, kind == "<IP>"))  # addresses by place alone are for a reviewer
    return Spec(name, "text", template=template, slots=slots)


def score(spec: Spec, line: Column) -> Column:
    """Of how sure the line is of the format: the share of its keys, or 1 for its template; null under 80 %."""
    if spec.kind == "kv":
        there = F.array_intersect(F.regexp_extract_all(line, F.lit(fm.KV), F.lit(1)), F.array(*map(F.lit, spec.keys)))
        return fm.let(F.size(there) / F.lit(float(max(1, len(spec.keys)))), lambda share: F.when(share >= 0.8, share))
    if spec.kind in ("aligned", "delimited"):
        return F.when(aligned.values_of(spec, line).isNotNull(), F.lit(1.0))
    return F.when(line.rlike(template_regex(spec.template)[0]), F.lit(1.0))


def apply(spec: Spec, line: Column) -> Column:
    """A struct of the spec's roles; a template with two impossible values is not its format."""
    pattern = template_regex(spec.template)[0] if spec.kind == "text" else ""
    source = fm.kv(line) if spec.kind == "kv" else aligned.values_of(spec, line) if spec.kind != "text" else F.array(*[F.regexp_extract(line, pattern, i + 1) for i in range(len(template_regex(spec.template)[1]))])

    def read(m: Column) -> Column:
        values = {}
        for s in spec.slots:
            raw = F.try_element_at(m, F.lit(s.at)) if spec.kind == "kv" else F.get(m, F.lit(int(s.at)))
            values[s.role] = fm.let(raw, CHECKS[s.role]) if s.role in CHECKS else raw
        return F.struct(*[values.get(r, F.lit(None).cast("string")).alias(r) for r in (*CHECKS, "time")])

    def whole(row: Column) -> Column:
        odd = sum((F.when(row[s.role].isNull(), 1).otherwise(0) for s in spec.slots), F.lit(0))
        return row if spec.kind == "kv" else F.when(odd < 2, row)

    return F.when(score(spec, line).isNotNull(), fm.let(fm.let(source, read), whole))


def best_match(specs: list[Spec], line: Column) -> Column:
    """The struct of the spec of greatest score, the first of equals; with its name."""
    options = F.array(*[F.struct(score(s, line).alias("score"), F.lit(-i).alias("order"), F.lit(s.name).alias("spec"), apply(s, line).alias("fields")) for i, s in enumerate(specs)])
    return F.get(F.reverse(F.array_sort(F.filter(options, lambda o: o["score"].isNotNull() & o["fields"].isNotNull()))), F.lit(0))


def evaluate(spec: Spec, lines: DataFrame) -> dict[str, float]:
    """Shares of lines that are recognised, and of those that fill every slot."""
    got = lines.select(apply(spec, F.col("line")).alias("f"))
    full = F.lit(True)
    for s in spec.slots:
        full = full & F.col(f"f.{s.role}").isNotNull()
    n, known, clean = got.agg(F.count("*"), F.count("f"), F.count_if(F.col("f").isNotNull() & full)).first()
    return {"lines": n, "recognised": known / n if n else 0.0, "clean": clean / n if n else 0.0}


def approve(spec: Spec, held_out: dict[str, float]) -> Spec:
    """Gates: nine in ten held-out lines recognised and clean, and nothing left to review."""
    if held_out["recognised"] < GATE or held_out["clean"] < GATE or any(s.needs_review for s in spec.slots):
        raise ValueError(f"{spec.name} does not pass: {held_out}, to review: {[s.role for s in spec.slots if s.needs_review]}")
    spec.status = "approved"
    return spec


def review(spec: Spec, role: str, at: str | None) -> Spec:
    """A reviewer sets a role's slot, confirms it, or (None) clears it; the spec is a candidate again."""
    spec.slots = [s for s in spec.slots if s.role != role and s.at != at]
    if at is not None:
        spec.slots.append(Slot(role, at, 1.0))
    spec.status = "candidate"
    return spec


def reparse(events: DataFrame, revisions: DataFrame, specs: list[Spec]) -> DataFrame:
    """New revisions of generic events that an approved spec reads and that have none by it yet; stored rows do not change."""
    ready = [s for s in specs if s.status == "approved"]
    if not ready:
        return events.limit(0).select("event_id", F.lit("").alias("spec"), F.lit(None).cast("string").alias("fields"))
    found = events.filter("superseded_by IS NULL").select("event_id", best_match(ready, F.col("raw_text")).alias("b")).filter("b IS NOT NULL")
    rows = found.select("event_id", F.col("b.spec").alias("spec"), F.to_json("b.fields").alias("fields"))
    return rows.join(revisions.select("event_id", "spec"), ["event_id", "spec"], "left_anti")
