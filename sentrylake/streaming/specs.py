"""Learned parsers as a table of data that every micro-batch reads again.

A spec is a row: its keys or its pattern, and for each role where its value is and how it is converted. The plan that reads lines by such rows is
the same however many there are, so a spec that is approved while a stream runs is used from the next batch on, and none is compiled into the
query. Versions of a spec are files that never change; the latest of a name counts, if it is approved.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import text as tx
from sentrylake.operators import aligned
from sentrylake.operators.infer import CHECKS
from sentrylake.operators.learned import Slot, Spec, template_regex

ROLES = (*CHECKS, "time")
#: Conversions of a value in place of the check of its role, by name; one that begins with $ is a path into a JSON value.
CONVERSIONS: dict[str, Callable[[Column], Column]] = {"cef_severity": tx.cef_severity, "syslog_severity": lambda v: fm.pri_severity(v.try_cast("int") % 8)}
_BETWEEN = "\x1d\x1e\x1d"
_ROW = "name string, version long, kind string, keys array<string>, pattern string, found string, slots array<struct<role:string,at:string,path:string,conversion:string>>"


class SpecStore:
    """Versions of specs under a folder of the shared file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def put(self, spec: Spec) -> int:
        """Keep a new version of a spec; returns its number. A reader sees a version whole or not at all."""
        jvm = self.spark._jvm
        to = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = to("x").getFileSystem(self.spark._jsc.hadoopConfiguration())
        version = 1 + max((v for n, v, _ in self._versions() if n == spec.name), default=0)
        said = json.dumps({"name": spec.name, "version": version, "spec": asdict(spec)}, sort_keys=True)
        name = f"{spec.name.encode().hex()}-{version:09d}"
        out = fs.create(to(f"_{name}"), True)
        out.write(bytearray(said.encode()))
        out.close()
        if not fs.rename(to(f"_{name}"), to(f"{name}.json")):
            raise ValueError(f"version {version} of {spec.name} was put by another at the same time")
        return version

    def _versions(self) -> list[tuple[str, int, Spec]]:
        """All versions; parsers are configuration, so few."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path) or not any(s.getPath().getName().endswith(".json") for s in fs.listStatus(path)):
            return []
        rows = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/*.json", wholetext=True).collect()]
        return [(r["name"], r["version"], Spec(**{**r["spec"], "slots": [Slot(**s) for s in r["spec"]["slots"]]})) for r in rows]

    def current(self) -> list[tuple[int, Spec]]:
        """The approved specs among the latest versions, by name."""
        latest: dict[str, tuple[int, Spec]] = {}
        for name, version, spec in self._versions():
            if name not in latest or latest[name][0] < version:
                latest[name] = (version, spec)
        return [v for _, v in sorted(latest.items()) if v[1].status == "approved"]


def _row(version: int, spec: Spec) -> tuple:
    slots = [(s.role, s.at, s.transform if s.transform.startswith("$") else "", s.transform) for s in spec.slots]
    pattern = {"kv": "", "delimited": aligned.cells_pattern(spec.template) if spec.kind == "delimited" else "", "aligned": spec.template}.get(spec.kind)
    pattern = template_regex(spec.template)[0] if pattern is None else pattern
    groups = 0 if spec.kind in ("kv", "delimited") else re.compile(pattern).groups
    found = spec.template if spec.kind == "delimited" else _BETWEEN.join(f"${i + 1}" for i in range(groups)) + _BETWEEN
    return spec.name, version, spec.kind, spec.keys, pattern, found, slots


def table(spark: SparkSession, specs: list[tuple[int, Spec]]) -> DataFrame:
    """Specs as rows."""
    return spark.createDataFrame([_row(v, s) for v, s in specs], _ROW)


def read_with(lines: DataFrame, specs: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ``spec``, ``version`` and a column for each role, by the spec that fits best, the first by name of equals; nulls where none
    fits. All specs are one row beside every line: they are configuration."""
    one = specs.agg(F.array_sort(F.collect_list(F.struct(*specs.columns))).alias("_specs"))
    rows = lines.join(F.broadcast(one)).withColumn("_m", fm.kv(F.col(line)))
    text = F.col(line)

    def read(s: Column) -> Column:
        kind = s["kind"]
        share = F.size(F.array_intersect(F.map_keys("_m"), s["keys"])) / F.greatest(F.size(s["keys"]), F.lit(1))
        cells = F.when(kind == "delimited", F.transform(F.regexp_extract_all(F.concat(s["found"], text), s["pattern"], F.lit(1)), _plain))
        cells = F.when(F.size(cells) == F.get(s["keys"], F.lit(0)).try_cast("int"), cells)
        groups = F.when(kind.isin("aligned", "text") & F.rlike(text, F.concat(F.lit("(?s)"), s["pattern"])), F.split(F.regexp_replace(text, F.concat(F.lit("(?s)^.*?"), s["pattern"], F.lit(".*$")), s["found"]), _BETWEEN))
        parts = F.coalesce(cells, groups)
        score = F.when(kind == "kv", F.when(share >= 0.8, share)).otherwise(F.when(parts.isNotNull(), F.lit(1.0)))
        raw = lambda x: F.when(kind == "kv", F.try_element_at(F.col("_m"), x["at"])).otherwise(F.get(parts, x["at"].try_cast("int")))
        value = lambda x: F.when(x["path"] != "", F.call_function("get_json_object", raw(x), x["path"])).otherwise(raw(x))
        values = F.transform(s["slots"], lambda x: F.struct(x["role"].alias("role"), value(x).alias("value"), x["conversion"].alias("conversion")))
        return F.struct(score.alias("score"), s["name"].alias("name"), s["version"].alias("version"), kind.alias("kind"), F.when(score.isNotNull(), values).alias("values"))

    best = F.get(F.array_sort(F.filter(F.transform("_specs", read), lambda c: c["score"].isNotNull()), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["name"] < b["name"], -1).otherwise(1)), F.lit(0))
    rows = rows.withColumn("_best", best)

    def role(name: str) -> Column:
        slot = F.get(F.filter("_best.values", lambda x: x["role"] == name), F.lit(0))
        checked = fm.let(slot["value"], CHECKS[name]) if name in CHECKS else slot["value"]
        for conversion, f in CONVERSIONS.items():
            checked = F.when(slot["conversion"] == conversion, fm.let(slot["value"], f)).otherwise(checked)
        return checked

    rows = rows.withColumns({f"_r_{r}": role(r) for r in ROLES})

    def impossible(name: str) -> Column:
        return F.when(F.exists("_best.values", lambda x: x["role"] == name) & F.col(f"_r_{name}").isNull(), 1).otherwise(0)

    odd = sum(map(impossible, ROLES), F.lit(0))
    fits = F.col("_best").isNotNull() & ((F.col("_best.kind") == "kv") | (odd < 2))  # two impossible values: not its layout
    return rows.select(*lines.columns, F.when(fits, F.col("_best.name")).alias("spec"), F.when(fits, F.col("_best.version")).alias("version"), *[F.when(fits, F.col(f"_r_{r}")).alias(r) for r in ROLES])


def _plain(cell: Column) -> Column:
    t = F.trim(cell)
    return F.when(t.rlike('^"[\\s\\S]*"$'), F.replace(F.regexp_replace(t, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(t)


def reader(store: SpecStore, write: Callable[[DataFrame, int], None], line: str = "line") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch read by the specs that are approved when it begins."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(read_with(batch, table(batch.sparkSession, store.current()), line), batch_id)

    return run
