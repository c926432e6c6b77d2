"""Registry of line formats: what is known of each, and merging of text templates that differ in one word."""

from __future__ import annotations

import bisect
import itertools
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions.formats import let
from sentrylake.session import scratch_dir, ship

# Words that tell directions or verdicts apart, so templates that differ in one are different formats.
DIRECTION = frozenset(("inbound", "outbound", "in", "out", "from", "to", "src", "dst", "source", "destination", "<ACTION>"))
#: Templates of fewer words are not merged.
LEAST_WORDS = 4
#: Into so many pieces are words cut, so that a template's pieces are few; in lists of more wildcards every word is one.
CUTS = (3, 4, 6, 8, 12, 16, 24)
#: So many entries at most are sent to all tasks, which look the pieces of templates up in theirs.
BROADCAST = 50_000


def summarise(lines: DataFrame, samples: int = 200, top: int = 20) -> DataFrame:
    """Per format_id: lines, mean confidence, first and last time, sources, the ``top`` sources by lines, and ``samples`` lines.

    Samples are the distinct lines with the smallest hashes: the smallest of each of 64 salts, then of those the format's, so that
    no task holds a format's lines.
    """
    base = lines.groupBy("format_id").agg(
        F.count("*").alias("lines"), F.round(F.avg("confidence"), 2).alias("confidence"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.count_distinct("source_id").alias("sources")
    )

    def smallest(rows: DataFrame, by: list, order: list, most: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= most).drop("rank")

    few = lines.filter("line IS NOT NULL").select("format_id", "line").distinct().withColumn("h", F.xxhash64("line"))
    few = smallest(few.withColumn("salt", F.pmod("h", F.lit(64))), ["format_id", "salt"], ["h", "line"], samples)
    few = smallest(few, ["format_id"], ["h", "line"], samples)
    kept = few.groupBy("format_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "line"))), lambda x: x["line"]).alias("samples"))
    by_source = smallest(lines.groupBy("format_id", "source_id").agg(F.count("*").alias("n")), ["format_id"], [F.col("n").desc(), "source_id"], top)
    first = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "source_id"))), lambda x: F.struct(x["source_id"].alias("source_id"), (-x["less"]).alias("lines")))
    return base.join(kept, "format_id", "left").join(by_source.groupBy("format_id").agg(first.alias("top_sources")), "format_id", "left")


def merge_templates(templates: list[tuple[str, str, str, int]]) -> dict[str, str]:
    """format_id -> canonical id of (format_id, app, template, first_seen) rows, in order of their first time.

    Text templates of four words or more with equal app and length merge when at most one word differs and that word tells no
    direction. The result depends on the order and merges stay.
    """
    merger, canonical = Merger(), {}
    for fid, app, template, _ in sorted(templates, key=lambda t: (t[3], t[0])):
        canonical[fid] = merger.add(fid, app, template)
    return canonical


class _Half:
    """Entries of one length by one half of their words, without the wildcards. Only entries that agree in one half can differ in one word
    at most. Patterns, the places without wildcards, are looked up in the order of their first entry."""

    def __init__(self, span: range):
        self.span, self.patterns, self.order = span, {}, []

    def put(self, n: int, words: list[str]) -> None:
        fixed = tuple(i for i in self.span if words[i] != "<*>")
        if fixed not in self.patterns:
            pick = itemgetter(*fixed) if fixed else lambda words: None
            self.patterns[fixed] = [n, pick, {}]
        found = self.patterns[fixed]
        bisect.insort(found[2].setdefault(found[1](words), []), n)
        if n <= found[0]:
            found[0] = n
            self.order = sorted(self.patterns.values(), key=lambda x: x[0])

    def drop(self, n: int, words: list[str]) -> None:
        fixed = tuple(i for i in self.span if words[i] != "<*>")
        _, pick, by_words = self.patterns[fixed]
        numbers = by_words[pick(words)]
        numbers.remove(n)
        if not numbers:
            del by_words[pick(words)]
        if not by_words:
            del self.patterns[fixed]
            self.order = sorted(self.patterns.values(), key=lambda x: x[0])


class Merger:
    """Templates one after the other in their order; holds the entries that others may fit."""

    def __init__(self):
        self.known: dict[tuple, tuple[list[list], tuple[_Half, _Half]]] = {}

    def add(self, fid, app: str, template: str, met: bool = True):
        """The canonical id. What is not ``met`` differs in two words or more from every other template, so as an entry none fits it
        and it is not kept."""
        words = template.split(" ")
        if len(words) < LEAST_WORDS:
            return fid
        middle = len(words) // 2
        group, halves = self.known.setdefault((app, len(words)), ([], (_Half(range(middle)), _Half(range(middle, len(words))))))
        best, places = len(group), None
        for half in halves:
            for first, pick, by_words in half.order:
                if first >= best:
                    break
                for n in by_words.get(pick(words), ()):
                    if n >= best:
                        break
                    entry = group[n][1]
                    apart = [i for i, (a, b) in enumerate(zip(entry, words, strict=True)) if a != b and a != "<*>"]
                    if len(apart) <= 1 and not any(w in DIRECTION or w.lower() in DIRECTION for i in apart for w in (entry[i], words[i])):
                        best, places = n, apart
                        break
        if places is None:
            if met:
                group.append([fid, words])
                for half in halves:
                    half.put(best, words)
            return fid
        for i in places:
            half = halves[i >= middle]
            half.drop(best, group[best][1])
            group[best][1][i] = "<*>"
            half.put(best, group[best][1])
        return group[best][0]

    def wild(self):
        """(id, words) of the entries that have a wildcard."""
        return [(fid, words) for group, _ in self.known.values() for fid, words in group if "<*>" in words]


def _hashed(rows: DataFrame) -> DataFrame:
    """Rows of (app, words) with the number ``n`` of words, a hash ``h`` of each word at its place and the places ``told`` of words that tell a
    direction: keys are made of these, in one pass over the words."""
    told = lambda w: F.lower(w).isin(*DIRECTION) | w.isin(*DIRECTION)
    hashes = F.transform("words", lambda w, i: F.xxhash64("app", F.size("words"), i, w))
    places = F.filter(F.transform("words", lambda w, i: F.when(told(w), i)), lambda i: i.isNotNull())
    return rows.withColumns({"n": F.size("words"), "h": hashes, "told": places})


def _pieces(rows: DataFrame, keep: str, entries: bool = False) -> DataFrame:
    """(``keep``, key): keys of the hashes ``h`` of (app, n, h, cuts) in ``cuts`` pieces of about equal length, of entries without those
    that have a place of ``free``; without cuts one key for all."""
    cut = rows.select(keep, "app", "n", "h", "cuts", *(["free"] if entries and keep != "free" else []), F.explode(F.sequence(F.lit(0), F.greatest(F.col("cuts") - 1, F.lit(0)))).alias("i"))
    bound = lambda i: F.when(F.col("cuts") > 0, F.floor(i * F.col("n") / F.greatest("cuts", F.lit(1)))).otherwise(0).cast("int")
    cut = cut.withColumns({"low": bound(F.col("i")), "high": bound(F.col("i") + 1)})
    cut = cut.filter(~F.exists("free", lambda f: (f >= F.col("low")) & (f < F.col("high")))) if entries else cut
    return cut.select(keep, F.xxhash64("app", "n", "cuts", "i", F.slice("h", F.col("low") + 1, F.col("high") - F.col("low"))).alias("key"))


def _but_one(free: Column) -> Column:
    """Keys of (app, n, h, told) without the places ``free``, and without each further one whose word tells no direction. Hashes are
    joined by exclusive or, so a place is left out by its own hash."""
    shown = F.transform("h", lambda x, i: F.when(F.array_contains(free, i), F.lit(0).cast("long")).otherwise(x))
    all_ = F.aggregate(shown, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    others = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: ~F.array_contains(free, j) & ~F.array_contains("told", j))
    key = lambda j, x: F.xxhash64("app", "n", free, j, x)
    return let(all_, lambda x: F.transform(F.concat(F.array(F.lit(-1)), others), lambda j: key(j, F.when(j < 0, x).otherwise(x.bitwiseXOR(F.get("h", F.greatest(j, F.lit(0))))))))


def merge_table(templates: DataFrame) -> DataFrame:
    """(format_id, canonical_id) of rows (id, app, t, first), as ``merge_templates`` has them.

    The order counts only among templates that can meet, so these are found first: those that differ in one word are linked, each
    component of links is merged by itself, and what its entries, with their wildcards, fit outside of it is linked as well, until they
    fit nothing more. A word that is a wildcard for an entry stays one, so what fits no final entry has never met it. Linked are
    templates that share one of so many pieces that one must be equal, then by keys that leave each place out, not by pairs; a
    collision of keys links too much and changes no result. A task reads one component in its order and holds the entries that others may fit;
    a component that no link has changed is not merged again.
    """
    import pyarrow as pa

    spark = templates.sparkSession
    ship(spark)
    at, step = scratch_dir(spark, "templates"), itertools.count()

    def save(rows: DataFrame) -> DataFrame:
        path = f"{at}/{next(step)}"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    base = save(templates.select(F.monotonically_increasing_id().alias("k"), "id", "app", "t", "first"))
    words = base.select("k", "app", F.split("t", " ").alias("words")).filter(F.size("words") >= LEAST_WORDS)
    long = save(_hashed(words).withColumn("wild", F.array_contains("words", "<*>")).drop("words"))

    def components(links: DataFrame) -> DataFrame:
        """(k, comp): the smallest node that a node of links (a, b) reaches."""
        both = save(links.union(links.select("b", "a")).distinct())
        found = save(both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("comp")))
        total = None
        while total != (total := found.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]):
            near = both.join(found.withColumnRenamed("k", "b"), "b").groupBy(F.col("a").alias("k")).agg(F.min("comp").alias("m"))
            near = save(found.join(near, "k").select("k", F.least("comp", "m").alias("comp")))
            jump = near.select(F.col("k").alias("comp"), F.col("comp").alias("m"))
            found = save(near.join(jump, "comp").select("k", F.col("m").alias("comp")))
        return found

    def merged(members: DataFrame) -> DataFrame:
        """(k, comp, into, words) of members: the node of its entry; an entry with a wildcard comes once more, with its words."""

        def run(batches):
            held, merger, out = None, Merger(), []

            def wild():
                return [(k, held, k, words) for k, words in merger.wild()]

            for batch in batches:
                for k, comp, app, t, met in zip(*[batch.column(c).to_pylist() for c in ("k", "comp", "app", "t", "met")], strict=True):
                    if comp != held:
                        out += wild()
                        held, merger = comp, Merger()
                    out.append((k, comp, merger.add(k, app, t, met), None))
                if len(out) > 10_000:
                    yield made(out)
                    out = []
            yield made(out + wild())

        def made(out):
            columns = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["k", "comp", "into", "words"])

        rows = members.join(base, "k").join(pairs.select("k", F.lit(True).alias("met")), "k", "left").select("k", "comp", "first", "id", "app", "t", F.coalesce("met", F.lit(False)).alias("met"))
        return rows.repartition("comp").sortWithinPartitions("comp", "first", "id", "k").mapInArrow(run, "k long, comp long, into long, words array<string>")

    pieces = _pieces(long.withColumn("cuts", F.lit(2)), "k")
    shared = pieces.groupBy("key").count().filter("count > 1")
    near = long.join(pieces.join(shared, "key").select("k").distinct(), "k", "left_semi")
    keys = save(near.select("k", F.explode(_but_one(F.array().cast("array<int>"))).alias("key")))
    least = keys.groupBy("key").agg(F.min("k").alias("b"), F.count("*").alias("n")).filter("n > 1")
    comps = components(keys.join(least, "key").filter("k <> b").select(F.col("k").alias("a"), "b"))
    literal = long.filter("wild").select("k", F.col("k").alias("comp")).join(comps, "k", "left_anti")
    comps = pairs = save(comps.unionByName(literal))
    now, old, changed = None, None, comps
    while True:
        fresh = save(merged(changed))
        grown = fresh.filter("words IS NOT NULL").join(base.select("k", "app"), "k").select("k", "comp", "app", "words")
        grown = grown.join(now.filter("words IS NOT NULL").select("k", "words"), ["k", "words"], "left_anti") if now is not None else grown
        now = save(old.unionByName(fresh)) if now is not None else fresh
        free = F.filter(F.transform("words", lambda w, i: F.when(w == "<*>", i)), lambda i: i.isNotNull())
        told = F.size(F.array_except("told", "free")) > 0
        least = F.least(F.get(F.filter(F.array(*map(F.lit, CUTS)), lambda c: c >= F.size("free") + 2), F.lit(0)), "n")  # null beyond the last is left out
        few = F.when(F.size("free") + 2 <= F.col("n"), least).when(told, F.col("n")).otherwise(0)
        new = save(_hashed(grown.withColumn("free", free)).withColumn("cuts", few))
        wide = new.filter("cuts = 0").groupBy("app", "n").agg(F.min("comp").alias("b"))  # has one word at most that is not a wildcard, so all can fit
        narrow = new.filter("cuts > 0")
        cut = _pieces(narrow, "free", entries=True).distinct()
        cut = F.broadcast(cut) if new.count() <= BROADCAST else cut  # else every piece of every template would be shuffled
        levels = narrow.select("app", "n", "cuts").distinct()
        some = _pieces(long.join(F.broadcast(levels), ["app", "n"]), "k")
        fits = some.join(cut, "key").select("k", "free").distinct().join(long, "k").select("k", F.explode(_but_one(F.col("free"))).alias("key"))
        owner = narrow.select("comp", F.explode(_but_one(F.col("free"))).alias("key")).groupBy("key").agg(F.min("comp").alias("b"))
        all_of = new.filter("cuts = 0").join(wide, ["app", "n"]).select("k", "b").union(long.join(F.broadcast(wide), ["app", "n"]).select("k", "b"))
        links = fits.join(owner, "key").select("k", "b").union(all_of).distinct().join(comps, "k", "left")
        links = save(links.select(F.coalesce("comp", "k").alias("a"), "b", "k").filter("a <> b"))
        if links.isEmpty():
            break
        roots = components(links.select("a", "b").distinct()).select(F.col("k").alias("comp"), F.col("comp").alias("root"))
        more = links.filter("k = a").select("k", F.col("k").alias("comp")).distinct().join(comps, "k", "left_anti")
        comps = save(comps.unionByName(more).join(roots, "comp", "left").select("k", F.coalesce("root", "comp").alias("comp"), F.col("root").isNotNull().alias("moved")))
        changed, comps = comps.filter("moved").select("k", "comp"), comps.select("k", "comp")
        old = now.join(roots, "comp", "left_anti").select("k", "comp", "into", "words")
    into = now.filter("into <> k").select("k", "into").join(base.select(F.col("k").alias("into"), F.col("id").alias("canonical")), "into")
    return base.join(into.select("k", "canonical"), "k", "left").select(F.col("id").alias("format_id"), F.coalesce("canonical", "id").alias("canonical_id"))
