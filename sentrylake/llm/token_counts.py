"""Token counts of whole texts, huge ones in overlapping chunks.

A text of more than HUGE code points is cut into chunks that overlap; every chunk is encoded on its own, by any task, and tells its tokens at
the borders. Two neighbours are spliced at the first place of their overlap where both are known to say what the whole text says:

- a border between two pieces of the tokenizer's pattern that both chunks have. The pattern reads from left to right and looks back at
  nothing, so what follows such a border depends on what follows it alone.
- in an overlap that is all within one piece, the end of a token that both chunks have. Byte pairs are merged so that tokens are an encoding
  exactly if each two neighbours are one; here every two neighbours stand side by side in one of the chunks.

The last code points of a chunk are not trusted, as the pattern looks ahead and a special token may be cut. Where a text has an overlap
without such a place, its overlaps (and, with them, its chunks) are widened and it is done again, at last as one chunk.

Other texts are counted piece by piece: a border between a character and white space is one in every context, so a stretch from one to
the next has the same tokens wherever it stands, and repeated stretches are looked up (about CACHE are kept).

A null text is an empty one and has no tokens. Rows are counted one by one, so repeated rows and null ids are no matter; an empty table
gives an empty one; columns of the input that are not kept are not looked at.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Shared, ship
from .words import slices

#: Code points: texts up to HUGE are counted whole; chunks and overlaps of the others, and how much wider overlaps get each time.
HUGE, CHUNK, OVERLAP, WIDER = 32_768, 16_384, 256, 8
#: Stretches whose counts a task keeps, of so many code points at most, before it starts anew.
CACHE, CACHE_CHARS = 500_000, 64
#: Texts that are done again: so many keys at most are told to every task, more are met by an exchange.
NAMED = 50_000
#: A mark is a place and, for the end of a token, its id, in one number.
_ID_BITS = 21
#: From white space that follows a character to the next such place. White space is told by ASCII alone; where a stretch has other
#: white space it goes on, as that is not white space to every library.
_STRETCH = re.compile(r"\s*\S+(?:[^\S \t\n\r\x0b\x0c]\s*\S*)*|\s+")
_CHUNK = "key long, chunk long, last boolean, n long, marks0 array<long>, drops0 array<long>, marks1 array<long>, drops1 array<long>"
_LONGS = pa.list_(pa.int64())
_ARROW = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("n", pa.int64()), *((f"{c}{i}", _LONGS) for i in (0, 1) for c in ("marks", "drops"))])


def load(raw: str):
    """The tokenizer of a ``tokenizers`` file, and how many code points at a chunk's end are not trusted."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made, said = Tokenizer.from_str(raw), json.loads(raw)
    model, cut, added = said["model"], said["pre_tokenizer"] or {}, said["added_tokens"]
    if not (
        model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and said["normalizer"] is None
        and cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True) and len(model["vocab"]) < 1 << _ID_BITS - 1
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or re.search(r"\s", a["content"]) for a in added)
    ):
        raise ValueError("chunks can be spliced for byte-level BPE with the usual pattern and plain special tokens only")
    made.no_truncation()
    made.no_padding()
    return made, max([len(a["content"]) for a in added], default=0) + 8


class Counter:
    """Counts of texts, by stretches."""

    def __init__(self, tokenizer):
        self.tokenizer, self.known = tokenizer, {}

    def count(self, texts: list[str]) -> list[int]:
        cut = list(map(_STRETCH.findall, texts))
        new = list({s for ss in cut for s in ss}.difference(self.known))
        self.known.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        out = [sum(map(self.known.__getitem__, ss)) for ss in cut]
        for s in new:
            if len(s) > CACHE_CHARS:
                del self.known[s]
        if len(self.known) > CACHE:
            self.known.clear()
        return out


def marks(encoding, start: int, lo: int, hi: int, side: int) -> tuple[list[int], list[int]]:
    """Where the chunk that begins at ``start`` could be spliced, from place ``lo`` of the text to ``hi``, and how many tokens a splice there
    drops: those after it (side 0, the chunk before the border) or those before it (side 1, the one behind)."""
    at, piece, ids, n = encoding.offsets, encoding.word_ids, encoding.ids, len(encoding)
    lo, hi = lo - start, hi - start
    first, last = bisect_left(at, (lo, -1)), bisect_left(at, (hi + 1, -1))
    found = [(at[i][0], 0, i) for i in range(first, last) if i == 0 or piece[i] != piece[i - 1]]
    if all(place == lo for place, _, _ in found):  # one piece: ends of tokens that no code point is shared with
        whole = [i for i in range(first, last) if (i == 0 or at[i - 1][1] <= at[i][0]) and (i + 1 == n or at[i][1] <= at[i + 1][0])]
        found += [(at[i][1], ids[i] + 1, i + 1) for i in whole if at[i][1] <= hi]
    return [(place + start) << _ID_BITS | token for place, token, _ in found], [n - i if side == 0 else i for _, _, i in found]


def cut(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, chunk, last, text) of every text; the last one of a text reaches beyond the overlap that it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                count = max(1, -(-(len(text) - overlap) // chunk))
                for i in range(count):
                    part = text[i * chunk : (i + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([i]), pa.array([i + 1 == count]), pa.array([part], pa.string())], names=["key", "chunk", "last", "text"])

    return texts.select("key", "text").mapInArrow(run, "key long, chunk long, last boolean, text string")


def encoded(chunks: DataFrame, raw, chunk: int, overlap: int) -> DataFrame:
    """The number of tokens of every chunk, and its marks in the overlap before it and in that behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, margin = load(raw.value)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                rows = []
                found = tokenizer.encode_batch(part.column("text").to_pylist(), add_special_tokens=False)
                for key, i, last, e in zip(*(part.column(c).to_pylist() for c in ("key", "chunk", "last")), found, strict=True):
                    start, end = i * chunk, (i + 1) * chunk
                    behind = ([], []) if last else marks(e, start, end, end + overlap - margin, 0)
                    before = marks(e, start, start, start + overlap - margin, 1) if i else ([], [])
                    rows.append((key, i, last, len(e), *behind, *before))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    return chunks.mapInArrow(run, _CHUNK)


def spliced(chunks: DataFrame) -> DataFrame:
    """(key, n_tokens, failed): the tokens of each text, and whether some border of it has no place to splice."""
    left = chunks.filter("NOT last").select("key", "chunk", "marks0", "drops0")
    right = chunks.filter("chunk > 0").select("key", (F.col("chunk") - 1).alias("chunk"), "marks1", "drops1")
    both = left.join(right, ["key", "chunk"]).withColumn("at", F.array_min(F.array_intersect("marks0", "marks1")))

    def dropped(side: int) -> Column:
        return F.get(F.col(f"drops{side}"), (F.array_position(f"marks{side}", F.col("at")) - 1).cast("int"))

    borders = both.select("key", (-(dropped(0) + dropped(1))).alias("n"), F.col("at").isNull().alias("failed"))
    rows = chunks.select("key", "n", F.lit(False).alias("failed")).unionByName(borders)
    return rows.groupBy("key").agg(F.sum("n").alias("n_tokens"), F.max("failed").alias("failed"))


def huge_counts(texts: DataFrame, raw, shared: Shared, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of written (key, text). Texts with a failed border are done again with wider overlaps."""
    done, left = [], texts
    while True:
        chunks = cut(left, chunk, overlap).repartition("key", "chunk")
        counts = shared.save(spliced(shared.save(encoded(chunks, raw, chunk, overlap), "chunks")), "counts")
        done.append(counts.filter("NOT failed").select("key", "n_tokens"))
        again = counts.filter("failed").select("key")
        n = again.count()
        if not n:
            break
        left = texts.join(F.broadcast(again) if n <= NAMED else again.hint("merge"), "key", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def count_table(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructType

    spark = docs.sparkSession
    ship(spark)
    text = Path(path).read_text(encoding="utf-8")
    load(text)  # tells on the driver what cannot be spliced
    raw = spark.sparkContext.broadcast(text)  # a vocabulary has a fixed size
    one = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("_text"))
    is_huge = F.length("_text") > huge
    schema = StructType([*(one.schema[c] for c in keep)]).add("n_bytes", LongType()).add("n_tokens", LongType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load(raw.value)[0])
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                texts = part.column("_text").to_pylist()
                made = [part.column(c) for c in keep] + [part.column("_bytes"), pa.array(counter.count(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(made, arrow, strict=True)], schema=arrow)

    n_bytes = F.octet_length("_text").cast("long")
    counted = one.filter(~is_huge).withColumn("_bytes", n_bytes).mapInArrow(run, schema)
    shared = Shared(spark, "tokens")
    rows = one.filter(is_huge).select(F.struct(*keep, n_bytes.alias("n_bytes")).alias("row"), F.monotonically_increasing_id().alias("key"), F.col("_text").alias("text"))
    rows = shared.save(rows, "huge")
    long = rows.select("row", "key").join(huge_counts(rows.select("key", "text"), raw, shared, chunk, overlap), "key")
    return counted.unionByName(long.select("row.*", "n_tokens"))
