import hashlib
import random
import zlib
from itertools import permutations
from pathlib import Path

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sentrylake.llm import filter_audit, merkle, queries, token_counts
from sentrylake.llm.shared import Shared

from ..conftest import DATA

JSON = public_tokenizers.path("byte_bpe_50k.json")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.load(Path(JSON).read_text(encoding="utf-8"))[0]


def theirs(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


ODD = ["a", "Don't", "'s", "'", "s", " ", "  ", "\n", "\t ", "\x1c", "\x85", "\xa0", " ", "​", "é", "漢字", "😀", "12345", "==", "!", "<|endoftext|>", "<|", "|>", "<|endof", "\x00", "ß", "é", "ͅ", "\r\n", "᠎"]


@settings(deadline=None, max_examples=300)
@given(parts=st.lists(st.sampled_from(ODD), max_size=40), extra=st.text(max_size=20))
def test_stretches_count_as_the_library_does(tokenizer, parts, extra):
    texts = ["".join(parts), extra, "".join(parts) + extra]
    assert token_counts.Counter(tokenizer).count(texts) == theirs(tokenizer, texts)


def hard_texts():
    rng = random.Random(5)
    yield from ("=" * 5000, "ab" * 2500, " " * 4000, "x" * 3001, "é" * 2000, "漢" * 1500, "\n" * 1000 + "a" + " " * 900, "<|endoftext|>" * 300, "word " * 900, "0123456789" * 300)
    for _ in range(60):
        yield "".join(rng.choices(ODD, k=rng.randint(100, 2500)))
    for _ in range(20):
        yield "".join(rng.choices("abcdefghij", k=3000))
        yield "".join(rng.choice(("abc", "=-=", "   ", "<|endoftext|>", "​", "ing")) * rng.randint(1, 200) for _ in range(20))


def test_chunks_are_spliced_as_the_library_counts(spark, tokenizer):
    texts = list(hard_texts())
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = dict(enumerate(theirs(tokenizer, texts)))
    for chunk, overlap in ((256, 64), (1000, 40)):
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_table(docs, JSON, huge=300, chunk=chunk, overlap=overlap).collect()}
        assert got == {i: (len(t.encode()), want[i]) for i, t in rows}


def test_overlaps_widen_where_tokens_never_meet(spark, tokenizer):
    shared = Shared(spark, "widen")
    texts = shared.save(spark.createDataFrame([(0, "a " * 400), (1, "=" * 3000)], "key long, text string"), "texts")
    raw = spark.sparkContext.broadcast(Path(JSON).read_text(encoding="utf-8"))
    first = token_counts.encoded(token_counts.cut(texts, 500, 50), raw, 500, 50)
    assert {r.key: r.failed for r in token_counts.spliced(shared.save(first, "first")).collect()} == {0: False, 1: True}
    got = {r.key: r.n_tokens for r in token_counts.huge_counts(texts, raw, shared, 500, 50).collect()}
    assert got == dict(enumerate(theirs(tokenizer, ["a " * 400, "=" * 3000])))


def test_token_counts_of_edge_cases(spark, tokenizer):
    rows = [(1, None, 5), (1, "twice", 6), (1, "twice", 6), (None, "no id", 7), (2, "", 8), (3, "long words here " * 20_000, 9), (4, "<|endoftext|>x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_table(docs, JSON).collect())
    counts = theirs(tokenizer, [r[1] or "" for r in rows])
    assert got == sorted((r[0] or 0, len((r[1] or "").encode()), n) for r, n in zip(rows, counts, strict=True))
    assert token_counts.count_table(docs.limit(0), JSON).count() == 0
    with pytest.raises(ValueError):
        token_counts.load(Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8"))


def test_op11_query_is_the_librarys(spark, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    want = sorted((r.doc_id, len((r.text or "").encode()), n, n > 1024) for r, n in zip(docs, theirs(tokenizer, [r.text or "" for r in docs]), strict=True))
    assert sorted(map(tuple, queries.op11_token_counts(spark, DATA).collect())) == want


def _h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def _leaf(r, more=0):
    values = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def _manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, text, lang, source, n_chars)."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in langs:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {k: _tree([_leaf(r) for r in by[k]]) for k in langs}
    top = _tree([trees[k][-1][0] for k in langs])
    for rank, k in enumerate(langs):
        for place, r in enumerate(by[k]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node, beside = _leaf(r, 1) if bad else _leaf(r), []
            for levels, at in ((trees[k], place), (top, rank)):
                for nodes in levels[:-1]:
                    run, i = nodes[at // 2 * 2 : at // 2 * 2 + 2], at % 2
                    beside += run[:i] + run[i + 1 :]
                    node, at = _h(*run[:i], node, *run[i + 1 :]), at // 2
            root = top[-1][0]
            yield r[0], _leaf(r), trees[k][-1][0], root, _h(*beside), node, node == root


def _saved(spark, tmp_path, rows, schema=DOC, **more):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    for name, (data, kind) in more.items():
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("stride", [1, 2, 3, 8])
def test_manifest_is_brute_forces(spark, tmp_path, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    rng = random.Random(stride)
    langs = [None, "", "-", "=", "en", "é", "z", "single"]
    rows = [(rng.choice([None, rng.randint(-5, 400)]) if i % 9 == 0 else i, rng.choice([None, "", "text é"]), rng.choices(langs, [9, 1, 2, 3, 60, 5, 8, 0])[0], rng.choice([None, "s"]), rng.choice([None, 7])) for i in range(150)]
    rows += [rows[3]] * 3 + [(9, "y" * 200_000, "single", "s", 2**63 - 1)]
    got = queries.op12_merkle_manifest(spark, _saved(spark, tmp_path, rows)).collect()
    assert _order(got) == _order(_manifest(rows))


def test_manifest_of_few_rows_and_clashing_names(spark, tmp_path):
    for i, rows in enumerate(([], [(1, "a", None, None, 2)], [(1, "a", "x", "s", 2), (2, "b", "x", "s", 2)], [(1, "a", "x", "s", 2), (1, "a", "y", "s", 2), (1, "a", None, "s", 2)])):
        where = tmp_path / str(i)
        got = queries.op12_merkle_manifest(spark, _saved(spark, where, [(*r, "0", 1, 2) for r in rows], DOC + ", node string, pos long, tree int")).collect()
        assert _order(got) == _order(_manifest(rows))


def test_tampering_with_any_field_is_found(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(20)]
    docs = spark.createDataFrame(rows, DOC)
    for field, other in (("text", F.concat("text", F.lit("."))), ("source", F.lit(None).cast("string")), ("doc_id", F.col("doc_id") + 1), ("lang", F.lit("de"))):
        out = merkle.verify(merkle.manifest(docs, tampered={field: F.when(F.col("doc_id") == 7, other).otherwise(F.col(field))}))
        assert [r.doc_id for r in out.collect() if not r.verified] == [7]
    assert all(r.verified for r in merkle.verify(merkle.manifest(docs)).collect())


def _audit(rows, labels):
    """The rows of op13 for (doc_id, text, lang, source, n_chars) and (doc_id, quality, toxic)."""
    big = lambda i: (i is None, i or 0)
    first = {}
    for r in rows:
        first[r[1] or ""] = min(first.get(r[1] or "", (True, 0)), big(r[0]))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    facts = []
    for d, text, _, source, _ in rows:
        x = text or ""
        words = [w for w in x.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in x) > 2 * len(x),
            "D": any(c in "#$%&*|" for c in x), "E": big(d) > first[x],
        }
        facts.append((source or "", {f for f, y in fails.items() if y}, d in good, d in toxic))
    shapley = {}
    for part in {f[0] for f in facts}:
        mine, out = [f for f in facts if f[0] == part], []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, order, step, len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone), f))
        yield from ((*x[:-1], shapley[part, x[-1]]) for x in out)


LONG = "word " * 150 + " ".join(map(str, range(300)))
TEXTS = [None, "", "a b c", LONG, LONG + "!", LONG[:-1] + "8", "A" + LONG[1:], "SHOUT " * 250, LONG + " 100%", "same " * 300, LONG * 3, "x" * 300_000, "x" * 299_999 + "y"]


@pytest.mark.parametrize("weak", [False, True])
def test_audit_is_brute_forces(spark, tmp_path, monkeypatch, weak):
    if weak:  # blocks that tell nothing apart: the full texts must
        monkeypatch.setattr(filter_audit, "_hash", lambda block: F.length(block).cast("long"))
        monkeypatch.setattr(filter_audit, "NAMED", 0)
    rng = random.Random(3)
    rows = [(None if i % 17 == 0 else i % 90, rng.choice(TEXTS), "en", rng.choice([None, "", "s1", "s2"]), 1) for i in range(120)]
    labels = [(rng.choice([None, i]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in range(100)] + [(5, 0, 1), (5, 1, 0)]
    at = _saved(spark, tmp_path, [(*r, 1, 2) for r in rows], DOC + ", bits int, quality int", labels=(labels, "doc_id long, quality int, toxic int"))
    got = queries.op13_filter_audit(spark, at)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == sorted(_audit(rows, labels))


def test_audit_of_no_documents(spark, tmp_path):
    at = _saved(spark, tmp_path, [], labels=([], "doc_id long, quality int, toxic int"))
    assert queries.op13_filter_audit(spark, at).count() == 0
