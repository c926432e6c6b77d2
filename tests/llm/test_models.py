import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import chunks, langid, lm
from sentrylake.llm.queries import remainder
from sentrylake.llm.words import LOWER

SF = "/root/testdata/sf0.001"


def test_remainder(spark):
    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", remainder(10).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 10 for r in got)


def brute_model(texts, held):
    """Split texts, the counts of n-grams, and p(context, word), by dictionaries and the recursion of the module's formula."""
    split = [[*(t or "").encode().translate(LOWER).split(), b" end"] for t in texts]
    c = Counter(tuple(t[i : i + n]) for t, h in zip(split, held) if not h for n in (1, 2, 3) for i in range(len(t) - n + 1))
    n, v = sum(x for k, x in c.items() if len(k) == 1), sum(len(k) == 1 for k in c)

    def p(context, w):
        if not context:
            return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        return (c[(*context, w)] + lm.PRIOR * p(context[1:], w)) / (c[context] + lm.PRIOR)

    return split, c, n, p


def brute_scores(texts, held):
    """(n_tokens, n_known, N, base, score) of each text."""
    split, c, n, p = brute_model(texts, held)
    out = []
    for t in split:
        score = sum(math.log10(p(tuple(t[max(0, i - 2) : i]), w)) for i, w in enumerate(t))
        out.append((len(t), sum(c[(w,)] > 0 for w in t), n, sum(math.log10(p((), w)) for w in t), score))
    return out


def check_scores(docs, held_out, keep=("doc_id",)):
    rows = docs.withColumn("_held", held_out).collect()
    want = sorted((r.doc_id is None, r.doc_id or 0, r._held, *x) for r, x in zip(rows, brute_scores([r.text for r in rows], [r._held for r in rows])))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score_table(docs, held_out, keep).collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:6] == w[:6] and g[6:] == pytest.approx(w[6:], rel=1e-9)


def test_scores_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit("x").alias("score"))
    docs = docs.unionByName(spark.createDataFrame([(100000, None, "x"), (100001, "", "x"), (100002, "neverseen words neverseen", "x")], docs.schema))
    check_scores(docs, remainder(10) == 0)
    got = lm.score_table(docs, remainder(10) == 0).filter("not held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_in_many_chunks_with_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 1 << 14)
    monkeypatch.setattr(lm, "BUCKET", 1 << 15)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    more = [(None, "a text without an id"), (None, "a text without an id"), (7, "seven again"), (8, "word " * 30000), (9, "w" * 200000 + " B\u00c9\u00e9 b")]
    check_scores(docs.limit(60).unionByName(spark.createDataFrame(more, docs.schema)), F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)))


def test_probabilities_of_each_state_sum_to_one():
    _, c, _, p = brute_model(["a b c a b c", "a b d", "b c a b", "c c c a b c"] * 3, [False] * 12)
    contexts = [k for k in c if len(k) < 3 and b" end" not in k]
    assert len(contexts) > 8
    for context in [(), *contexts, (b"neverseen", b"a")]:
        assert sum(p(context, w) for w in [b"a", b"b", b"c", b"d", b" end", b"neverseen"]) == pytest.approx(1, abs=1e-12)


def test_packing_of_keys_and_numbers():
    rng = np.random.default_rng(3)
    top = np.iinfo(np.int64)
    for k in (np.array([5], np.uint64), np.array([0, 2**64 - 1], np.uint64), np.unique(rng.integers(0, 2**64, 1000, np.uint64)), np.array([2**63] * 3 + [2**63 + 9], np.uint64), np.zeros(0, np.uint64)):
        assert (chunks.unpack_keys(chunks.pack_keys(k), len(k)) == k).all()
    for v in (np.array([-5, 7, 7]), np.array([top.min, top.max]), np.array([3]), np.array([3, 3]), np.zeros(0, np.int64)):
        assert (chunks.unpack_numbers(chunks.pack_numbers(v), len(v)) == v).all()
    c = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert (chunks.unpack_counts(chunks.pack_counts(c), len(c)) == c).all()


def test_scoring_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_table(docs, F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in got)
    assert lm.score_table(docs.limit(0), F.lit(False)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    trees = langid.train(docs, remainder(4) != 2)
    got = langid.predict(docs.withColumn("held_out", remainder(4) == 2), trees, ("doc_id", "held_out", "lang")).filter("held_out").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !? 34", None), (4, "the house and the tree", "en"), (5, "das haus und der baum", "de"), (6, "É" * 4000, "de")], "doc_id long, text string, lang string")
    trees = langid.train(docs, F.col("doc_id") > 0)
    got = {r.doc_id: r for r in langid.predict(docs, trees).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred == "en" and got[5].lang_pred == "de" and got[6].lang_pred == "de"
    none = langid.train(docs.filter("doc_id < 0"), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), trees).count() == 0


def test_code_lengths_are_probabilities():
    trees = langid.Trees({"a": [b"abracadabra", b"hello"], "b": [b"xyz"]})
    assert np.allclose(np.exp2(-trees.bits.astype(np.float64)).sum(2), 1, atol=1e-4)
    x = np.frombuffer(b"abhello", np.uint8)
    both = trees.code_lengths(x, np.array([0, 2]))
    one = [trees.code_lengths(np.frombuffer(t, np.uint8), np.array([0]))[:, 0] for t in (b"ab", b"hello")]
    assert np.allclose(both, np.stack(one, 1))


def test_a_rare_run_of_words_counts_in_a_large_corpus(spark):
    texts = ["a " * 40000] * 30 + ["left right turn"] * 2 + ["left right turn a a neverseen right turn a", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_scores(docs, F.col("doc_id") >= 32)


def brute_bits(train, text):
    """Bits of a text under one language, by contexts in dictionaries: method C with exclusion, orders 2, 1, 0, then all bytes alike."""
    def folded(t):
        out, raw = [], t.encode()
        for i, b in enumerate(raw):
            b = b + 32 if 65 <= b <= 90 or (i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E) else 32 if 9 <= b <= 13 else b
            out.append(b)
        return out

    counts = Counter()
    for t in train:
        x = [32, 32, *folded(t)]
        for i in range(2, len(x)):
            for n in (2, 1, 0):
                counts[(tuple(x[i - n : i]), x[i])] += 1
    bits, x = 0.0, [32, 32, *folded(text)]
    for i in range(2, len(x)):
        p, gone = 1.0, set()
        for n in (2, 1, 0):
            here = {b: c for (context, b), c in counts.items() if context == tuple(x[i - n : i]) and b not in gone}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if x[i] in here:
                p *= here[x[i]] / total
                break
            p *= len(here) / total
            gone |= here.keys()
        else:
            p /= 256 - len(gone)
        bits -= math.log2(p)
    return bits


def test_language_equals_brute_force(spark):
    train = {"en": ["the house and the tree", "a dog"], "de": ["das Haus und der Baum", "ein Hund \u00c4\u00d6"], "fr": ["la maison et l'arbre \u00e9"]}
    texts = ["the dog", "der Hund", "une maison", "\u00c9\u00e9 z", "q" * 50, "das the la", "the dog", "1 a"]
    docs = spark.createDataFrame([(i, t, lang, "n") for i, (lang, t) in enumerate((k, t) for k, v in train.items() for t in v)] + [(100 + i, t, None, "n") for i, t in enumerate(texts)], "doc_id long, text string, lang string, lang_pred string")
    trees = langid.train(docs, F.col("doc_id") < 100)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, trees).collect()}
    for i, t in enumerate(texts):
        bits = {k: brute_bits(v, t) for k, v in train.items()}
        best = min(sorted(bits), key=bits.get)
        assert got[100 + i][0] == best
        assert got[100 + i][1] == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel=1e-3)
