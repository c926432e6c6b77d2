import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sentrylake.llm import embed_dedup, ngram_join, substring
from sentrylake.llm.components import components
from sentrylake.llm.shared import Shared


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_join(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent, links = list(range(len(texts))), Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), links[i], find(parent, i)) for i, s in enumerate(sets)]


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = [None, "", " \n ", "One", "one", "one two", "a b c d", "A B C D", "a b c d e"]
    passage = " ".join(r.choice(words) for _ in range(40))
    for _ in range(n):
        kind = r.random()
        base = [r.choice(words) for _ in range(r.choice([6, 8, 10, 12, 15, 25, 60, 120]))]
        if kind < 0.5 and len(out) > 12:
            base = (r.choice(out[9:]) or "").split()
            for _ in range(r.randrange(4)):
                if base:
                    base[r.randrange(len(base))] = r.choice(words)
        text = " ".join(base)
        out.append(f"{text} {passage}" if kind > 0.85 else text)
    return out


@pytest.mark.parametrize(("size", "percent", "small"), [(4, 85, False), (5, 80, True)])
def test_join_equals_brute_force(spark, monkeypatch, size, percent, small):
    if small:  # frequent shingles, long lists and several chunks on few rows
        for name, value in (("FREQUENT", 4), ("LONGEST_LIST", 6), ("CHUNK_SETS", 5), ("ROUNDS", 2)):
            monkeypatch.setattr(ngram_join, name, value)
    texts = corpus(size)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_shingles string")
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.join(docs, size, percent).collect()}
    want = brute_join(texts, size, percent)
    assert got == dict(enumerate(want))


def test_join_when_ids_of_sets_clash():
    ids = ngram_join.Ids(frozenset([ngram_join._hash64(np.arange(3, dtype=np.uint64), 0)]))
    assert ids.of(np.arange(3, dtype=np.uint64)) == ids.second(np.arange(3, dtype=np.uint64)) != ngram_join.Ids().of(np.arange(3, dtype=np.uint64))


def test_clashing_sets_are_told_apart(spark):
    texts = corpus(11, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    from pyspark.sql import functions as F

    class Narrow(ngram_join.Ids):
        def of(self, s):
            first = int(s[0] % 8)
            return self.second(s) if first in self.clashes else first

    keep = ngram_join.Ids
    ngram_join.Ids = Narrow
    try:
        rows, sets, ids = ngram_join.classes_of(docs, 4, Shared(spark, "clash"))
        assert len(ids.clashes) > 4 and sets.count() == rows.agg(F.count_distinct("sid")).first()[0]
        got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.join(docs, 4, 85).collect()}
    finally:
        ngram_join.Ids = keep
    assert got == dict(enumerate(brute_join(texts, 4, 85)))


def test_join_of_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.n_links, r.component_id) for r in ngram_join.join(docs, 4, 85).collect()}
    assert got == {None: (3, 0, None), 3: (3, 0, 3), 4: (0, 0, 4)}
    assert ngram_join.join(docs.limit(0), 4, 85).count() == 0


def test_light_sets_meet_at_a_subset():
    t = ngram_join.Threshold(80)
    for n in range(1, 14):
        for m in range(n, t.largest(n) + 1):
            assert t.common(n, m) in t.subset_sizes(n, 99) and t.common(n, m) in t.subset_sizes(m, 99)
    assert t.boundary(1000.0) > t.boundary(0.5) >= 1


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (20, 20), *[(100, i) for i in range(101, 140)]]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Shared(spark, "cc")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8, **{i: 100 for i in range(100, 140)}}


def brute_substrings(texts, window):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("heavy", [256, 2])
def test_substrings_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring, "SHARD_WORDS", 500)
    r = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passages = [[r.choice(words) for _ in range(r.choice([19, 20, 21, 45]))] for _ in range(4)]
    texts = [None, "", "same " * 60, " ".join(words[:25]), " ".join(words[:25])]
    for _ in range(40):
        t = [r.choice(words) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(3)):
            t += r.choice(passages) + [r.choice(words)]
        texts.append(" ".join(t))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring.dedup(docs, heavy=heavy).collect()}
    assert got == dict(enumerate(brute_substrings(texts, 20)))
    assert substring.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("here", "heavy"), [(64, 2048), (2, 2048), (64, 3)])
def test_substrings_in_many_chunks_with_repeated_and_null_ids(spark, monkeypatch, here, heavy):
    for name, value in (("CHUNK", 6000), ("BUCKET", 9000), ("HEAVY_HERE", here), ("SHARD_WORDS", 400)):
        monkeypatch.setattr(substring, name, value)
    r = random.Random(here + heavy)
    words = [f"w{i}" for i in range(200)]
    common = [r.choice(words) for _ in range(24)]
    rows = []
    for i in range(150):
        t = [r.choice(words) for _ in range(r.randrange(5, 40))]
        if i % 2:
            t += [*common[: r.choice([20, 22, 24])], r.choice(words), *common]
        if i % 7 == 0:
            t += ["tick", "tock"] * 15
        rows.append((None if i % 50 == 3 else i // 2 if i % 11 == 0 else 200 - i, " ".join(t), 1))
    rows += [(500, "many words " * 20000 + "\u00e9\u00e8 \x00 " * 30, 1), (501, None, 1), (502, "", 1), rows[5], rows[5]]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_words int").coalesce(1)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substring.dedup(docs, heavy=heavy).collect())
    with_id = sorted((x for x in rows if x[0] is not None), key=lambda x: x[0])  # stable
    want = [(False, x[0], *b) for x, b in zip(with_id, brute_substrings([x[1] for x in with_id], 20))]
    want += [(True, 0, *brute_substrings([x[1]], 99999999)[0]) for x in rows if x[0] is None]
    assert got == sorted(want)


def test_index_matches_plain_search():
    r = np.random.default_rng(1)
    seq = np.concatenate([[*r.integers(1, 6, 30), 0] for _ in range(5)]).astype(np.int64)
    index = substring.FMIndex(seq, 4)
    patterns = r.integers(1, 6, (50, 4))
    matched, lo, hi = index.search(patterns)
    for p, m, a, b in zip(patterns, matched, lo, hi, strict=True):
        found = lambda q: sum(list(seq[i : i + len(q)]) == list(q) for i in range(len(seq) - len(q) + 1))
        longest = max((k for k in range(5) if k == 0 or found(p[4 - k :])), default=0)
        assert m == longest
        if m == 4:
            assert b - a == found(p)


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CHUNK", 8)
    monkeypatch.setattr(embed_dedup, "CELL_VECTORS", 4)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 16))
    rows = []
    for i in range(150):
        v = centres[i % 12] + r.normal(size=16) * r.choice([0.05, 0.15, 0.6])
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2), "x"))
    rows += [(150 + k, rows[3][1], 1, "x") for k in range(5)]
    rows += [(200, None, 1, "x"), (201, [0.0] * 16, 1, "x"), (202, [float("nan")] * 16, 1, "x"), (203, rows[0][1], None, "x"), (204, [None] * 16, 0, "x"), (205, [1.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")
    parent, links = {x[0]: x[0] for x in rows}, Counter()
    for a in rows[:155]:
        for b in rows[:155]:
            if a[0] < b[0] and a[2] == b[2]:
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    p, q = find(parent, a[0]), find(parent, b[0])
                    parent[max(p, q)] = min(p, q)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embed_dedup.dedup(df).collect()}
    assert sum(links.values()) > 50
    assert got == {i: (links[i], find(parent, i), find(parent, i) == i) for i in parent}
    assert embed_dedup.dedup(df.limit(0)).count() == 0


def test_traversal_is_sorted_and_agrees_with_the_staircase():
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 8))
    x /= np.sqrt((x * x).sum(1))[:, None]
    index = embed_dedup.MultiIndex(x, 5)
    _, bounds = index.look(x)
    row, cell = index.visits(bounds, 0.3)
    for i in range(10):
        walked = list(embed_dedup.traverse(bounds[0][i], bounds[1][i]))
        assert [w[0] for w in walked] == sorted(w[0] for w in walked) and len(walked) == index.cells
        assert {a * len(index.books[1]) + b for d, a, b in walked if d <= 0.3} == set(cell[row == i].tolist())


def test_embeddings_of_other_lengths_link_too(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_VECTORS", 2)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6)], 1) for i in range(40)]
    for k, d in enumerate((1, 2, 5, 7, 30, 30)):
        v = r.normal(size=d)
        rows += [(100 + 3 * k + j, [float(x) for x in v * (1 + j) + r.normal(size=d) * 0.01], 1) for j in range(3)]
    rows += [(None, rows[0][1], 1), (7, rows[0][1], 1), (7, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.dedup(df).collect())
    want = Counter()
    for i, v, _ in rows:
        near = [j for n, (j, w, _) in enumerate(rows) if i is not None and j is not None and len(w) == len(v) and rows[n] is not next(x for x in rows if x[1] is v and x[0] == i) and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.98]
        want[(i, len(near), min([i, *near]) if i is not None else None)] += 1
    assert got == want


def test_embeddings_with_huge_and_tiny_norms(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CELL_VECTORS", 2)
    r = np.random.default_rng(8)
    rows = []
    for i in range(40):
        v = r.normal(size=8)
        rows += [(2 * i, [float(x) for x in v], 1), (2 * i + 1, [float(x) for x in v * 3 + r.normal(size=8) * 0.01], 1)]
    rows += [(100, [1e-200] * 8, 2), (101, [1e200] * 8, 2), (102, [5e-324] * 8, 2), (103, [1e308, *[0.0] * 7], 2), (104, [1e-300, *[0.0] * 7], 2), (105, rows[0][1], 2)]
    rows += [(106, [49.0, 0.0], 3), (107, [0.98 * 49.0, (1 - 0.98**2) ** 0.5 * 49.0], 3), (108, [0.97, (1 - 0.97**2) ** 0.5], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in embed_dedup.dedup(df).collect()}
    assert all(got[2 * i] == got[2 * i + 1] == (1, 2 * i) for i in range(40))
    assert [got[i] for i in (100, 101, 102)] == [(2, 100)] * 3 and got[103] == got[104] == (1, 103) and got[105] == (0, 105)
    cosine = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
    assert got[106][0] == int(cosine(rows[-3][1], rows[-2][1]) >= 0.98) and got[108][0] == int(cosine(rows[-1][1], rows[-2][1]) >= 0.98)
