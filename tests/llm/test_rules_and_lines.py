import hashlib

import duckdb
from pyspark.sql import functions as F

from sentrylake.llm import line_dedup, mixing, quality, queries

DOCS = "doc_id long, text string, lang string, source string, n_words string"
WORDS = " ".join(f"word{i}" for i in range(30))


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", "clash") for i, t in enumerate(texts)], DOCS)


def brute_repeats(text):
    w = text.split()
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    return len({p for i, x in enumerate(wins) if wins.count(x) > 1 for p in range(i, i + 8)})


def test_ledger_on_edge_cases(spark):
    texts = [None, "", "  \n\t", WORDS, WORDS + " " + WORDS, "a b " * 40, "x" * 50000, "É ß " * 30, "# " * 40, WORDS]
    got = {r.doc_id: r for r in quality.apply_policy(quality.ledger(rows(spark, texts))).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert got[i].n_words == len(words)
        assert got[i].n_repeat_words == brute_repeats(t or "")
        assert got[i].base_failed == (len(words) < 20 or 100 * got[i].n_repeat_words > 30 * len(words))
    assert got[3].kept and got[9].kept and not got[8].kept and not got[0].kept
    assert quality.ledger(rows(spark, texts).limit(0)).count() == 0


def test_filter_keeps_columns_and_agrees_with_ledger(spark):
    docs = rows(spark, [WORDS, None, "short", WORDS.upper()])
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns and [r.doc_id for r in out.collect()] == [0]


def test_ablation_counts(spark):
    led = quality.ledger(rows(spark, [WORDS, "short", "# " * 40, WORDS + " #" * 10]))
    got = {r.rule: (r.failed, r.only) for r in quality.ablation(led).collect()}
    assert got["symbols"] == (2, 1) and got["few_words"] == (1, 1)


def brute_lines(texts):
    keys = {}
    split = [(t or "").split("\n") for t in texts]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    for i, ls in enumerate(split):
        for x in ls:
            if len(key(x)) >= 20:
                keys.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(keys.get(key(x), ())) >= 3 and max(keys[key(x)]) != i
    return [[x for x in ls if not gone(i, x)] for i, ls in enumerate(split)]


def test_line_dedup(spark):
    line = "The same line of twenty code points and more"
    texts = [line, f"  {line.upper()}\t\nown line", f"{line}\n{line}", None, "", "short\nshort", f"a\n\n{line}\nb", "ÄÖÜ" * 10, "ÄÖÜ" * 10, "ÄÖÜ" * 10 + "\nz"]
    docs = rows(spark, texts)
    want = brute_lines(texts)
    for batches in (1, 3):
        got = {r.doc_id: r for r in line_dedup.dedup_table(docs, batches).collect()}
        for i, kept in enumerate(want):
            assert got[i].kept_text == "\n".join(kept)
            assert got[i].n_lines == len((texts[i] or "").split("\n")) and got[i].n_dropped == got[i].n_lines - len(kept)
    assert line_dedup.dedup_table(docs.limit(0)).count() == 0


def test_runs_are_compacted(spark):
    docs = rows(spark, [f"A line of more than twenty points {i % 3}" for i in range(12)])
    runs = line_dedup.Runs(spark, fanout=2)
    for b in range(5):
        runs.add(line_dedup.key_rows(docs.filter(F.col("doc_id") % 5 == b)))
    assert sum(r.count() for r in runs.all()) == 3  # runs share no key
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.last_doc for r in runs.repeated().collect()) == [9, 10, 11]


def test_batches_compact_their_runs_without_moving_them(spark):
    line_dedup_runs = line_dedup.Runs(spark)
    keys = line_dedup.key_rows(rows(spark, [f"A line of more than twenty points {i}" for i in range(12)]), line_dedup.BATCHES)
    for b in range(line_dedup.BATCHES):
        line_dedup_runs.add(keys.filter(F.col("batch") == b))
    assert line_dedup.BATCHES >= line_dedup.FANOUT**2 and [len(level) for level in line_dedup_runs.levels][:2] == [0, 0]
    plan = line_dedup_runs.all()[0].hint("merge").join(line_dedup_runs.again[0], ["h1", "h2"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_line_dedup_of_repeated_rows_null_ids_and_clashing_names(spark):
    line, far = "The same line of twenty code points and more", "x" * 200_000
    data = [(1, line, "a", 1), (1, line, "a", 1), (2, f"own\n{line}", "b", 2), (2, f"{line}\nother", "c", 3), (3, f"{line}\n{far}", "d", 4), (None, line, "e", 5), (None, f"x\n{line}", "f", 6), (None, None, "g", 7)]
    docs = spark.createDataFrame(data, "doc_id long, text string, _lines string, n_dropped int")
    got = sorted((r.doc_id or 0, r._lines, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_table(docs).collect())
    assert got == [(0, "e", 1, 1, ""), (0, "f", 2, 1, "x"), (0, "g", 1, 0, ""), (1, "a", 1, 1, ""), (1, "a", 1, 1, ""), (2, "b", 2, 1, "own"), (2, "c", 2, 1, "other"), (3, "d", 2, 0, f"{line}\n{far}")]


def test_oracles(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_words, n_repeat_words, fail_bits, kept FROM ({quality.SQL})").fetchall()}
    assert {r[0]: tuple(r[1:]) for r in quality.apply_policy(quality.ledger(docs)).select("doc_id", "n_words", "n_repeat_words", "fail_bits", "kept").collect()} == want
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({line_dedup.SQL})").fetchall()}
    got = line_dedup.dedup_table(docs).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == want


def brute_rake(cells, targets, rounds):
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for axis, name in enumerate(mixing.AXES):
            have = {}
            for k, v in w.items():
                have[k[axis]] = have.get(k[axis], 0) + v
            reach, total = sum(targets[name][c] for c in have), sum(w.values())
            w = {k: v * targets[name][k[axis]] / reach * total / have[k[axis]] for k, v in w.items()}
    return {k: w[k] / cells[k] for k in w}


def test_raking_meets_targets(spark):
    targets = {"source": {"a": 0.5, "b": 0.3, "other": 0.2}, "lang": {"en": 0.6, "other": 0.4}, "topic": {"prose": 0.7, "other": 0.3}}
    cells = {(s, lg, t): n for n, (s, lg, t) in enumerate([("a", "en", "prose"), ("a", "other", "other"), ("b", "en", "prose"), ("b", "other", "prose"), ("other", "en", "other"), ("other", "other", "prose")], 7)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, targets, 30).collect()}
    want = brute_rake(cells, targets, 30)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mix_probabilities_and_budget(spark):
    docs = rows(spark, [WORDS] * 200 + [None, ""])
    out = mixing.mix(docs).collect()
    assert len(out) == 202 and all(0 < r.p <= 1 for r in out)
    total = sum(r.n_tokens for r in out)
    assert sum(r.n_tokens * r.p for r in out) <= total * mixing.BUDGET + 1e-6
    assert {r.doc_id: r.sampled for r in out} == {r.doc_id: r.sampled for r in mixing.mix(docs).collect()}
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ("doc_id", "source", "lang", "topic", "n_tokens", "weight", "p", "expected", "copies", "sampled")
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({mixing.SQL})").fetchall())
    assert sorted(tuple(r) for r in queries.op5_mixing(spark, sf).select(*names).collect()) == want and len(want) > 100


def test_sampled_tokens_follow_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(docs).collect()
    for axis in mixing.AXES:
        have, due, got = {}, {}, {}
        for r in out:
            name = r[f"_{axis}"]
            for sums, tokens in ((have, r.n_tokens), (due, r.n_tokens * r.expected), (got, r.n_tokens * r.copies)):
                sums[name] = sums.get(name, 0) + tokens
        reach = sum(mixing.TARGETS[axis][k] for k, v in have.items() if v)
        for k in (k for k, v in have.items() if v):
            assert abs(due[k] / sum(due.values()) - mixing.TARGETS[axis][k] / reach) < 1e-3
            assert abs(got[k] / sum(got.values()) - mixing.TARGETS[axis][k] / reach) < 0.03
    assert all(abs(r.copies - r.expected) < 1 and r.sampled == (r.copies > 0) for r in out if r.n_tokens)
    rows = {r.doc_id: r["count"] for r in mixing.sample(docs).groupBy("doc_id").count().collect()}
    assert rows == {r.doc_id: r.copies for r in out if r.copies}
