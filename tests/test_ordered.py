import random

from pyspark.sql import functions as F

from sentrylake.operators import ordered


def rows(n=300):
    rng = random.Random(2)
    return [(i, rng.choice([None, "a", "b"]), rng.randint(-3, 3)) for i in sorted(rng.sample(range(5000), n))]


def test_numbers_neighbours_and_sums_equal_one_pass(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, name string, v long").repartition(5)
    for width in (1, 7, 1000, 10_000):
        block = F.floor(F.col("id") / width)
        got = {r.id: r.n for r in ordered.numbered(df, block, ["id"]).collect()}
        assert got == {x[0]: i for i, x in enumerate(data, 1)}
        was = {r.id: (r.was, r.last) for r in ordered.with_previous(df, block, "id", {"was": F.col("name"), "last": F.col("id")}).collect()}
        assert was == {x[0]: (b[1], b[0]) if b else (None, None) for x, b in zip(data, [None, *data], strict=False)}
        total, want = 0, {}
        for i, _, v in data:
            want[i] = total = total + v
        assert {r.id: r.s for r in ordered.running_sum(df, block, "id", "v", "s").collect()} == want
    assert ordered.numbered(df.limit(0), F.col("id"), ["id"]).count() == 0


def test_ties_within_a_block_and_no_window_over_all_rows(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "t long, x string")
    got = ordered.numbered(df, F.col("t"), ["t", "x"])
    assert sorted((r.n, r.x) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "c")]
