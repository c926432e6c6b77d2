import pytest

import __spark_entry__ as e


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n in e.oracle_sql() if not n.startswith(("op", "det_", "pipeline"))))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = e.queries()[name](spark, "/root/testdata/sf0.001")
    cols = sorted(got.columns)
    value = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    rows = lambda x: sorted((tuple(map(value, r)) for r in x), key=repr)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({e.oracle_sql()[name]})").fetchall()
    assert rows(got.select(*[f"`{c}`" for c in cols]).collect()) == rows(want)
