import re

import pytest
from pyspark.sql import functions as F

from sentrylake.operators import postings, search

TEXTS = [
    (1, "Über den Fluss", "ann"), (2, "uber allem, uber den Dächern", None), (3, "den uber", "den ub"), (4, None, None), (5, "", "x"), (6, "a b a b a", "b"), (7, "deny tcp 10.0.0.1 -> 10.0.0.2", "ube"),
    (7, "deny udp", "again"),
]
TERMS = ["den ub", "uber", "den", "a b a", "b", "u", "10 0 0 1", "tcp 10", "zzz", "", "uber den d", "deny", "DÄCH"]


@pytest.fixture
def index(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, "event_id long, raw_text string, user string")
    for batch in (0, 1):
        postings.add(df.filter(F.col("event_id") % 2 == batch), f"file://{tmp_path}/i", batch, ("raw_text", "user"))
    postings.add(df.filter("event_id % 2 = 1"), f"file://{tmp_path}/i", 1, ("raw_text", "user"))
    return postings.opened(spark, f"file://{tmp_path}/i")


def plain(text):
    folded = (text or "").lower().translate(str.maketrans("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))
    return [w for w in re.split(r"[\W_]+", folded) if w]


def hit(text, term):
    have, want = plain(text), plain(term)
    return bool(want) and any(have[i : i + len(want) - 1] == want[:-1] and have[i + len(want) - 1].startswith(want[-1]) for i in range(len(have) - len(want) + 1))


@pytest.mark.parametrize("term", TERMS)
def test_terms_match_as_plain_search_does(spark, index, term):
    for fields, columns in ((None, (1, 2)), ((0,), (1,)), ((1,), (2,))):
        want = sorted({r[0] for r in TEXTS if any(hit(r[c], term) for c in columns)})
        assert sorted(r.key for r in postings.match(index, term, fields).collect()) == want
    assert sorted(r[0] for r in search.match(search.index(spark.createDataFrame(TEXTS, "event_id long, raw_text string, u string")), term).collect()) == sorted({r[0] for r in TEXTS if hit(r[1], term)})


def test_a_search_reads_the_buckets_of_its_words_alone(index):
    plan = postings.match(index, "den ub")._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\], ReadSchema", plan)
    assert "bucket" in filters[1] and "EqualTo(word,den)" in filters[2] and "StringStartsWith(word,ub)" in filters[2]


def test_compacted_postings_say_the_same(spark, index, tmp_path):
    postings.compact(spark, f"file://{tmp_path}/i", f"file://{tmp_path}/j")
    small = postings.opened(spark, f"file://{tmp_path}/j")
    assert sorted(map(tuple, small.drop("batch").collect())) == sorted(map(tuple, index.drop("batch").collect()))


def test_events_of_a_term_by_either_join(spark, index, monkeypatch):
    df = spark.createDataFrame(TEXTS, "event_id long, raw_text string, user string")
    want = sorted(r.event_id for r in postings.events_of(df, index, "uber").collect())
    monkeypatch.setattr(postings, "NAMED", 0)
    assert sorted(r.event_id for r in postings.events_of(df, index, "uber").collect()) == want == [1, 2, 3]
