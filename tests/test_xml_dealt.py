from pyspark.sql import functions as F

from sentrylake.functions import formats as fm
from sentrylake.functions import xml_folds


def test_documents_of_one_row_group_are_scanned_in_many_tasks(spark):
    import __spark_entry__ as e

    got = e.queries()["prj_11_paths"](spark, "/root/testdata/sf0.001")
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_a_value_that_is_called_like_the_name_attribute_is_no_name():
    got = xml_folds.pairs('<r><a k="Name" Name="x">v</a><b name="Name">w</b></r>')
    assert [tuple(p.values()) for p in got] == [("x.k", "Name"), ("x", "v"), ("Name", "w")]


def test_refused_documents_leave_nothing_behind_in_a_batch(spark):
    texts = ["<r><a>1</a></r>", "<r><a>2</a><b>", None, "", "<r/>", "<!DOCTYPE r><r><a>3</a></r>", "<r><a>4</a></r>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    got = {r.i: r.p and [tuple(x) for x in r.p] for r in df.select("i", fm.xml_paths(F.col("t")).alias("p")).collect()}
    assert got == {0: [("a", "1")], 1: None, 2: None, 3: None, 4: None, 5: None, 6: [("a", "4")]}
