import hashlib

import duckdb
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sentrylake.llm import bpe, mixing, quality
from tests.llm.test_duplicates import brute_join
from tests.llm.test_rules_and_lines import brute_lines

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    keep = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.SQL}) WHERE kept").fetchall()}
    want = {r.doc_id: r.text for r in docs.collect() if r.doc_id in keep}
    for i, (name, stage) in enumerate(cp.STAGES[:4]):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert docs.columns == names
        got = {r.doc_id: r.text for r in docs.collect()}
        ids = sorted(want)
        if name == "line_dedup":
            lines = dict(zip(ids, brute_lines([want[k] for k in ids]), strict=True))
            text = {k: "\n".join(v) for k, v in lines.items()}
            want = {k: t for k, t in text.items() if t == want[k] or t.strip(" \t\n\x0b\x0c\r")}
        elif name == "ngram_jaccard_join":
            groups = brute_join([want[k] for k in ids], cp.SHINGLE, cp.SIMILAR)
            want = {k: want[k] for k, (_, _, c) in zip(ids, groups, strict=True) if ids[c] == k}
        elif name == "mixing":
            sampled = {r.doc_id for r in mixing.mix(spark.read.parquet(f"{tmp_path}/{i - 1}")).collect() if r.sampled}
            assert 0 < len(sampled) < len(want)
            want = {k: want[k] for k in sampled}
        assert got == want
    last = {r.doc_id: r for r in cp.STAGES[4][1](spark, docs, SF).collect()}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert last.keys() == want.keys()
    for k, text in want.items():
        ids = enc.encode_ordinary(text)
        assert (last[k].n_tokens, last[k].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert {r.doc_id for r in cp.run(spark, SF).collect()} == want.keys()


def test_stages_with_clashing_names_nulls_and_empty_tables(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = spark.createDataFrame([(None, None, None, None, None), (None, "a text without an id", "en", "src0", 20), (90001, None, None, None, None), (90002, "", "en", None, 0), (90003, "word " * 100_000, "xx", "src1", 500_000)], base.schema)
    docs = base.unionByName(more)
    clashing = ("n_dropped", "n_lines", "kept_text", "n_tokens", "copies", "row", "_row", "component_id", "fail_bits", "p")
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clashing)])
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for i, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, now, SF)
            if i < 4:
                assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{empty}{i}")
            now = spark.read.parquet(f"{tmp_path}/{empty}{i}")
        assert (now.count() == 0) == empty
