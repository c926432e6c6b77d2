import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sentrylake.llm import bpe, warc
from sentrylake.llm.shared import Shared

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def theirs(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.tables.ranks, special_tokens={})


@settings(deadline=None, max_examples=150)
@given(text=st.one_of(st.text(max_size=80), st.text("abcdeth .'\n01", max_size=120), st.sampled_from(["", "=" * 200, "ab" * 90, "\x00\x01", "<|endoftext|>"])))
def test_encoding_is_the_librarys(encoder, theirs, text):
    ids = encoder.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()
    assert next(iter(encoder.written([text]))) == (" ".join(map(str, ids)), text.encode())


@settings(deadline=None, max_examples=80)
@given(base=st.binary(min_size=1, max_size=60), new=st.binary(max_size=5), at=st.integers(0, 59), gone=st.integers(0, 4))
def test_edits_and_appends_are_exact(encoder, base, new, at, gone):
    at = min(at, len(base))
    row = bpe.Prefixes(encoder.tables, base)
    row.replace(at, min(len(base), at + gone), new)
    row.append(b" more")
    assert row.last == bpe.Prefixes(encoder.tables, row.piece).last


def test_table_with_edge_cases(spark, theirs):
    texts = [None, "", "Hello hello", "x" * 30000, "é漢😀 mixed  spaces ", "Hello hello"]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in bpe.encode_table(docs, PATH, public_tokenizers.PATTERN, digests=True).collect()}
    plain = {r.doc_id: r for r in bpe.encode_table(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = theirs.encode_ordinary(t or "")
        assert plain[i].ids == ids and bytes(plain[i].decoded) == (t or "").encode()
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_table(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_warc_round_trip(spark):
    html = [None, "", "<p>short</p>", "y" * 150, "y" * 150, "é" * 80, "é" * 80, "y" * 150, "z" * 99, "z" * 99, "\r\n\r\n" * 40]
    pages = spark.createDataFrame([(i, f"http://h/{i % 3}", h, "c") for i, h in enumerate(html)], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.archive(pages, shards=3, roll_bytes=500).collect()}
    first = {}
    for i, h in enumerate(html):
        data = (h or "").encode()
        back = first.setdefault(data, i) if len(data) >= 100 else i
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if back == i else ("revisit", back))
    assert warc.archive(pages.limit(0), shards=2).count() == 0


def test_warc_with_null_and_repeated_ids(spark):
    same = "y" * 150
    data = [(None, None, None), (None, "http://h", same), (None, "http://h", same), (3, None, same), (3, "u", same), (5, "u", same), (6, "u", "z" * 3_000_000), (2, "u", "other")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(pages, shards=3).collect())
    assert got == [(0, 0, "response", None), (0, 150, "response", None), (0, 150, "response", None), (2, 5, "response", None), (3, 150, "response", None), (3, 150, "response", None), (5, 150, "revisit", 3), (6, 3_000_000, "response", None)]


def test_warc_bytes_depend_on_the_rows_alone(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "text " * 50 + str(i)) for i in range(40)], "page_id long, url string, html string")

    def files(df):
        shared = Shared(spark, "warc-test")
        return sorted((r.name, r.records, r.sha256) for r in warc.write(warc.revisits(df, shared), shared.path("a"), 3, 2000).collect())

    assert files(pages) == files(pages.orderBy(pages.page_id.desc()))
    assert sum(r[1] for r in files(pages)) == 40


def test_broken_records_are_found():
    raw = warc.record(1, "http://h", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.parse(raw)["payload"] == b"payload" and warc.parse(raw)["block"] == warc.http_head(7) + b"payload"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload", b"paxload"))
    other = warc.record(1, "http://h", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="payload of"):
        warc.parse(other)
    assert warc.parse(warc.record(2, "u", b"payload", "d", 1))["payload"] == b"" and warc.parse(warc.info("a"))["WARC-Filename"] == "a"
    with pytest.raises(ValueError):
        list(warc.members(warc._member(raw)[:-9]))


def test_archives_are_held_against_their_manifest(spark):
    import json
    from pathlib import Path

    pages = spark.createDataFrame([(i, f"http://h/{i}", "text " * 50 + str(i)) for i in range(40)], "page_id long, url string, html string")
    shared = Shared(spark, "warc-verify")
    folder = shared.path("a")
    made = shared.save(warc.write(warc.revisits(pages, shared), folder, 2, 1000), "manifest")
    at = Path(folder.removeprefix("file://"))
    lost = at / "part-000000-00000.warc.gz.tmp-99999"
    lost.write_bytes(b"half a fi")
    for _ in range(2):
        warc.commit(made, folder)
        assert not lost.exists() and warc.verify(spark, folder).count() == 0
    names = sorted(x.name for x in at.glob("*.warc.gz"))
    told = json.loads((at / "_MANIFEST.json").read_text())
    assert told == {"files": len(names), "records": 40, "bytes": sum((at / n).stat().st_size for n in names)} and len(names) > 2
    for n in names:
        first = next(warc.members((at / n).read_bytes()))
        assert (first["WARC-Type"], first["WARC-Filename"]) == ("warcinfo", n)
    (at / "part-000009-00000.warc.gz").write_bytes(b"x")
    (at / names[0]).write_bytes((at / names[1]).read_bytes())
    (at / names[2]).unlink()
    assert {(r.name, r.problem) for r in warc.verify(spark, folder).collect()} == {(names[0], "changed"), (names[2], "missing"), ("part-000009-00000.warc.gz", "not in the manifest")}
