import hashlib
import json
import subprocess
import sys

import pytest

from sentrylake import offline
from sentrylake.operators import evidence, integrity, sealing

RFC = [b"", b"\x00", b"\x10", b"\x20\x21", b"\x30\x31", b"\x40\x41\x42\x43", b"\x50\x51\x52\x53\x54\x55\x56\x57", bytes(range(0x60, 0x70))]


def test_roots_are_the_reference_values_and_sets_of_leaves_lead_to_them():
    hashed = [integrity.leaf_hash(x) for x in RFC]
    for n, root in ((1, "6e340b9cffb37a989ca544e6bb780a2c78901d3fb33738768511a30617afa01d"), (3, "aeb6bcfe274b70a14fb067a5e5578264db0fa9b51af5e0ba159158f329e06e77"), (8, "5dc9da79a70659a9ad559cb701ded9a2ab9d823aad2f4960cfe370eff4604328")):
        assert integrity.merkle_root(RFC[:n]).hex() == root
        for mask in range(1, 1 << n):
            some = {i: hashed[i] for i in range(n) if mask >> i & 1}
            nodes = offline.siblings(some, hashed[:n])
            assert offline.root_of(some, n, nodes).hex() == root
            assert offline.root_of(some, n, [*nodes, hashed[0]]) is None
            assert not nodes or offline.root_of(some, n, nodes[:-1]) is None
    assert offline.root_of({}, 3, []) is None and offline.root_of({3: hashed[0]}, 3, hashed[:2]) is None


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = [(s, i, f"line {s} {i} é", hashlib.sha256(f"line {s} {i} é".encode()).hexdigest(), json.dumps({"n": i}), 1000 + i) for s in "ab" for i in range(1, 24)]
    ledger = integrity.chain(spark.createDataFrame(rows, "shard string, sequence_num long, raw_text string, raw_hash string, body string, at long")).cache()
    early = sealing.seal(ledger.filter("sequence_num <= 7"), sealing.empty(ledger), 5, force=True)
    sealed = early.unionByName(sealing.seal(ledger, early, 5)).cache()
    wanted = spark.createDataFrame([("a", 2), ("a", 3), ("a", 6), ("b", 14), ("b", 23), ("b", 23)], "shard string, sequence_num long")
    folder = tmp_path_factory.mktemp("bundle") / "case"
    digest = evidence.write_bundle(ledger, sealed, wanted, folder, "case 7", width=5)
    return ledger, sealed, wanted, folder, digest


def copied(folder, tmp_path):
    to = tmp_path / "copy"
    to.mkdir()
    for f in folder.iterdir():
        (to / f.name).write_bytes(f.read_bytes())
    return to


def test_a_bundle_holds_without_spark(made):
    _, _, _, folder, digest = made
    assert offline.check(folder) == [] and digest == (folder / offline.SEAL).read_text().strip()
    assert json.loads((folder / offline.MANIFEST).read_text())["unsealed"] == 1  # record 23 of b is in no window yet
    done = subprocess.run([sys.executable, "-S", str(folder / "offline.py")], capture_output=True, text=True, timeout=60)
    assert (done.returncode, done.stdout) == (0, "everything holds\n")


def _edit(name, change):
    def run(folder):
        rows = [json.loads(x) for x in (folder / name).read_text().splitlines()]
        change(rows)
        data = "".join(json.dumps(r) + "\n" for r in rows).encode()
        (folder / name).write_bytes(data)
        manifest = json.loads((folder / offline.MANIFEST).read_text())
        for f in manifest["files"]:
            if f["name"] == name:
                f["sha256"] = offline.sha256(data)
        said = json.dumps(manifest).encode()
        (folder / offline.MANIFEST).write_bytes(said)
        (folder / offline.SEAL).write_text(offline.sha256(said))  # whoever changes it makes all hashes fit again

    return run


def rehashed(r):
    r["record_hash"] = hashlib.sha256(f"{r['prev_hash']}:{r['sequence_num']}:{r['raw_hash']}:{r['body']}".encode()).hexdigest()


def _forge(rows):
    rows[0]["body"] = '{"n": 99}'
    rehashed(rows[0])


def _cover(rows):
    body = json.loads(rows[0]["body"])
    body["merkle_root"] = "0" * 64
    rows[0]["body"] = json.dumps(body, sort_keys=True, separators=(",", ":"))


EDITS = {
    "file gone": (lambda f: (f / "proofs.jsonl").unlink(), "proofs.jsonl is missing"),
    "file changed": (lambda f: (f / "records.jsonl").write_text((f / "records.jsonl").read_text().replace("case", "x") + "\n"), "records.jsonl was changed"),
    "file added": (lambda f: (f / "more.txt").write_text("x"), "more.txt is in no manifest"),
    "manifest": (lambda f: (f / offline.MANIFEST).write_text((f / offline.MANIFEST).read_text().replace("case 7", "case 8")), "the manifest is not the one that was sealed"),
    "no manifest": (lambda f: (f / offline.MANIFEST).unlink(), "the manifest cannot be read"),
    "raw line": (_edit("records.jsonl", lambda rows: rows[0].update(raw_text="other")), "record a 2: its raw line was changed"),
    "event": (_edit("records.jsonl", lambda rows: rows[0].update(body="{}")), "record a 2: its event or its chain record was changed"),
    "event with its hash": (_edit("records.jsonl", _forge), "checkpoint a 1: its records are not those that it sealed"),
    "record left out": (_edit("records.jsonl", lambda rows: rows.pop(0)), "the records are not those of the manifest"),
    "proof": (_edit("proofs.jsonl", lambda rows: rows[0]["nodes"].reverse()), "checkpoint a 1: its records are not those that it sealed"),
    "place": (_edit("proofs.jsonl", lambda rows: rows[0]["leaves"].pop()), "checkpoint a 1: its records are not those that it sealed"),
    "checkpoint": (_edit("checkpoints.jsonl", _cover), "checkpoint a 1: its text was changed"),
    "checkpoint gone": (_edit("checkpoints.jsonl", lambda rows: rows.pop(0)), "checkpoint a 1 is missing"),
    "no members": (_edit("proofs.jsonl", lambda rows: rows[0].pop("nodes")), "the bundle cannot be read: KeyError"),
}


@pytest.mark.parametrize("what", EDITS)
def test_tampering_is_found(made, tmp_path, what):
    folder = copied(made[3], tmp_path)
    edit, want = EDITS[what]
    edit(folder)
    assert want in offline.check(folder)


def test_proofs_of_several_records_and_limits(made, spark, tmp_path):
    ledger, sealed, wanted, _, _ = made
    got = {(r.shard, r.idx): ([(x.sequence_num, x.place) for x in r.leaves], r.proven) for r in evidence.multiproofs(ledger, sealed, wanted, width=5).collect()}
    assert got == {("a", 1): ([(2, 1), (3, 2)], True), ("a", 2): ([(6, 0)], True), ("b", 4): ([(14, 1)], True)}
    with pytest.raises(ValueError):
        evidence.write_bundle(ledger, sealed, wanted.limit(0), tmp_path / "none")
