"""Check an evidence bundle without Spark and without the tables that it was made from: ``python offline.py FOLDER``.

Only the standard library is used, so the file can travel with the bundle. ``check`` returns what is wrong, nothing if all holds.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterable
from pathlib import Path

MANIFEST, SEAL = "manifest.json", "manifest.sha256"


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def leaf(sequence: int, record_hash: str) -> bytes:
    return hashlib.sha256(b"\x00" + f"{sequence}:{record_hash}".encode()).digest()


def node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def siblings(indices: Iterable[int], level: list[bytes]) -> list[bytes]:
    """The nodes that lead from some leaves (their hashes in ``level``) to the root, each once: level by level, left to right, those that do not
    follow from the leaves asked for."""
    known, out = sorted(set(indices)), []
    while len(level) > 1:
        out += [level[i ^ 1] for i in known if i ^ 1 < len(level) and i ^ 1 not in set(known)]
        level = [node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        known = sorted({i // 2 for i in known})
    return out


def root_of(leaves: dict[int, bytes], size: int, nodes: list[bytes]) -> bytes | None:
    """The root that leaves at their places and ``siblings`` lead to; None if the nodes are too few or too many."""
    if not leaves or not all(0 <= i < size for i in leaves):
        return None
    rest = iter(nodes)
    while size > 1:
        up: dict[int, bytes] = {}
        for i in sorted(leaves):
            if i // 2 in up:
                continue
            if i ^ 1 >= size:  # an odd last node moves up
                up[i // 2] = leaves[i]
                continue
            other = leaves.get(i ^ 1) or next(rest, None)
            if other is None:
                return None
            up[i // 2] = node(other, leaves[i]) if i & 1 else node(leaves[i], other)
        leaves, size = up, (size + 1) // 2
    return leaves[0] if next(rest, None) is None else None


def _lines(folder: Path, name: str) -> list[dict]:
    return [json.loads(x) for x in (folder / name).read_text(encoding="utf-8").split("\n") if x]


def check(folder: str | Path) -> list[str]:
    """What is wrong with a bundle."""
    folder = Path(folder)
    out: list[str] = []
    try:
        said = (folder / MANIFEST).read_bytes()
        manifest = json.loads(said)
    except (OSError, ValueError):
        return ["the manifest cannot be read"]
    if not (folder / SEAL).exists() or (folder / SEAL).read_text().strip() != sha256(said):
        out.append("the manifest is not the one that was sealed")
    names = {f["name"]: f["sha256"] for f in manifest["files"]}
    for name, digest in names.items():
        if not (folder / name).is_file():
            return [*out, f"{name} is missing"]
        if sha256((folder / name).read_bytes()) != digest:
            out.append(f"{name} was changed")
    out += [f"{p.name} is in no manifest" for p in sorted(folder.iterdir()) if p.name not in (*names, MANIFEST, SEAL, Path(__file__).name) and p.is_file()]
    try:
        records, proofs, checkpoints = (_lines(folder, f"{n}.jsonl") for n in ("records", "proofs", "checkpoints"))
        out += _records(records, manifest) + _proofs(records, proofs, {(c["shard"], c["idx"]): c for c in checkpoints})
    except (KeyError, TypeError, ValueError) as e:
        out.append(f"the bundle cannot be read: {type(e).__name__}")
    return out


def _records(records: list[dict], manifest: dict) -> list[str]:
    out, before = [], None
    if [[r["shard"], r["sequence_num"]] for r in records] != manifest["records"]:
        out.append("the records are not those of the manifest")
    for r in records:
        at = f"record {r['shard']} {r['sequence_num']}"
        if sha256(r["raw_text"].encode()) != r["raw_hash"]:
            out.append(f"{at}: its raw line was changed")
        if sha256(f"{r['prev_hash']}:{r['sequence_num']}:{r['raw_hash']}:{r['body']}".encode()) != r["record_hash"]:
            out.append(f"{at}: its event or its chain record was changed")
        if before and before["shard"] == r["shard"] and before["sequence_num"] + 1 == r["sequence_num"] and before["record_hash"] != r["prev_hash"]:
            out.append(f"{at}: it does not follow the record before it")
        before = r
    return out


def _proofs(records: list[dict], proofs: list[dict], checkpoints: dict[tuple, dict]) -> list[str]:
    out = []
    hashes = {(r["shard"], r["sequence_num"]): r["record_hash"] for r in records}
    for p in proofs:
        at = f"checkpoint {p['shard']} {p['idx']}"
        sealed = checkpoints.get((p["shard"], p["idx"]))
        if sealed is None:
            out.append(f"{at} is missing")
            continue
        if sha256(sealed["body"].encode()) != sealed["checkpoint_hash"]:
            out.append(f"{at}: its text was changed")
        body = json.loads(sealed["body"])
        # the size of the tree and, where no number is left out, the places come from the sealed text
        whole = body["size"] == body["last_seq"] - body["first_seq"] + 1
        places = {s - body["first_seq"] if whole else i: s for s, i in p["leaves"]}
        inside = all(body["first_seq"] <= s <= body["last_seq"] and (p["shard"], s) in hashes for s in places.values())
        leaves = {i: leaf(s, hashes[p["shard"], s]) for i, s in places.items()} if inside else {}
        if not inside or root_of(leaves, body["size"], [bytes.fromhex(n) for n in p["nodes"]]) != bytes.fromhex(body["merkle_root"]):
            out.append(f"{at}: its records are not those that it sealed")
    return out


if __name__ == "__main__":
    wrong = check(sys.argv[1] if len(sys.argv) > 1 else Path(__file__).resolve().parent)
    print("\n".join(wrong) or "everything holds")
    sys.exit(1 if wrong else 0)
