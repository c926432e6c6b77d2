"""Evidence for chosen records: their chain hashes checked, and a path to the root that seals them; and incident type hints."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake import offline
from sentrylake.session import ship

from . import integrity, sealing

MOST = 1000

# Incident types of the national reporting rules, and words that point to them.
INCIDENT_HINTS = {
    "i": r"scan|nmap|nikto|probe|sweep|recon|port ?scan|PORT_SWEEP",
    "iii": r"brute|password|spray|login|logon|auth|credential|unauthori[sz]ed|LOGIN_THEN_ACTIVITY",
    "x": r"sql|injection|traversal|xss|cross.site|web attack|http|php|wordpress|struts|log4j|apache",
    "ii": r"code execution|remote code|rce|exploit|overflow|shellcode|privilege|smb|eternal",
    "v": r"malware|trojan|ransom|worm|botnet|\bbot\b|miner|beacon|c2|command.and.control|backdoor|virus",
    "viii": r"\bdos\b|ddos|flood|denial",
    "xii": r"exfil|leak|large (upload|transfer)|data transfer",
    "vii": r"phish|spoof|impersonat",
    "vi": r"dns|smtp|mail server|database|mysql|mssql|router",
}


def suggest_types(facts: DataFrame, text: str = "text") -> DataFrame:
    """(code, items): incident types that facts point to and how many do; all hints in one pass."""
    counts = facts.agg(*[F.count_if(F.col(text).rlike(f"(?i){p}")).alias(c) for c, p in INCIDENT_HINTS.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("items")) for c in INCIDENT_HINTS])
    return counts.select(F.inline(rows)).filter("items > 0")


def proofs(ledger: DataFrame, wanted: DataFrame, shard: str = "shard", size: int = 1000) -> DataFrame:
    """(shard, sequence_num, idx, leaf_index, tree_size, path, root) of the wanted records. Only their checkpoints' groups are
    gathered, each of at most ``size`` records."""
    group = F.floor((F.col("sequence_num") - 1) / size).cast("long").alias("idx")
    asked = wanted.select(shard, "sequence_num", group).withColumn("asked", F.lit(True))
    rows = ledger.select(shard, "sequence_num", "record_hash", group).join(asked.select(shard, "idx").distinct(), [shard, "idx"], "left_semi")
    rows = rows.join(asked, [shard, "idx", "sequence_num"], "left")
    kind = dict(ledger.dtypes)[shard]

    def prove(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence_num").reset_index(drop=True)
        leaves = [f"{s}:{h}".encode() for s, h in zip(pdf["sequence_num"], pdf["record_hash"], strict=True)]
        root = integrity.merkle_root(leaves).hex()
        out = [
            (key[0], int(pdf.at[i, "sequence_num"]), key[1], i, len(leaves), [p.hex() for p in integrity.inclusion_path(i, leaves)], root)
            for i in pdf.index[pdf["asked"].fillna(False).astype(bool)]
        ]
        return pd.DataFrame(out, columns=[shard, "sequence_num", "idx", "leaf_index", "tree_size", "path", "root"])

    return rows.groupBy(shard, "idx").applyInPandas(prove, f"{shard} {kind}, sequence_num long, idx long, leaf_index long, tree_size long, path array<string>, root string")


def bundle(ledger: DataFrame, wanted: DataFrame, shard: str = "shard", size: int = 1000) -> DataFrame:
    """The wanted records with whether their raw and record hashes hold, and their proofs; at most MOST."""
    n = wanted.limit(MOST + 1).count()
    if not 0 < n <= MOST:
        raise ValueError(f"a bundle holds 1 to {MOST} records")
    rows = ledger.join(wanted.select(shard, "sequence_num"), [shard, "sequence_num"])
    made = integrity.record_hash(F.col("prev_hash"), F.col("sequence_num"), F.col("raw_hash"), F.col("body"))
    rows = rows.withColumn("raw_ok", F.sha2(F.encode("raw_text", "UTF-8"), 256) == F.col("raw_hash")).withColumn("record_ok", made == F.col("record_hash"))
    return rows.join(proofs(ledger, wanted, shard, size), [shard, "sequence_num"], "left")


def multiproofs(ledger: DataFrame, sealed: DataFrame, wanted: DataFrame, width: int = sealing.SIZE) -> DataFrame:
    """(shard, idx, leaves, nodes, proven) for each checkpoint that covers some of the wanted records (shard, sequence_num): the records and
    their places, the nodes that lead from all of them together to the root, and whether they do. A checkpoint's records are one task's."""
    ranges = sealed.select("shard", "idx", "first_seq", "last_seq")
    asked = sealing.members(wanted.select("shard", "sequence_num").distinct(), ranges, width)
    there = asked.select("shard", "idx").distinct()
    rows = sealing.members(ledger.select("shard", "sequence_num", "record_hash"), ranges.join(there, ["shard", "idx"], "left_semi"), width)
    rows = rows.join(asked.withColumn("asked", F.lit(True)), ["shard", "idx", "sequence_num"], "left").join(sealed.select("shard", "idx", "merkle_root"), ["shard", "idx"])
    kind = dict(ledger.dtypes)["shard"]

    def prove(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence_num").reset_index(drop=True)
        level = [offline.leaf(s, h) for s, h in zip(pdf["sequence_num"], pdf["record_hash"], strict=True)]
        places = [int(i) for i in pdf.index[pdf["asked"].notna()]]
        nodes = offline.siblings(places, level)
        root = offline.root_of({i: level[i] for i in places}, len(level), nodes)
        leaves = [{"sequence_num": int(pdf.at[i, "sequence_num"]), "place": i} for i in places]
        return pd.DataFrame([(*key, leaves, [n.hex() for n in nodes], root is not None and root.hex() == pdf.at[0, "merkle_root"])], columns=["shard", "idx", "leaves", "nodes", "proven"])

    ship(ledger.sparkSession)
    return rows.groupBy("shard", "idx").applyInPandas(prove, f"shard {kind}, idx long, leaves array<struct<sequence_num:long,place:long>>, nodes array<string>, proven boolean")


def write_bundle(ledger: DataFrame, sealed: DataFrame, wanted: DataFrame, folder: str | Path, case: str = "", width: int = sealing.SIZE) -> str:
    """Write the wanted records (MOST at most), their checkpoints and proofs to a new folder, with ``offline.py`` to check them; returns the
    hash of the manifest, which is best kept elsewhere.

    ``ledger``: shard, sequence_num, raw_text, raw_hash, body, prev_hash, record_hash. Records that no checkpoint covers have no proof.
    """
    n = wanted.select("shard", "sequence_num").distinct().limit(MOST + 1).count()
    if not 0 < n <= MOST:
        raise ValueError(f"a bundle holds 1 to {MOST} records")
    keys = wanted.select("shard", "sequence_num").distinct()
    columns = ["shard", "sequence_num", "raw_text", "raw_hash", "body", "prev_hash", "record_hash"]
    records = sorted((r.asDict() for r in ledger.select(*columns).join(F.broadcast(keys), ["shard", "sequence_num"], "left_semi").collect()), key=lambda r: (r["shard"], r["sequence_num"]))
    proven = sorted((r.asDict(recursive=True) for r in multiproofs(ledger, sealed, keys, width).drop("proven").collect()), key=lambda r: (r["shard"], r["idx"]))
    proven = [{**p, "leaves": [[x["sequence_num"], x["place"]] for x in p["leaves"]]} for p in proven]
    covers = {(p["shard"], p["idx"]) for p in proven}
    found = sealed.select("shard", "idx", "body", "checkpoint_hash").join(F.broadcast(ledger.sparkSession.createDataFrame(list(covers), f"shard {dict(sealed.dtypes)['shard']}, idx long")), ["shard", "idx"], "left_semi") if covers else None
    checkpoints = sorted((r.asDict() for r in found.collect()), key=lambda r: (r["shard"], r["idx"])) if found is not None else []
    folder = Path(folder)
    folder.mkdir(parents=True)
    files = []
    for name, rows in (("records", records), ("proofs", proven), ("checkpoints", checkpoints)):
        data = "".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows).encode()
        (folder / f"{name}.jsonl").write_bytes(data)
        files.append({"name": f"{name}.jsonl", "sha256": offline.sha256(data), "bytes": len(data)})
    manifest = {"case": case, "files": files, "records": [[r["shard"], r["sequence_num"]] for r in records], "unsealed": len(records) - sum(len(p["leaves"]) for p in proven)}
    said = json.dumps(manifest, sort_keys=True, ensure_ascii=False).encode()
    (folder / offline.MANIFEST).write_bytes(said)
    (folder / offline.SEAL).write_text(offline.sha256(said) + "\n")
    (folder / "offline.py").write_text(Path(offline.__file__).read_text(encoding="utf-8"), encoding="utf-8")
    return offline.sha256(said)
