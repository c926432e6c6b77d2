"""Session settings that the engine's semantics rely on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def build_session(app: str = "sentrylake", **conf: str) -> SparkSession:
    """UTC, and adaptive execution for skew and partition sizes; the rest is the caller's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, where their PYTHONPATH does not have it."""
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    context = spark.sparkContext
    if str(_ROOT) in on_path or context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp()) / f"{package.name}-core.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(_ROOT))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch_dir(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir; only a local session may do without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"
