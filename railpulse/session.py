"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Semantics: wall-clock columns are TIMESTAMP_NTZ, and gaps between them are
# measured on the UTC time line, so the session zone must not have DST.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Run-time re-planning: small build sides turn into broadcasts only after their
# size has been measured, and hot join partitions are split.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Recording the Python call site of every column costs more than planning does.
QUIET = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def builder(app_name: str = "railpulse") -> SparkSession.Builder:
    """A session builder carrying the required settings and nothing else."""
    b = SparkSession.builder.appName(app_name)
    for key, value in {**REQUIRED, **ADAPTIVE, **QUIET}.items():
        b = b.config(key, value)
    return b


def local_session(
    cores: int | str = 8, app_name: str = "railpulse-local", settings: dict[str, str] | None = None
) -> SparkSession:
    """Single-JVM session for tests and the benchmark; ``settings`` hold from its start."""
    b = builder(app_name)
    for key, value in (settings or {}).items():
        b = b.config(key, value)
    return (
        b
        .master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        .getOrCreate()
    )


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path for written results and stream checkpoints.

    It lies in the shared folder named by ``spark.checkpoint.dir``. Only a local
    session may do without: it gets a temporary folder, which executors on other
    machines could not see.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="railpulse-")
    return os.path.join(shared, f"{purpose}-{uuid.uuid4().hex}")
