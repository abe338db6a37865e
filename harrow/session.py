"""Sessions, and how the package reaches Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(name: str = "harrow", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors through Spark, unless PYTHONPATH already names its folder."""
    home = str(_PACKAGE.parent)
    if home in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    sc = spark.sparkContext
    if getattr(sc, "_harrow_shipped", False):
        return
    path = f"{tempfile.mkdtemp(prefix='harrow-')}/harrow_package.zip"  # Spark serves it from the driver to executors, also to later ones
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)
    sc._harrow_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``; under /tmp only where that is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
