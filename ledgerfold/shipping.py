"""What all executors share: this package, wherever the driver was started from, and a folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def to_workers(spark: SparkSession) -> None:
    """Adds the package, as one archive, to the files every worker imports from; once in an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ledgerfold-")) / "ledgerfold_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted((root / "ledgerfold").rglob("*.py")):
            z.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir (or the context's checkpoint directory) names, which all executors must share.
    Where none is named a temporary one is made, but only on a local master, where the driver's disk is the executors'."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerfold-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")
