"""What a session needs before Python code of this package runs on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Most bytes of a batch sent to a Python worker, where the application sets no limit of its own: long texts then go in
#: small batches, and an executor's memory does not depend on how long they are.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's sources to the executors, once an application, as --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        sc.addPyFile(archive)
        _SHIPPED.add(sc.applicationId)
        if not sc.getConf().contains(BATCH[0]):
            spark.conf.set(*BATCH)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Only a local session may do without one;
    it gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()
