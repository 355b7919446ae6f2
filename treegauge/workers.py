"""Puts this package on the path of Python workers, wherever the driver found it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a context: executors fetch an archive of the package from the driver, when they first need it."""
    package, sc = Path(__file__).resolve().parent, spark.sparkContext
    if getattr(sc, "_treegauge_sent", False) or not package.is_dir():
        return
    folder = Path(tempfile.mkdtemp(prefix="treegauge-")).resolve()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(folder / "treegauge_workers.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(folder / "treegauge_workers.zip"))
    sc._treegauge_sent = True


def in_small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """For whole texts in Python: Arrow batches of so many rows and bytes at most, so that a worker's memory doesn't follow how many files a task has.

    The settings are read when a result is computed, so they stay lowered for the session; lower ones are left alone.
    """
    ship(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        held = spark.conf.get(name).rstrip("b")
        if not (held.isdigit() and 0 < int(held) <= most):
            spark.conf.set(name, str(most))
