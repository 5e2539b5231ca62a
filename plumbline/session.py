"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


#: Rows of an Arrow batch.
ARROW_ROWS = 1000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application.

    Arrow functions are imported by name in the Python workers, which need not have
    the package installed. Arrow batches hold at most ``ARROW_ROWS`` rows: Spark's default of
    10,000 whole texts takes tens of megabytes in the executor and again in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / "plumbline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
