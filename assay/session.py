"""Session settings, and this package's way to the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
_lock = threading.Lock()
_shipped: set[str] = set()


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; ANSI mode stays on. On a cluster leave master and partitions to the cluster."""
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("__", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each Spark application."""
    app = spark.sparkContext.applicationId
    with _lock:
        if app in _shipped:
            return
        top = os.path.dirname(os.path.abspath(__file__))
        where = os.path.join(tempfile.mkdtemp(prefix="assay-ship-"), "assay_package.zip")
        with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("assay", os.path.relpath(full, top)))
        spark.sparkContext.addPyFile(where)
        _shipped.add(app)
