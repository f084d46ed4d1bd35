"""Spark sessions: settings that plans rely on, and the package on executors' search paths."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with adaptive plans and times in UTC; other settings are the caller's or the cluster's."""
    conf = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"} | more
    builder = SparkSession.builder.config(map=conf)
    spark = (builder.master(master) if master else builder).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Lets executors import this package, where their search path does not have it already."""
    root, context = Path(__file__).resolve().parents[1], spark.sparkContext
    if context.applicationId in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(context.applicationId)
    if context.master.split("[")[0] == "local":
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root), context.environment.get("PYTHONPATH")]))
        return
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the file from the driver until the end
    target = Path(folder, "logloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (root / "logloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(target))
