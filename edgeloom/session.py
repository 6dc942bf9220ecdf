"""Session defaults for local runs; a cluster's own settings win where they exist."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package, once an application, unless their path has it already."""
    root = str(Path(__file__).resolve().parent.parent)
    app = spark.sparkContext.applicationId
    known = {os.path.realpath(p or ".") for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]}
    if app in _SHIPPED or root in known:
        return
    # The driver serves the archive to the executors; none of them reads this folder.
    folder = tempfile.mkdtemp(prefix="edgeloom-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/edgeloom", "zip", root, "edgeloom"))
    _SHIPPED.add(app)


def local_session(cores: int | str = "*", name: str = "edgeloom", memory: str = "8g") -> SparkSession:
    width = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", width)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
