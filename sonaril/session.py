"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that kernels import there wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_sonaril_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sonaril-"), "sonaril_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sonaril", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._sonaril_shipped = True


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a new one under /tmp only where none is set and Spark is local.

    The setting can't be changed on a running session, so the new folder is remembered with the context.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_sonaril_folder", None)
    if base:
        return base
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc._sonaril_folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return sc._sonaril_folder
