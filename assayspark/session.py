"""Session settings used by the tests and the benchmark."""

from __future__ import annotations

import os
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

ARCHIVE = "assayspark-package.zip"


def build_session(cores: int | str = "*", app: str = "assayspark", **conf: str) -> SparkSession:
    """Local session; on a cluster the caller passes its own session instead."""
    partitions = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    The archive is built next to the files that Spark itself serves to executors, so nothing has
    to be installed there and no shared path is assumed.
    """
    context = spark.sparkContext
    if ARCHIVE in context._python_includes:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = os.path.join(SparkFiles.getRootDirectory(), "package")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, ARCHIVE)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    context.addPyFile(path)
