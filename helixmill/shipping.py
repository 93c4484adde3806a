"""Sends this package to the executors' Python workers, which needn't have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once a session; Spark's own file server hands it out."""
    context = spark.sparkContext
    if getattr(context, "_helixmill_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="helixmill-py-")
    staged = os.path.join(folder, "src", package.name)
    shutil.copytree(package, staged, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "helixmill"), "zip", os.path.join(folder, "src")))
    context._helixmill_shipped = True
