"""Making the package importable for Python workers, on a cluster as in local mode."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the workers, once per Spark application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # inside an archive it has been shipped already
        target = os.path.join(tempfile.mkdtemp(prefix="loglathe-"), "loglathe")
        root, name = os.path.split(package)
        archive = shutil.make_archive(target, "zip", root, name)
        context.addPyFile(archive)
    _shipped.add(context.applicationId)
