"""Make the package importable in Python workers of any cluster.

The driver zips the package once per application and hands it to Spark's file
server (``addPyFile``); executors fetch it from there, so no folder has to be
shared and nothing has to be installed on the workers.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors; once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return spark
    root = os.path.dirname(_PACKAGE)
    target = os.path.join(tempfile.mkdtemp(prefix="spark-"), "pageloom_sources.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for folder, _, names in os.walk(_PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, root))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
    return spark
