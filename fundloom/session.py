"""What a session needs before queries run on it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so Python functions find it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-"), "fundloom"), "zip", os.path.dirname(PACKAGE), os.path.basename(PACKAGE))
    sc.addPyFile(made)
    _shipped.add(sc.applicationId)
