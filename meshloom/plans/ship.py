"""Making the package importable on executors that don't have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors, once for each application, and keep batches for Python workers to a few megabytes."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH, None) in (None, "67108864b"):  # not set by the user
        spark.conf.set(BATCH, "8m")
    if not getattr(sc, "_meshloom_shipped", False):
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="meshloom-"), "meshloom.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
        sc._meshloom_shipped = True
    return spark
