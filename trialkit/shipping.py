"""Send this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in the workers, once per application.

    Needless where it is installed on every node, harmless there.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="trialkit-"), f"{os.path.basename(here)}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(here)))
    # Spark hands the file to every executor
    context.addPyFile(path)
    _sent.add(context.applicationId)
