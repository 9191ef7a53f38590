"""Send the package to the executors of a running session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def package_zip(folder: str) -> str:
    """The package's modules as one zip in ``folder``."""
    path = os.path.join(folder, f"{os.path.basename(PACKAGE)}.zip")
    root = os.path.dirname(PACKAGE)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for where, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.relpath(full, root))
    return path


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import the package wherever they run; once for each context.

    Functions of this package are pickled by their module's name, so workers need the
    module. The driver serves the zip, executors fetch it when they start a task.
    """
    context = spark.sparkContext
    if not getattr(context, "_postpulse_shipped", False):
        context.addPyFile(package_zip(tempfile.mkdtemp(prefix="postpulse-package-")))
        context._postpulse_shipped = True
    return spark
