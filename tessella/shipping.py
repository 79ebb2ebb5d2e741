"""Make this package importable in Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all workers once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tessella-src-"), "tessella_src.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tessella", os.path.relpath(full, root)))
    context.addPyFile(archive)
    _shipped[context.applicationId] = archive
