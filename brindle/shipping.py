"""Sends this package to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip, served by the driver to all executors.

    Sessions started with ``--py-files`` or a PYTHONPATH that holds the package
    don't need it; it does no harm there.
    """
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    _sent.add(context.applicationId)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="brindle-")) / "brindle_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
