"""Send the package to Python workers that cannot see the driver's folders."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package's Python files as a zip that Spark hands to every executor."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    path = Path(tempfile.mkdtemp(prefix="tallyspark-")) / "tallyspark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, str(f.relative_to(PACKAGE.parent)))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
