"""Sends this package to the executors, so that functions pickled by name are found there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Serve the package's sources from the driver, once an application; executors need no installation."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="quarry-src-")) / "quarry_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
