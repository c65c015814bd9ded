"""Giving the workers this package where the cluster does not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the application's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        place = os.path.join(tempfile.mkdtemp(prefix="palimp-ship-"), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(place, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(PACKAGE.rglob("*.py")):
                out.write(source, source.relative_to(PACKAGE.parent))
        context.addPyFile(place)
    return spark
