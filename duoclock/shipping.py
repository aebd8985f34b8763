"""Sends this package to the Python workers, wherever the driver found it."""

from __future__ import annotations

import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


@cache
def _archive() -> str:
    path = Path(tempfile.mkdtemp(prefix="package-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    return str(path)


def ship(spark: SparkSession) -> None:
    """Once for each application: its workers can import the package though they don't share the driver's folders."""
    context = spark.sparkContext
    if not getattr(context, "_ships_duoclock", False):
        context.addPyFile(_archive())
        context._ships_duoclock = True
