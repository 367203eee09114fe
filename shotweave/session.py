"""Getting this package to the Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


@lru_cache(maxsize=None)
def _archive(root: Path, packages: tuple[str, ...]) -> str:
    path = Path(tempfile.mkdtemp(prefix="run-")) / "shotweave_packages.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for package in packages:
            for file in sorted((root / package).rglob("*.py")):
                archive.write(file, file.relative_to(root))
    return str(path)


def ship(spark: SparkSession, *packages: str) -> None:
    """Add this package, and others beside it, to the session's Python files.

    Needed once per application where the package is not installed on the
    workers; later calls do nothing.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    spark.sparkContext.addPyFile(_archive(root, ("shotweave", *packages)))
    _SHIPPED.add(application)
