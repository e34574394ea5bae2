"""Sending the package to the executors of a running session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Give executors this package, for drivers that import it from a folder of their own; the archive's path.

    Not needed where it is installed on all machines or named in --py-files."""
    package = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="mosaicell-")) / f"{package.name}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    return str(path)
