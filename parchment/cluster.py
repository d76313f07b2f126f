"""Getting this package to the Python workers of a cluster."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="parchment-")) / "parchment_src.zip"
    with zipfile.ZipFile(at, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, f"{here.name}/{file.relative_to(here)}")
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
