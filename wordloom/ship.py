"""Brings this package to Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once for each application.

    The driver serves the file to the executors, so no shared folder is needed.
    """
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    here = Path(__file__).resolve().parent
    if here.suffix == ".zip" or not here.is_dir():  # it was sent already
        return
    handle, at = tempfile.mkstemp(prefix="wordloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, f"{here.name}/{file.relative_to(here)}")
    spark.sparkContext.addPyFile(at)
    _SENT.add(app)
