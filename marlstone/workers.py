"""Python workers must be able to import this package."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the path of workers started from here on.

    This serves local sessions; on a cluster the package comes by --py-files.
    """
    home = str(Path(__file__).resolve().parents[1])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(x for x in (home, known) if x)
