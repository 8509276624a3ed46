"""Operators of training-data pipelines: cleaning, deduplication, search and mixing of text."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def show_package(spark: SparkSession) -> None:
    """Let Python workers that see the driver's folders import this package from there.

    Elsewhere the package is installed on the executors or passed with ``--py-files``, as any other.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
