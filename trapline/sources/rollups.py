"""A study rollup on disk, from which the host-pathogen table is made for every choice.

A rollup is a folder of generations, a generation a folder of batches. New rows become a batch of the present generation;
``compact`` adds all batches up into a new generation. Batches are sorted by host and microorganism, so that a choice
reaches few row groups of their files. Readers take the newest generation that is complete.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from trapline.operators.rollup import merge_studies
from trapline.session import more_parts

_GENERATION = re.compile(r"^generation=(\d{6})$")


def _folders(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, [s.getPath() for s in files.listStatus(folder)] if files.exists(folder) else []


def _newest(spark: SparkSession, path: str) -> int | None:
    """Number of the newest generation whose first batch is complete."""
    files, folders = _folders(spark, path)
    done = []
    for folder in folders:
        found = _GENERATION.match(folder.getName())
        if found and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=0/_SUCCESS")):
            done.append(int(found[1]))
    return max(done, default=None)


def _write(parts: DataFrame, path: str, generation: int, batch: str) -> None:
    keys = ["classification", "pathogen_clean", "country", "iso3c", "unique_id"]
    more = more_parts(parts)
    ranges = parts.repartitionByRange(more, *keys) if more else parts.repartitionByRange(*keys)
    laid = ranges.sortWithinPartitions(*keys)
    laid.write.parquet(f"{path}/generation={generation:06}/batch={batch}")


def store_rollup(parts: DataFrame, path: str) -> None:
    """Store a study rollup in a new folder."""
    if _newest(parts.sparkSession, path) is not None:
        raise ValueError(f"{path} holds a rollup; add to it with append_rollup")
    _write(parts, path, 0, "0")


def append_rollup(parts: DataFrame, path: str) -> None:
    """Add the study rollup of new rows. Studies may be in the rollup already; what is stored is not read."""
    generation = _newest(parts.sparkSession, path)
    if generation is None:
        raise ValueError(f"{path} holds no rollup")
    _write(parts, path, generation, uuid.uuid4().hex)


def compact_rollup(spark: SparkSession, path: str) -> None:
    """Add up all batches into one, in a new generation. Older ones stay until ``drop_old_rollups``, for those who read them."""
    generation = _newest(spark, path)
    if generation is None:
        raise ValueError(f"{path} holds no rollup")
    _write(merge_studies(open_rollup(spark, path)), path, generation + 1, "0")


def drop_old_rollups(spark: SparkSession, path: str) -> None:
    """Remove all generations before the newest."""
    newest, (files, folders) = _newest(spark, path), _folders(spark, path)
    for folder in folders:
        found = _GENERATION.match(folder.getName())
        if found and newest is not None and int(found[1]) < newest:
            files.delete(folder, True)


def open_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches of the newest generation. Take them to ``host_pathogen_of_studies``, which adds them up."""
    generation = _newest(spark, path)
    if generation is None:
        raise ValueError(f"{path} holds no rollup")
    return spark.read.parquet(f"{path}/generation={generation:06}").drop("batch")
