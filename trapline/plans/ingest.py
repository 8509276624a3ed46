"""Clean-up applied once when the tables are taken in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.text import effort_label, sentence_case


def prepare_species(species: DataFrame) -> DataFrame:
    """Trapping effort as text."""
    return species.withColumn("trap_nights", effort_label(F.col("trap_nights")))


def prepare_pathogen(pathogen: DataFrame) -> DataFrame:
    """Host names in sentence case."""
    return pathogen.withColumn("classification", sentence_case(F.col("classification")))
