"""All tables of a survey, opened together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from trapline.plans.ingest import prepare_pathogen, prepare_species
from trapline.sources.tables import laid_out, load_table, table_schema

# Tables that are cleaned when they are taken in, and the order in which they are stored for choices.
PREPARED = {"species": prepare_species, "pathogen": prepare_pathogen}
LAYOUT = {"species": ("classification", "ord"), "pathogen": ("classification", "pathogen_clean", "ord")}


@dataclass(frozen=True)
class Survey:
    """The declared tables, cleaned as the queries expect them."""

    studies: DataFrame
    studies_all: DataFrame
    spatial: DataFrame
    species: DataFrame
    rodent_summary: DataFrame
    pathogen: DataFrame
    level_0: DataFrame
    level_2: DataFrame


def open_survey(
    spark: SparkSession, directory: str, suffix: str = ".parquet", prepared: bool = False
) -> Survey:
    """Open every table of ``directory``, checking its columns.

    Tables as they were recorded are cleaned row by row whenever they are read. Clean them once with
    ``store_prepared`` and open those with ``prepared``: choices then reach the files.
    """
    tables = {}
    for name in Survey.__dataclass_fields__:
        kind = f"{name}_prepared" if prepared and name in PREPARED else name
        tables[name] = load_table(spark, directory, name, table_schema(kind), suffix)
    if not prepared:
        tables |= {name: clean(tables[name]) for name, clean in PREPARED.items()}
    return Survey(**tables)


def store_prepared(survey: Survey, directory: str, suffix: str = ".parquet") -> None:
    """Write the cleaned tables of a survey, for ``open_survey(..., prepared=True)``.

    Tables that choices are made from are laid out by what is chosen.
    """
    for name in Survey.__dataclass_fields__:
        table = getattr(survey, name)
        laid = laid_out(table, LAYOUT[name]) if name in LAYOUT else table
        laid.write.parquet(f"{directory.rstrip('/')}/{name}{suffix}")
