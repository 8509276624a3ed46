"""Queries about hosts and the microorganisms found in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.missing import ascending
from trapline.functions.text import sentence_case
from trapline.operators.choices import filter_host_pathogen
from trapline.operators.joins import left_join_na
from trapline.operators.order import rows_at, with_row_id
from trapline.operators.rollup import ROLLUP_KEYS, host_pathogen, host_pathogen_of_studies, study_rollup, tested_by_country
from trapline.sources.paging import table_page

PREPARED, RAW, ROLLUP = "prepared", "raw", "rollup"  # forms in which the assays are given
TABLE_KEYS = ROLLUP_KEYS
TABLE_COLUMNS = (
    "id", "iso3c", "country", "classification", "pathogen_clean",
    "number_of_studies", "number_positive", "number_tested",
)


def host_pathogen_table(
    pathogen: DataFrame,
    hosts: Sequence[str] | None = None,
    pathogens: Sequence[str] | None = None,
    form: str = PREPARED,
) -> DataFrame:
    """Numbered host-pathogen table of the chosen hosts and microorganisms.

    ``pathogen`` is the ``PREPARED`` table, whose host names are in sentence case, so that a choice reaches the file; the
    ``RAW`` table as it was recorded, whose names are made clean after grouping; or a stored ``ROLLUP`` of it per study, from which
    every choice is answered without the rows (``sources.rollups``).
    """
    table = _rollup(pathogen, hosts, pathogens, form)
    return with_row_id(table, ascending(*TABLE_KEYS)).select(*TABLE_COLUMNS)


def host_pathogen_page(
    pathogen: DataFrame,
    page: int = 1,
    hosts: Sequence[str] | None = None,
    pathogens: Sequence[str] | None = None,
    form: str = PREPARED,
    **page_options,
) -> DataFrame:
    """A page of the host-pathogen table, filtered, searched and sorted like the study table."""
    size = page_options.pop("limit", K.STUDY_PAGE)
    table = _rollup(pathogen, hosts, pathogens, form)
    return table_page(table, TABLE_KEYS, offset=(page - 1) * size, limit=size, **page_options)


def clean_study_rollup(raw: DataFrame) -> DataFrame:
    """Study rollup of the table as it was recorded, with clean host names, to be stored."""
    return study_rollup(raw, {"classification": sentence_case(F.col("classification"))})


def _rollup(
    pathogen: DataFrame, hosts: Sequence[str] | None, pathogens: Sequence[str] | None, form: str
) -> DataFrame:
    if form == PREPARED:
        return host_pathogen(filter_host_pathogen(pathogen, hosts, pathogens))
    if form == ROLLUP:
        return host_pathogen_of_studies(filter_host_pathogen(pathogen, hosts, pathogens))
    if form != RAW:
        raise ValueError(f"the table is {PREPARED}, {RAW} or a {ROLLUP}, not {form!r}")
    names = {"classification": sentence_case(F.col("classification"))}
    table = host_pathogen(pathogen, names)
    # Bound to an aggregate, so that Catalyst does not move the choice of clean names below the grouping.
    named = table.withColumn("__host", F.when(F.col("number_of_studies") > 0, F.col("classification")))
    return filter_host_pathogen(named, hosts, pathogens, host="__host").drop("__host")


def tested_per_country(
    pathogen: DataFrame,
    borders: DataFrame,
    rows: Sequence[int],
    hosts: Sequence[str] | None = None,
    pathogens: Sequence[str] | None = None,
    form: str = PREPARED,
) -> DataFrame:
    """Animals tested per country over the selected rows of the host-pathogen table, with borders."""
    table = _rollup(pathogen, hosts, pathogens, form)
    chosen = rows_at(table, ascending(*TABLE_KEYS), rows)
    return left_join_na(tested_by_country(chosen), borders, {"iso3c": "gid_0"})
