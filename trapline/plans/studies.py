"""Queries about the included studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.missing import ascending, text_or_na
from trapline.functions.text import speciation_label
from trapline.operators.joins import left_join_na
from trapline.operators.order import rank_by_frequency, rows_at, stack_extents
from trapline.operators.rollup import count_by, distinct_by, relabel_counts
from trapline.session import settle
from trapline.sources.paging import table_page


def studies_per_year(studies: DataFrame) -> DataFrame:
    """Bars of studies per publication year, stacked by aim. Undated studies are not drawn."""
    dated = studies.filter(F.col("year_published").isNotNull())
    return stack_extents(count_by(dated, "year_published", "aim"), "year_published", "aim")


def studies_per_country_year(spatial: DataFrame, studies: DataFrame) -> DataFrame:
    """Bubbles of studies per (country, year), countries ranked by their number of studies.

    The rank counts every study of a country; a bubble needs a year.
    """
    pairs = distinct_by(spatial, ["unique_id", "country"])
    dated = left_join_na(pairs, studies.select("unique_id", "year_published"), "unique_id")
    counts = settle(count_by(dated, "country", "year_published"))
    ranks = rank_by_frequency(counts, "country", reverse=True)
    drawn = counts.filter(F.col("year_published").isNotNull())
    return left_join_na(drawn, ranks, "country")


def studies_per_speciation(studies_all: DataFrame) -> DataFrame:
    """Bars of studies per identification method, stacked by aim."""
    raw = count_by(studies_all, "speciation", "aim")
    counts = relabel_counts(raw, {"speciation": speciation_label(F.col("speciation"))})
    return stack_extents(counts, "speciation", "aim")


def studies_per_effort(studies_all: DataFrame) -> DataFrame:
    """Bars of studies per class of trapping-effort reporting, stacked by aim."""
    return stack_extents(count_by(studies_all, "trapping_effort", "aim"), "trapping_effort", "aim")


def study_table(studies: DataFrame, page: int = 1, **page_options) -> DataFrame:
    """A page of the full study table."""
    size = page_options.pop("limit", K.STUDY_PAGE)
    return table_page(studies, "unique_id", offset=(page - 1) * size, limit=size, **page_options)


def short_study_table(studies: DataFrame, page: int = 1, **page_options) -> DataFrame:
    """A page of the study table without the long descriptive columns."""
    size = page_options.pop("limit", K.SHORT_STUDY_PAGE)
    short = studies.drop(*K.SHORT_TABLE_DROPS)
    return table_page(short, "unique_id", offset=(page - 1) * size, limit=size, **page_options)


def selected_studies(
    studies: DataFrame, positions: Sequence[int], order: Sequence[Column] | None = None
) -> DataFrame:
    """Ids of the studies at the selected positions of the table as it is shown.

    Ties of ``order`` go by the id, as on the pages of the table.
    """
    shown = [*(order or ()), *ascending("unique_id")]
    return rows_at(studies, shown, positions, "position").select("unique_id", "position")


def selected_studies_text(
    studies: DataFrame, positions: Sequence[int], order: Sequence[Column] | None = None
) -> DataFrame:
    """The selected ids as one line, in the order they were selected."""
    clicked = F.array_position(F.array(*[F.lit(int(p)) for p in positions]), F.col("position").cast("int"))
    ids = F.array_sort(F.collect_list(F.struct(clicked.alias("at"), text_or_na(F.col("unique_id")).alias("text"))))
    joined = F.array_join(F.transform(ids, lambda s: s["text"]), ", ")
    chosen = selected_studies(studies, positions, order)
    return chosen.agg(F.concat(F.lit(K.SELECTED_STUDIES), joined).alias("selection"))
