"""Queries about trapped species."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.missing import ascending
from trapline.functions.text import popup_label, sentence_case
from trapline.operators.choices import (
    filter_choice,
    filter_reported,
    filter_selected,
    takes_all,
    with_sentinel,
)
from trapline.operators.joins import left_join_na, semi_join
from trapline.operators.order import rank_by_frequency
from trapline.operators.rollup import count_by, distinct_by, relabel_counts
from trapline.session import settle
from trapline.sources.layers import point_layer


def genus_choices(species: DataFrame) -> DataFrame:
    """"All", then the genera in alphabetical order."""
    raw = distinct_by(species, ["genus"])
    genera = raw.select(sentence_case(F.col("genus")).alias("genus")).distinct()
    return with_sentinel(genera, ascending("genus"), "genus")


def species_choices(
    species: DataFrame, genera: Sequence[str] | None = None, sentinel: str | None = K.ALL
) -> DataFrame:
    """Species of the chosen genera, most recorded first."""
    raw = count_by(species, "genus", "classification")
    chosen = filter_choice(raw, sentence_case(F.col("genus")), genera)
    counts = chosen.groupBy("classification").agg(F.sum("number").alias("number"))
    order = [F.col("number").desc(), *ascending("classification")]
    return with_sentinel(counts, order, "classification", sentinel)


def species_layer(species: DataFrame, chosen: Sequence[str] | None) -> DataFrame:
    """Detections and non-detections of the chosen species; nothing chosen, nothing drawn.

    ``species`` is the prepared table, whose trapping effort is text.
    """
    label = popup_label(
        K.LABEL_STUDY, F.col("unique_id"), K.BREAK, K.LABEL_TRAPPED, F.col("number"), K.BREAK,
        K.LABEL_VILLAGE, F.col("town_village"), K.BREAK, K.LABEL_NIGHTS, F.col("trap_nights"),
    )
    return point_layer(
        filter_selected(species, "classification", chosen),
        K.LAYER_SPECIES, F.col("pa_colour"), K.SPECIES_RADIUS, label,
    )


def individuals_per_habitat(
    rodent_summary: DataFrame, genera: Sequence[str] | None = None
) -> DataFrame:
    """Trapped individuals per (species, habitat), species ranked by frequency.

    A genus choice selects its species, and those species are then shown whole: a species name
    recorded under two genera keeps the rows of both.
    """
    raw = settle(count_by(rodent_summary, "genus", "classification", "trap_habitat"))
    shown = raw
    if not takes_all(genera):
        listed = filter_choice(raw, sentence_case(F.col("genus")), genera)
        shown = semi_join(raw, distinct_by(listed, ["classification"]), ["classification"])
    labels = {c: sentence_case(F.col(c)) for c in ("classification", "trap_habitat")}
    counts = relabel_counts(filter_reported(shown, "trap_habitat").drop("genus"), labels)
    ranks = rank_by_frequency(counts, "classification", reverse=True)
    return left_join_na(counts, ranks, "classification")
