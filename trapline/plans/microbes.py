"""Queries about microorganisms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.missing import ascending
from trapline.functions.text import assay_status, popup_label, sentence_case
from trapline.operators.choices import (
    filter_choice,
    filter_groups,
    filter_not_contains,
    with_sentinel,
)
from trapline.operators.clusters import cluster_markers, cluster_points
from trapline.operators.joins import left_join_na
from trapline.operators.order import rank_by_value
from trapline.operators.rollup import assay_totals, count_by, distinct_by
from trapline.session import settle
from trapline.sources.layers import point_layer


def group_choices(pathogen: DataFrame) -> DataFrame:
    """"All", then the microorganism groups in alphabetical order, a missing group last."""
    groups = distinct_by(pathogen, ["pathogen_group"])
    return with_sentinel(groups, ascending("pathogen_group"), "pathogen_group")


def microbe_choices(pathogen: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """"All", then the microorganisms of the chosen groups, most recorded first."""
    counts = count_by(filter_choice(pathogen, "pathogen_group", groups), "pathogen_clean")
    order = [F.col("number").desc(), *ascending("pathogen_clean")]
    return with_sentinel(counts, order, "pathogen_clean")


def assays_per_microbe(pathogen: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """Animals assayed and positive per microorganism, ranked by the median of their totals."""
    charted = filter_groups(pathogen, "pathogen_group", groups).withColumn(
        "test_positive", assay_status(F.col("assay"))
    )
    raw = assay_totals(charted, "pathogen_tested", "test_positive")
    named = raw.withColumn("pathogen_tested", sentence_case(F.col("pathogen_tested")))
    totals = settle(assay_totals(named, "pathogen_tested", "test_positive"))
    # One value per status, so a median is taken over three values at most.
    medians = totals.groupBy("pathogen_tested").agg(F.median("number").alias("median_number"))
    ranks = rank_by_value(medians, "pathogen_tested", "median_number")
    return left_join_na(totals, ranks, "pathogen_tested").withColumn(
        "log_number", F.log1p("number")
    )


def detections(pathogen: DataFrame, microbes: Sequence[str] | None = None) -> DataFrame:
    """Result rows of the chosen microorganisms, without the rows that only count assays."""
    chosen = filter_choice(pathogen, "pathogen_clean", microbes)
    return filter_not_contains(chosen, "assay", K.TESTED)


def detection_layer(pathogen: DataFrame, microbes: Sequence[str] | None = None) -> DataFrame:
    """Detections and non-detections of the chosen microorganisms."""
    label = popup_label(
        K.LABEL_STUDY, F.col("unique_id"), K.BREAK,
        K.LABEL_HOST, F.col("classification"), K.BREAK,
        K.LABEL_MICROBE, F.col("pathogen_clean"), K.BREAK,
        K.LABEL_SAMPLES, F.col("samples_tested"), K.BREAK,
        K.LABEL_POSITIVE, F.col("number"), K.BREAK,
        K.LABEL_VILLAGE, F.col("town_village"), K.BREAK,
        K.LABEL_SAMPLED, F.col("year_trapping"), K.YEAR_MONTH_GAP, F.col("month"),
    )
    return point_layer(
        detections(pathogen, microbes),
        K.LAYER_SPECIES, F.col("pa_colour"), K.MICROBE_RADIUS, label,
    )


def detection_clusters(
    pathogen: DataFrame, zooms: Sequence[int], microbes: Sequence[str] | None = None
) -> DataFrame:
    """Clustered record counts of the detection layer, by cells of a grid."""
    return cluster_points(detections(pathogen, microbes), zooms)


def detection_markers(
    pathogen: DataFrame, zooms: Sequence[int], microbes: Sequence[str] | None = None
) -> DataFrame:
    """Clustered record counts of the detection layer, by distance, as a map joins its markers."""
    return cluster_markers(detections(pathogen, microbes), zooms)
