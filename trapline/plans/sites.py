"""Queries about trapping sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline import constants as K
from trapline.functions.classes import class_label, class_of, recode_levels
from trapline.functions.missing import text_or_na
from trapline.functions.sphere import ring_area_m2, site_density
from trapline.functions.text import popup_label
from trapline.operators.choices import filter_in
from trapline.operators.joins import left_join_na, semi_join
from trapline.operators.levels import levels_of, with_level_colour
from trapline.operators.rollup import distinct_by, first_row_by
from trapline.operators.spatial import (
    BROADCAST_BYTES,
    join_points_in_regions,
    region_studies,
    studies_by_region,
)
from trapline.plans.studies import selected_studies
from trapline.sources.layers import point_layer, region_layer


def distinct_sites(points: DataFrame, order: Sequence[str] = ("ord",)) -> DataFrame:
    """First row per coordinate."""
    return first_row_by(points, ["lon", "lat"], order)


def base_layer(points: DataFrame) -> DataFrame:
    """One plain marker per coordinate. Markers show nothing of their row, so coordinates suffice."""
    spots = distinct_by(points, ["lon", "lat"])
    return point_layer(spots, K.LAYER_ALL, F.lit(K.BASE_COLOUR), K.BASE_RADIUS)


def selected_site_layer(
    spatial: DataFrame,
    studies: DataFrame,
    positions: Sequence[int],
    aims: Sequence[str] | None = None,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """Sites of the studies selected in the table, coloured by aim.

    ``aims`` are the levels of the colours; by default those found in ``spatial``.
    """
    chosen = selected_studies(studies, positions, order)
    label = popup_label(
        K.LABEL_STUDY, F.col("unique_id"), K.BREAK, F.col("trap_period"), K.BREAK,
        K.LABEL_VILLAGE, F.col("town_village"), K.BREAK, K.LABEL_NIGHTS, F.col("trap_nights"),
    )
    shown = semi_join(spatial, chosen, ["unique_id"])
    colour = F.col("__colour")
    if aims is None:
        shown = with_level_colour(shown, "aim", levels_of(spatial, "aim"), K.AIM_PALETTE, "__colour")
    else:
        colour = recode_levels(F.col("aim"), aims, K.AIM_PALETTE)
    return point_layer(shown, K.LAYER_STUDIES, colour, K.STUDY_RADIUS, label)


def site_density_by_region(
    regions: DataFrame,
    sites: DataFrame,
    region_id: str = "region_id",
    group: str | None = None,
    breaks: Sequence[float] = K.DENSITY_BREAKS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Trap-site density of every region, one row each, with its class and number of studies.

    Sites are counted per ``group``, by default the region id. Grouping by a name that several
    regions share gives each of them the count of all.
    """
    seen = studies_in_regions(regions, sites, region_id, group, broadcast_bytes)
    counts = studies_by_region(seen, group or region_id, "unique_id")
    density = site_density(F.col("n"), F.col("area_m2"))
    return (
        left_join_na(regions, counts, group or region_id)
        .withColumn("area_m2", ring_area_m2("ring"))
        .withColumn("sites_per_km2", density)
        .withColumn("density_class", class_of(F.col("sites_per_km2"), breaks))
    )


def studies_in_regions(
    regions: DataFrame,
    sites: DataFrame,
    region_id: str = "region_id",
    group: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Sites and first place per (region, study); studies are counted before regions are named."""
    hits = join_points_in_regions(
        sites.select("ord", "unique_id", "lon", "lat"), regions, region_id,
        broadcast_bytes=broadcast_bytes,
    )
    seen = region_studies(hits, region_id, "unique_id", "ord")
    if group is None or group == region_id:
        return seen
    named = left_join_na(seen, regions.select(region_id, group), region_id)
    return named.groupBy(group, "unique_id").agg(
        F.sum("n").alias("n"), F.min("first_ord").alias("first_ord")
    )


def density_layer(
    density: DataFrame,
    texts: DataFrame | None = None,
    region_id: str = "region_id",
    breaks: Sequence[float] = K.DENSITY_BREAKS,
) -> DataFrame:
    """Regions with a known study, classed by density.

    ``texts`` holds the study ids (``studies``) of the regions whose labels are read; the labels of all
    others stop before them.
    """
    shown = density.filter(F.col("n_known_studies") > 0)
    studies = F.lit(None).cast("string")
    if texts is not None:
        shown, studies = left_join_na(shown, texts, region_id), F.col("studies")
    value = F.format_string("%.6f", F.col("sites_per_km2"))
    number = F.when(F.col("sites_per_km2").isNull(), K.MISSING_TEXT).otherwise(value)
    head = popup_label(F.col("name_2"), K.BREAK, K.LABEL_DENSITY, number)
    tail = F.concat(F.lit(K.BREAK), F.lit(K.LABEL_REGION_STUDIES), studies)
    return region_layer(
        shown, K.LAYER_DENSITY, region_id, F.col("sites_per_km2"),
        class_label(F.col("density_class"), breaks), F.concat(head, F.coalesce(tail, F.lit(""))),
    )


def border_layer(level_0: DataFrame, codes: Sequence[str] = K.BORDER_COUNTRIES) -> DataFrame:
    """Outlines of the listed countries."""
    return region_layer(
        filter_in(level_0, "gid_0", codes),
        K.LAYER_BORDERS, "gid_0", F.lit(None).cast("double"), F.lit(None).cast("string"),
        F.concat(F.lit(K.LABEL_COUNTRY), text_or_na(F.col("name_0"))),
    )
