"""Points in polygons.

Every region is laid on a grid of its own scale: the cell width is the power of four that spreads
the region over a handful of cells per side, so a country and a town quarter both cost a bounded
number of cells. A cell keeps only the edges that can matter to points inside it, and a cell with no
edge through it is settled once for all its points. Points look up one cell per scale in use, an
equi-join; a point is then tested against the few edges kept in its cell. Edges are arcs of great
circles, as in the area of a region, so that a count and an area belong to the same shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.missing import text_or_na
from trapline.functions.sphere import arc_height, crossings, polygon_edges, wrapped
from trapline.operators.choices import filter_in
from trapline.operators.order import with_row_id
from trapline.session import settle

# Cells along the longer side of a region: twice the square root of its edges within these bounds,
# before the cell width is rounded up, so that a region has about as many cells as edges.
FEWEST_CELLS, MOST_CELLS = 8, 64
SCALE_STEP = 2  # cell widths are powers of 2**SCALE_STEP, as a point is looked up once per width in use
FINEST_SCALE = -20  # cell width 2**-20 degrees, about 0.1 m
CHUNK_STUDIES = 1_000  # ids in one piece of a region's text
TEXT_STUDIES = 1_000_000  # studies of a region whose ids are one text
BROADCAST_BYTES = 128 * 1024 * 1024  # largest cell table sent to every executor


# Latitudes between which an edge's arc runs over the longitudes from ``{a}`` to ``{b}``. An arc may rise above both of its ends.
_SLOPE1 = "((e.t2 - e.t1 * cos(radians(e.x2 - e.x1))) / e.s)"
_SLOPE2 = "((e.t2 * cos(radians(e.x2 - e.x1)) - e.t1) / e.s)"
_APEX = f"degrees(atan(sqrt(e.t1 * e.t1 + {_SLOPE1} * {_SLOPE1})))"


def _clipped(edges: str, a: str, b: str) -> str:
    """SQL: ``edges`` with the lowest and highest latitude, ``lo`` and ``hi``, of their part between two longitudes."""
    ends = [f"greatest(least({x}, greatest(e.x1, e.x2)), least(e.x1, e.x2))" for x in (a, b)]
    low, high = (f"degrees(atan({arc_height(x)} / e.s))" for x in ends)
    rises, falls = f"{_SLOPE1} * e.s > 0 and {_SLOPE2} * e.s < 0", f"{_SLOPE1} * e.s < 0 and {_SLOPE2} * e.s > 0"
    return (
        f"transform({edges}, e -> if(e.s = 0, struct(e, least(e.y1, e.y2) as lo, greatest(e.y1, e.y2) as hi), struct(e,"
        f" if({falls}, -{_APEX}, least({low}, {high})) as lo, if({rises}, {_APEX}, greatest({low}, {high})) as hi)))"
    )


def region_cells(regions: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """Grid cells of each region: ``key, scale, cx, cy, flipped, edges``.

    ``edges`` is empty for a cell wholly inside; cells wholly outside are left out. The table
    depends on the regions alone and can be written once and kept.
    """
    # A table of outlines is small next to the work of gridding it, and often a single split.
    tasks = regions.sparkSession.sparkContext.defaultParallelism
    dealt = regions.select(key, ring).repartition(tasks, key)
    # A region on both sides of the date line is boxed on either side, as its edges are cut there.
    west, east = ("filter(edges, e -> e.x1 + e.x2 {} 0)".format(side) for side in ("<", ">="))
    parted = "exists(edges, e -> greatest(e.x1, e.x2) = 180) and exists(edges, e -> least(e.x1, e.x2) = -180)"
    box = (
        "named_struct('low', array_min(transform({0}, e -> least(e.x1, e.x2))), 'high', array_max(transform({0}, e -> greatest(e.x1, e.x2))))"
    )
    boxes = f"if({parted}, array({box.format(west)}, {box.format(east)}), array({box.format('edges')}))"
    boxed = (
        dealt.select(key, F.expr(polygon_edges(ring)).alias("polygon")).select(key, "polygon.*")
        .filter("size(edges) > 0")
        .selectExpr(
            "*", f"filter({boxes}, b -> b.low is not null) as boxes",
            "if(south, -90d, array_min(transform(edges, e -> least(e.y1, e.y2)))) as min_y",
            "if(north, 90d, array_max(transform(edges, e -> greatest(e.y1, e.y2)))) as max_y",
        )
        .selectExpr("*", "greatest(max_y - min_y, array_max(transform(boxes, b -> b.high - b.low))) as extent")
        .selectExpr(
            "*",
            f"greatest({FEWEST_CELLS}, least({MOST_CELLS}, ceil(2 * sqrt(size(edges))))) as sides",
        )
        .selectExpr(
            "*",
            f"if(extent > 0, greatest(int(ceil(log2(extent / sides) / {SCALE_STEP})) * {SCALE_STEP}, {FINEST_SCALE}),"
            f" {FINEST_SCALE}) as scale",
        )
        .selectExpr("*", "pow(2d, scale) as width")
    )
    # Columns of cells first: an edge beside a column can be neither in its cells nor north of a point
    # in them. The margin keeps edges that rounding could place on either side of a cell border.
    columns = boxed.selectExpr(
        key, "scale", "width", "width * 1e-6d as margin", "edges", "flipped", "north", "south",
        "explode(array_distinct(flatten(transform(boxes, b -> sequence(floor(b.low / width), floor(b.high / width)))))) as cx",
    ).selectExpr(
        key, "scale", "width", "margin", "flipped", "north", "south", "cx",
        _clipped(
            "filter(edges, e -> greatest(e.x1, e.x2) >= cx * width - margin and least(e.x1, e.x2) <= (cx + 1) * width + margin)",
            "cx * width - margin", "(cx + 1) * width + margin",
        ) + " as edges",
    ).filter("size(edges) > 0")
    lowest, highest = "if(south, -90d, array_min(transform(edges, c -> c.lo)))", "if(north, 90d, array_max(transform(edges, c -> c.hi)))"
    cells = columns.selectExpr(
        key, "scale", "width", "margin", "flipped", "cx", "edges",
        f"explode(sequence(floor(({lowest} - margin) / width), floor(({highest} + margin) / width))) as cy",
    )
    middle = {
        axis: f"((greatest(c{axis} * width, -{end}d) + least((c{axis} + 1) * width, {end}d)) / 2)" for axis, end in (("x", 180), ("y", 90))
    }
    # North of a cell every edge over its column still counts.
    return cells.selectExpr(
        key, "scale", "cx", "cy", "flipped",
        "exists(edges, c -> c.hi >= cy * width - margin and c.lo <= (cy + 1) * width + margin) as crossed",
        f"{crossings('transform(edges, c -> c.e)', 'flipped', middle['x'], middle['y'], f'tan(radians({middle["y"]}))')} > 0 as whole",
        "transform(filter(edges, c -> c.hi >= cy * width - margin), c -> c.e) as near",
    ).filter("crossed or whole").selectExpr(
        key, "scale", "cx", "cy", "flipped", "if(crossed, near, slice(near, 1, 0)) as edges"
    )


def join_points_in_regions(
    points: DataFrame,
    regions: DataFrame,
    key: str,
    lon: str = "lon",
    lat: str = "lat",
    ring: str = "ring",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each point with the ``key`` of every region that contains it, boundaries included.

    Regions may cross the date line or hold a pole (``functions.sphere`` says which); longitudes of points
    may be given from -360 to 360 degrees.

    The cell table is measured first. Up to ``broadcast_bytes`` it goes to every executor and the
    points are not shuffled at all; beyond, both sides are shuffled by cell, and AQE splits the
    points of a crowded cell.
    """
    cells = settle(region_cells(regions, key, ring))
    size = cells.agg(
        F.collect_set("scale").alias("scales"),
        F.sum(F.lit(128) + F.size("edges") * 72).alias("bytes"),
    ).first()
    scales = sorted(size["scales"])  # at most one entry per power of two
    if not scales:
        return points.limit(0).withColumn(key, F.lit(None).cast(regions.schema[key].dataType))

    # Coordinates off the globe match nothing; the range test also reaches the file scan.
    located = points.filter(F.col(lon).between(-360.0, 360.0) & F.col(lat).between(-90.0, 90.0))
    spots = ", ".join(
        f"struct(int({s}) as __scale, floor(__x / {2.0**s!r}d) as __cx, floor({lat} / {2.0**s!r}d) as __cy)"
        for s in scales
    )
    placed = located.selectExpr("*", f"{wrapped(lon)} as __x", f"tan(radians({lat})) as __t")
    spotted = placed.selectExpr("*", f"inline(array({spots}))")
    inside = F.expr(f"size(edges) = 0 or {crossings('edges', 'flipped', '__x', lat, '__t')} > 0")
    same_cell = (
        (F.col("__scale") == F.col("scale"))
        & (F.col("__cx") == F.col("cx"))
        & (F.col("__cy") == F.col("cy"))
    )
    # The hint keeps Catalyst from broadcasting a cell table measured to be too large.
    way = F.broadcast(cells) if size["bytes"] <= broadcast_bytes else cells.hint("merge")
    return spotted.join(way, same_cell & inside).select(*points.columns, key)


def region_studies(hits: DataFrame, key: str, study: str, order: str) -> DataFrame:
    """Sites ``n`` and first place ``first_ord`` per (region, study). Combined on the map side."""
    return hits.groupBy(key, study).agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first_ord")
    )


def studies_by_region(seen: DataFrame, key: str, study: str) -> DataFrame:
    """One row per region: its sites ``n``, its studies, and how many of them have an id."""
    return seen.groupBy(key).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("n_studies"),
        F.count(study).alias("n_known_studies"),
    )


def region_study_places(seen: DataFrame, key: str, study: str) -> DataFrame:
    """``key``, ``place``, study id: the studies of every region as rows, numbered in first-seen order from 1.

    Rows are numbered over all regions and a region's first number is taken off, so that a region of any size is spread over tasks.
    """
    order = [F.col(key).asc_nulls_last(), F.col("first_ord").asc_nulls_last(), F.col(study).asc_nulls_last()]
    numbered = with_row_id(seen.select(key, study, "first_ord"), order, "__id")
    starts = numbered.groupBy(F.col(key).alias("__key")).agg(F.min("__id").alias("__start"))
    joined = numbered.join(starts, F.col(key).eqNullSafe(F.col("__key")))
    return joined.select(key, (F.col("__id") - F.col("__start") + 1).alias("place"), study)


def region_study_chunks(places: DataFrame, key: str, study: str, size: int = CHUNK_STUDIES) -> DataFrame:
    """``key``, ``chunk``, ``studies``: the ids of every region as comma-joined texts of at most ``size`` ids, numbered from 0."""
    entry = F.struct("place", text_or_na(F.col(study)).alias("text"))
    ids = F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["text"])
    chunk = F.floor((F.col("place") - 1) / size).alias("chunk")
    return places.groupBy(key, chunk).agg(F.array_join(ids, ", ").alias("studies"))


def region_studies_text(
    seen: DataFrame, key: str, study: str, regions: Sequence[object] | None = None, most: int = TEXT_STUDIES
) -> DataFrame:
    """Comma-joined study ids in first-seen order of the regions asked for, by default all, one text each.

    A text is one value, so regions of more than ``most`` studies have none here; ``region_study_places`` and
    ``region_study_chunks`` give theirs, as they give those of all others.
    """
    asked = seen if regions is None else filter_in(seen, key, regions)
    short = asked.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") <= most)
    kept = asked.join(short, F.col(key).eqNullSafe(F.col("__key")), "left_semi")
    chunks = region_study_chunks(region_study_places(kept, key, study), key, study)
    texts = F.array_sort(F.collect_list(F.struct("chunk", "studies")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(texts, lambda s: s["studies"]), ", ").alias("studies"))


def sites_by_region(hits: DataFrame, key: str) -> DataFrame:
    """Site count per region alone."""
    return hits.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
