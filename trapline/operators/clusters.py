"""Clusters of map points for several zoom levels: cells of a grid, or markers within a distance of each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.session import settle

# A marker cluster covers 80 screen pixels; zoom 0 shows the world's 360 degrees on 256 pixels.
CLUSTER_DEGREES = 360.0 * 80 / 256


def cell_degrees(zoom: int) -> float:
    """Cell width at a zoom level; each level halves the one before."""
    return CLUSTER_DEGREES / (1 << zoom)


def cluster_points(
    df: DataFrame, zooms: Sequence[int], lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Point count and mean position per zoom level and grid cell.

    Only the finest level reads the points. Cells nest, so the coarser levels add up finest cells
    instead of seeing every point once per level.
    """
    finest = max(zooms)
    size = F.lit(cell_degrees(finest))
    located = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    cells = located.groupBy(
        F.floor(F.col(lon) / size).alias("cx"), F.floor(F.col(lat) / size).alias("cy")
    ).agg(
        F.count(F.lit(1)).alias("number"), F.sum(lon).alias("__x"), F.sum(lat).alias("__y")
    )
    steps = F.explode(F.array(*[F.lit(z) for z in sorted(set(zooms))])).alias("zoom")
    shift = F.col("zoom") - F.lit(finest)
    coarse = cells.select("*", steps).withColumns(
        {c: F.floor(F.col(c) * F.pow(F.lit(2.0), shift)) for c in ("cx", "cy")}
    )
    return coarse.groupBy("zoom", "cx", "cy").agg(
        F.sum("number").alias("number"),
        (F.sum("__x") / F.sum("number")).alias("lon"),
        (F.sum("__y") / F.sum("number")).alias("lat"),
    )


# A tile is wider than the distance at which markers join, so that tiles of one colour out of four do not touch each other's markers.
TILE = 1.5
_TAKEN = "cx bigint, cy bigint, lon double, lat double, c_lon double, c_lat double"


def _take(reach: float) -> Callable:
    """Centres among the markers of each tile, in order, and the markers of the tile they take.

    A marker within reach of a centre before it goes to the first such, any other is a centre. Centres are further apart than ``reach``, so
    a tile has a handful of them at most, however many markers lie in it.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, centres = None, []
        for batch in batches:
            out = []
            for cx, cy, lon, lat in zip(*(batch.column(c).to_pylist() for c in ("cx", "cy", "lon", "lat"))):
                if (cx, cy) != tile:
                    tile, centres = (cx, cy), []
                near = next((c for c in centres if (c[0] - lon) * (c[0] - lon) + (c[1] - lat) * (c[1] - lat) <= reach * reach), None)
                if near is None:
                    near = (lon, lat)
                    centres.append(near)
                out.append((cx, cy, lon, lat, *near))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 2 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cx", "cy", "lon", "lat", "c_lon", "c_lat"])

    return take


def _join_markers(markers: DataFrame, reach: float) -> DataFrame:
    """``lon``, ``lat`` of every marker with its centre, ``c_lon``, ``c_lat``.

    Tiles take turns by colour; tiles of one colour are worked on at the same time, as their markers are out of each other's reach. The
    centres found then take what is left within reach in the tiles around, of several centres the first.
    """
    parts = int(markers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = reach * TILE
    left = markers.select("lon", "lat", F.floor(F.col("lon") / width).alias("cx"), F.floor(F.col("lat") / width).alias("cy"))
    left = settle(left.withColumn("colour", F.pmod("cx", F.lit(2)) + 2 * F.pmod("cy", F.lit(2))))
    around = F.array(*[F.struct((F.col("cx") + x).alias("x"), (F.col("cy") + y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y])
    decided = []
    for colour in range(4):
        own = left.filter(F.col("colour") == colour).select("cx", "cy", "lon", "lat")
        dealt = own.repartition(parts, "cx", "cy").sortWithinPartitions("cx", "cy", "lon", "lat")
        taken = settle(dealt.mapInArrow(_take(reach), _TAKEN))
        decided.append(taken.select("lon", "lat", "c_lon", "c_lat"))
        if colour == 3:
            break
        centres = taken.filter("lon = c_lon and lat = c_lat").select(
            F.struct("cy", "cx", "c_lon", "c_lat").alias("centre"), F.explode(around).alias("tile")
        )
        others = left.filter(F.col("colour") > colour)
        east, north = F.col("centre.c_lon") - F.col("lon"), F.col("centre.c_lat") - F.col("lat")
        met = others.join(centres, (F.col("cx") == F.col("tile.x")) & (F.col("cy") == F.col("tile.y")) & (east * east + north * north <= reach * reach))
        claimed = settle(met.groupBy("lon", "lat").agg(F.min("centre").alias("c")).select("lon", "lat", "c.c_lon", "c.c_lat"))
        decided.append(claimed)
        left = settle(others.join(claimed.select("lon", "lat"), ["lon", "lat"], "left_anti"))
    found = decided[0]
    for more in decided[1:]:
        found = found.unionByName(more)
    return found


def cluster_markers(df: DataFrame, zooms: Sequence[int], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Markers joined by distance: ``zoom``, the centre's ``lon`` and ``lat``, ``number`` of points, their ``mean_lon`` and ``mean_lat``.

    At the finest zoom the markers are the distinct coordinates, at each coarser one the clusters of the level before. Markers are
    visited tile by tile, by colour (column and row of the tile modulo 2), row, column, longitude, latitude; one that has no
    centre yet becomes one and takes all others without centre within a cluster's width. The result is that of going through the
    markers one by one, for any partitioning. Unplaced points are left out.
    """
    located = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    markers = located.groupBy(F.col(lon).alias("lon"), F.col(lat).alias("lat")).agg(F.count(F.lit(1)).alias("number"))
    markers = settle(markers.select("*", (F.col("lon") * F.col("number")).alias("x"), (F.col("lat") * F.col("number")).alias("y")))
    levels = []
    for zoom in sorted(set(zooms), reverse=True):
        joined = markers.join(_join_markers(markers, cell_degrees(zoom)), ["lon", "lat"])
        markers = settle(
            joined.groupBy(F.col("c_lon").alias("lon"), F.col("c_lat").alias("lat")).agg(F.sum("number").alias("number"), F.sum("x").alias("x"), F.sum("y").alias("y"))
        )
        mean = [(F.col(c) / F.col("number")).alias(f"mean_{name}") for c, name in (("x", "lon"), ("y", "lat"))]
        levels.append(markers.select(F.lit(zoom).alias("zoom"), "lon", "lat", "number", *mean))
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found
